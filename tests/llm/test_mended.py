"""What earlier versions got wrong: many languages, names within articles, ids of any type, names of rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from demandry.llm import html, langid, licenses, lm, media, suffix

from .test_operators import DOCS, corpus


def tongues(n, each=20, seed=3):
    rng, rows = random.Random(seed), []
    for lang in range(n):
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3]))) for _ in range(25)]
        rows += [(lang * each + k, " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(40)), f"l{lang}", "s", 1) for k in range(each)]
    return rows


@pytest.mark.parametrize("n", [1, 2, 300])
def test_any_number_of_languages_stays(spark, n):
    rows = tongues(n)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert Counter(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == Counter(r[0] for r in rows)


def test_language_stage_is_brute_force(spark):
    """Each text told alone by plain kernel sums, by the model that the stage fits."""
    data = corpus(90)
    clash = [*data, (901, "1234 !!", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 0.0, "x", "y") for r in clash], f"{DOCS}, score double, lang_pred string, row string")
    learn = F.coalesce(langid.remainder("doc_id", 4) != 2, F.lit(False))
    model = langid.trained(*langid.training_rows(docs, learn, "lang", "doc_id", "text", langid.ROWS))
    marks = [set(np.flatnonzero(m).tolist()) for m in model.landmarks]
    slope, offset = model.sure

    def kept(text):
        if text is None or not any(c.isalpha() for c in text):
            return False
        own = set(np.flatnonzero(langid.presence([text.encode()])[0]).tolist())
        near = [len(own & m) / math.sqrt(max(len(own), 1) * max(len(m), 1)) for m in marks]
        values = sorted(float(o) + sum(k * float(w) for k, w in zip(near, column, strict=True)) for o, column in zip(model.offset, model.weights.T, strict=True))
        return 1 / (1 + math.exp(-slope * (values[-1] - values[-2]) - offset)) >= corpus_pipeline.SURE

    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(r for r in clash if kept(r[1]))


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "mixture"], ids=lambda s: s[0])
def test_stages_of_empty_tables(spark, tmp_path, stage):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage[1](spark, spark.createDataFrame([], DOCS), str(tmp_path))
    assert got.collect() == [] and got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_calibrated_curve():
    rng = np.random.default_rng(1)
    margin = rng.random(4000)
    right = rng.random(4000) < 1 / (1 + np.exp(-(6 * margin - 1)))
    slope, offset = langid.calibrated(margin, right)
    assert abs(slope - 6) < 0.6 and abs(offset + 1) < 0.3
    slope, offset = langid.calibrated(np.array([0.1, 0.9, 0.5]), np.array([True, True, True]))
    assert slope >= 0 and 1 / (1 + math.exp(-offset)) > 0.5
    assert langid.calibrated(np.zeros(0), np.zeros(0, dtype=bool)) == (0.0, 0.0)


@pytest.mark.parametrize("part", ['<div class="related-work">{}</div>', '<p class="alert-text">{}</p>', '<blockquote class="social">{}</blockquote>', '<section class="story-search-results">{}</section>', "<p><span class='ad-hoc'>{}</span></p>"])
@pytest.mark.parametrize("holder", ["article", "main"])
def test_articles_keep_parts_named_like_asides(part, holder):
    page = f"<html><body><nav>Home</nav><{holder}><h1>Title</h1><p>Before it.</p>{part.format('This stays here.')}<p>After it.</p></{holder}></body></html>"
    assert html.main_text(page) == "Title Before it. This stays here. After it."


@pytest.mark.parametrize("part", ['<div class="comments">{}</div>', '<div class="comments-section">{}</div>', '<div class="ad-box">{}</div>', '<p class="advert">{}</p>', "<aside>{}</aside>", '<ul class="share-links"><li>{}</li></ul>', '<div id="related">{}</div>', "<p><span class='ad'>{}</span></p>"])
def test_asides_within_articles_go(part):
    page = f"<html><body><article><h1>Title</h1><p>Before it.</p>{part.format('This goes.')}<p>After it.</p></article></body></html>"
    assert html.main_text(page) == "Title Before it. After it."


def test_media_of_string_ids(spark):
    rows = [("a", "one text"), ("b", None), (None, "one text"), ("c", "x" * 9000)]
    got = media.media_column(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["None", "a", "b", "c"]
    assert len({r.payload_sha256 for r in got if r.doc_id in ("a", None)}) == 1


def test_rows_are_named_by_128_bits(spark):
    docs = spark.createDataFrame(corpus(40), DOCS)
    items = spark.createDataFrame([(1, corpus(40)[5][1])], "item_id long, text string")
    rows = suffix.decontaminate(docs, items).select("doc_id", "row").distinct().collect()
    assert all(len(r.row) > 24 for r in rows) and len({r.row for r in rows}) == len(rows)


def test_media_features_are_brute_force(spark):
    rows = [(k, "".join(random.Random(k).choice("ab c\n") for _ in range(40 * k))) for k in range(6)]
    got = {r.doc_id: r for r in media.media_column(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        payload = text.encode() + bytes(-len(text) % 64 if text else 64)
        assert got[k].feature == media.features(np.frombuffer(payload, dtype=np.uint8)) and got[k].payload_bytes == len(payload)


NOTICE = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
LICENCES = {
    NOTICE.format(what="library", name="Lesser General Public License", v="3"): "LGPL-3.0",
    NOTICE.format(what="program", name="Lesser General Public License", v="3"): "LGPL-3.0",
    NOTICE.format(what="library", name="Lesser General Public License", v="2.1"): "LGPL-2.1",
    NOTICE.format(what="program", name="Affero General Public License", v="3"): "AGPL-3.0",
    NOTICE.format(what="program", name="General Public License", v="3"): "GPL-3.0",
    NOTICE.format(what="program", name="General Public License", v="2"): "GPL-2.0",
    "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
    "CC BY 4.0": "CC-BY-4.0",
    "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD-2-Clause",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-3-Clause",
    **{f"// SPDX-License-Identifier: {k}": k for k in ("GPL-2.0-or-later", "GPL-3.0-or-later", "GPL-2.0-only", "LGPL-3.0-only", "0BSD", "MIT-0", "MIT", "CC-BY-ND-4.0", "BSD-3-Clause", "Apache-2.0")},
    "# SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0",
    "SPDX-License-Identifier: (MIT  AND\tBSD-3-Clause) WITH x": "(MIT AND BSD-3-Clause) WITH x",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only WITH Classpath-exception-2.0",
}


def test_versions_and_variants_of_licences(spark):
    rows = spark.createDataFrame([(k, t, f"d/{k}.txt") for k, t in enumerate(LICENCES)], "doc_id long, text string, path string")
    got = {r.doc_id: r.license for r in licenses.scan(rows, keep=("doc_id",)).collect()}
    assert {t: got[k] for k, t in enumerate(LICENCES)} == LICENCES


def test_templates_tell_unnamed_siblings_apart(spark, sf):
    """Pages without attributes and telling elements, of hosts with enough of them: only the template knows where the
    article is."""
    pages = spark.read.parquet(f"{sf.rpartition('/')[0]}/sf0.01/pages.parquet")
    wanted = {r.page_id: r.text for r in html.extract(pages).collect()}
    bare = F.regexp_replace(F.regexp_replace("html", r'\s(class|id|role)="[^"]*"', ""), r"(?i)<(/?)(article|main|nav|header|footer|aside|section)\b", "<$1div")
    got = {r.page_id: (r.text, html.main_text(r.html)) for r in html.extract(pages.withColumn("html", bare)).join(pages.select("page_id", bare.alias("html")), "page_id").collect()}

    def precision(k):
        both = [(Counter(got[p][k].split()), Counter(wanted[p].split())) for p in wanted]
        return sum(sum((a & b).values()) for a, b in both) / sum(sum(a.values()) for a, _ in both)

    assert precision(0) > precision(1)
    assert precision(0) >= 0.98


def test_lm_learns_from_no_sample(spark):
    """A document's score is the same whatever its id, and so whichever share of the ids a hash would draw: no row has a part in
    the model that others don't have."""
    texts = [" ".join(f"w{(i * 7 + k * k) % 53}" for k in range(60 + i % 5)) for i in range(300)]
    scores = []
    for salt in ("a", "b"):
        docs = spark.createDataFrame([(f"{salt}{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
        scores.append({r.doc_id[1:]: round(r.score, 6) for r in lm.score_texts(docs, F.lit(True), F.lit(False)).collect()})
    assert scores[0] == scores[1]


def test_word_counts_in_many_lots(spark, monkeypatch):
    """Counts are merged and passed on when a task holds many words; ends are counted with them."""
    monkeypatch.setattr(lm, "HELD_WORDS", 20)
    monkeypatch.setattr(lm.model, "TEXT", 64)
    texts = [" ".join(f"v{(i * k) % 31}" for k in range(12)) for i in range(40)] + [None, "", "  "]
    expected = Counter(w.encode() for t in texts for w in (t or "").split()) + Counter({b"": len(texts)})
    found = lm.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)).collect()
    assert Counter({bytes(r.word): r.c for r in found}) == expected and len(found) == len(expected)
