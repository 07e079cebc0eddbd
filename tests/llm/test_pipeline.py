"""The pipeline's stages against plain versions of what they decide, and the registered queries."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from demandry.llm import queries
from demandry.llm.lines import MIN_PAGES, RATIO

from .test_operators import DOCS, corpus, plain_components, plain_fingerprint, plain_spans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    data = corpus(120)
    item = " ".join(data[7][1].split() * 20)[:400]
    data.append((500, "before " + item, "en", "src0", 1))
    spark.createDataFrame(data, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        after = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        after.write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        rows = [tuple(r) for r in docs.select(*columns).collect()]
        if name == "language":
            assert all(r[1] and any(c.isalpha() for c in r[1]) for r in rows)
            assert {r for r in before if r[1] and len(r[1].split()) > 20} <= set(rows)  # clean ones stay
        elif name == "lines":
            assert [r[0] for r in sorted(rows, key=str)] == [r[0] for r in sorted(before, key=str)] or Counter(r[0] for r in rows) == Counter(r[0] for r in before)
            pages, host = Counter((r[3], x.strip(" \t\r")) for r in before for x in {y.strip(" \t\r") for y in r[1].split("\n")}), Counter(r[3] for r in before)
            bad = {k for k, n in pages.items() if n >= MIN_PAGES and n > RATIO * host[k[0]] and k[1]}
            for r in before:
                kept = [x for x in r[1].split("\n") if (r[3], x.strip(" \t\r")) not in bad]
                text = "\n".join(kept) if any(x.strip(" \t\r") for x in kept) else r[1]
                assert (r[0], text, r[2], r[3], len(text)) in rows
        elif name == "near_duplicates":
            prints = [plain_fingerprint(r[1]) for r in before]
            root = plain_components(prints)
            assert Counter(root[plain_fingerprint(r[1])] for r in rows) == Counter(set(root.values())) and set(rows) <= set(before)
        elif name == "benchmarks":
            clean = [r for r in before for n, h, _ in [plain_spans(r[1], items)] if not (h > 0 and 20 * h >= n)]
            assert Counter(rows) == Counter(clean) and len(clean) < len(before)
        else:
            assert set(rows) <= set(before) and docs.where("taken <= 0 or taken > 3 * size").count() == 0


def plain_mixture(rows, labels):
    """(row, taken) of what the mix takes: rows sorted by their keys within a source, weighed by their labels."""
    best, sizes = {}, Counter()
    for k, quality in labels:
        best[k] = max(best.get(k, quality), quality)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s] + 1e-9}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    found = Counter()
    for s in names:
        epochs, rest = divmod(math.floor(target[s] + 0.5), sizes[s])
        keyed = []
        for r in rows:
            if r[3] == s:
                n = len((r[1] or "").split())
                bits = int(hashlib.md5(":".join(["mix"] + [str(r[0])] * (r[0] is not None) + [str(n)]).encode()).hexdigest()[:13], 16)
                keyed.append((-math.log((bits + 0.5) / 2**52) / {0: 1, 1: 4, None: 2}[best.get(r[0])], -1 if r[0] is None else r[0], n, r))
        for _, _, n, r in sorted(keyed, key=lambda x: x[:3]):
            part = min(n, rest)
            rest -= part
            if epochs * n + part:
                found[r, epochs * n + part] += 1
    return found


def test_mixture_weighs_by_labels(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(f"{k}w{j}" if k % 3 else "good" for j in range(rng.randrange(1, 60))), "en", rng.choice("abcd"), k) for k in range(600)]
    rows += [(900, "copy of a page " * 5, "en", "b", 0)] * 40 + [(None, "no id", None, None, 0), (901, None, "en", "a", 0), (3, "other text of an id", "en", "c", 0), (902, "a null moves", None, "a", 0), (902, "a null moves", "a", None, 0)]
    labels = [(k, rng.randrange(2)) for k in range(400)] + [(900, 1), (5, 0), (5, 1), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.createDataFrame(rows, DOCS)
    for data, plain in ((table, rows), (table.dropDuplicates(), sorted(set(rows), key=str))):
        got = corpus_pipeline.mixture(spark, data, str(tmp_path)).collect()
        assert Counter((tuple(r[c] for c in table.columns), r.taken) for r in got) == plain_mixture(plain, labels)
    assert all(r.size == len((r.text or "").split()) for r in got)


def test_run_gives_the_stages_rows(spark, folder):
    once = Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    assert once == Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    assert sum(once.values()) > 0


def test_all_thirteen_are_registered():
    names = set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14)) and set(queries.QUERIES) | {"pipeline"} <= names


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(queries.SQL[name])
    columns = sorted(c[0] for c in got.description)
    expected = Counter(tuple(str(v) for v in r) for r in con.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall())
    assert Counter(tuple(str(v) for v in r) for r in queries.QUERIES[name](spark, sf).select(*columns).collect()) == expected


def test_documents_of_a_query_are_whole(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.QUERIES["op1_simhash"](spark, sf).agg(F.count("*")).first()[0] == n
