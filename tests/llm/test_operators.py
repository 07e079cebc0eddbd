"""Each operator on a small table with nulls, empties, long texts, ties, repeated rows and clashing columns, and against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from demandry.llm import html, langid, licenses, lines, lm, media, mixing, mixmodel, simhash, suffix, toxicity, vptree
from demandry.llm.common import LOWER
from demandry.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPELL = {"en": "the of and ing tion er on is that with", "fr": "le la de et que ment eau oi est dans", "de": "der die und ich sch ein von zu mit auf"}


def words(rng, lang, n):
    parts = SPELL[lang].split()
    return [rng.choice(parts) + (rng.choice(parts) if rng.random() < 0.7 else "") for _ in range(n)]


def corpus(n=160, seed=1):
    """Documents with every awkward case; ids repeat, some rows are equal."""
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(SPELL))
        body = words(rng, lang, rng.choice([1, 3, 12, 60, 200]))
        text = "\n".join(" ".join(body[k : k + 15]) for k in range(0, len(body), 15))
        out.append((i, text, lang, f"src{rng.choice([0, 0, 0, 1, 2, 3])}", len(text)))
    long_ = " ".join(words(rng, "en", 30_000))
    base = out[5][1]
    out += [(n, None, "en", "src0", None), (n + 1, "", "fr", None, 0), (n + 2, "  \n\t ", None, "src1", 5), (n + 3, long_, "en", "src0", len(long_)), (n + 4, base, "en", "src2", 1), (n + 4, base, "en", "src2", 1), (None, "12 34 !!", "de", "src1", 8), (n + 5, base + " extra", "en", "src2", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Near-duplicates


def plain_fingerprint(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    keys = sorted(set(prints))
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_simhash_is_brute_force(spark, docs):
    got = simhash.simhash_groups(docs).collect()
    data = corpus()
    prints = [plain_fingerprint(r[1]) for r in data]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter(zip((r[0] for r in data), prints, strict=True))
    root = plain_components(prints)
    least = {}
    for r, p in zip(data, prints, strict=True):
        if r[0] is not None:
            least[root[p]] = min(r[0], least.get(root[p], r[0]))
    assert all(r.component_id == least.get(root[r.fp % (1 << 64)]) for r in got)


@pytest.mark.parametrize("blocks", [5, 6, 7])
@pytest.mark.parametrize("leaf", [20, 100])
def test_trees_lose_no_link(spark, blocks, leaf):
    rng = random.Random(blocks * leaf)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for p in prints[:60]:  # a dense group and some neighbours at the edge
        flip = rng.sample(range(64), rng.choice([1, 2, 3, 4, 5]))
        prints.append(p ^ sum(1 << b for b in flip))
    centre = rng.getrandbits(64)
    prints += [centre ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(300)]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in set(prints)], "fp long")
    edges = simhash.links(df, 4, leaf=leaf, blocks=blocks)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
    expected = plain_components(prints)
    same = {}
    for p in set(prints):
        same.setdefault(expected[p], set()).add(roots.get(p, p))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({roots.get(p, p) for p in set(prints)})


def test_full_metric_nodes_overlap():
    """Where the mask can't split, the tree goes on with radius 4 and sends boundary points to both sides."""
    rng, mask = random.Random(2), vptree.masks(5, 4)[0]
    free = [b for b in range(64) if not mask >> b & 1]
    flips = rng.sample(free, 40)
    centres = [0]
    for b in flips:  # a chain of centres, each a bit from the next
        centres.append(centres[-1] ^ (1 << b))
    prints = np.unique(np.array([rng.choice(centres) ^ sum(1 << b for b in rng.sample(free, 2)) for _ in range(4000)], dtype=np.uint64))
    tree = vptree.build(prints, mask, 4, 1500)
    row, leaf = tree.route(prints)
    assert tree.leaves > 1 and 4 in tree.radius and len(row) > len(prints)
    where = {}
    for r, k in zip(row.tolist(), leaf.tolist(), strict=True):
        where.setdefault(r, set()).add(k)
    for i in range(0, len(prints), 40):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4)
        assert all(where[i] & where[j] for j in near.tolist())


def test_bounds_prune_on_documents(spark):
    """On the documents of sf0.01 trees have nodes in the full metric, whose bounds send most fingerprints to one side."""
    rows = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("fp").distinct().collect()
    prints = np.sort(np.array([r[0] for r in rows], dtype=np.int64)).view(np.uint64)
    groups = np.array([p ^ np.uint64(1 << a | 1 << b) for p in prints[:3] for a in range(24) for b in range(a)], dtype=np.uint64)
    prints = np.unique(np.r_[prints, groups])
    tree = vptree.build(prints, vptree.masks(5, 4)[0], 4, 50)
    row, _ = tree.route(prints)
    full = [k for k, m in enumerate(tree.metric) if m == int(vptree.FULL)]
    assert full and tree.leaves > 10 and len(row) < 1.3 * len(prints)
    d = vptree.distance(prints, tree.vantage[full[0]], int(vptree.FULL))
    pruned = (d + 4 <= tree.threshold[full[0]]) | (d - 4 > tree.threshold[full[0]])
    assert pruned.mean() >= 0.9


def test_simhash_of_odd_tables(spark, docs, empty):
    assert simhash.simhash_groups(empty).count() == 0
    clash = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("fp"), F.lit(2).alias("root"), F.lit(3).alias("salt"))
    got = simhash.simhash_groups(clash).collect()
    assert len(got) == len(corpus()) and all(r.component_id is None or r.doc_id is None or r.component_id <= r.doc_id for r in got)


def test_leaves_are_dealt_further(spark):
    """With few drawn points leaves are dealt by their mask, and no link is lost."""
    rng = random.Random(21)
    prints = [rng.getrandbits(64) for _ in range(3000)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 3, 4]))) for p in prints[:500]]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in set(prints)], "fp long")
    edges = simhash.links(df, 4, leaf=20, sample=60)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
    expected = plain_components(prints)
    assert len({(roots.get(p, p), expected[p]) for p in set(prints)}) == len(set(expected.values())) == len({roots.get(p, p) for p in set(prints)})


def test_components_of_awkward_edges(spark):
    edges = spark.createDataFrame([(5, 5), (1, 2), (2, 1), (2, 3), (9, 8), (8, 7), (7, 6), (6, 9)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} >= {(2, 1), (3, 1), (7, 6), (8, 6), (9, 6)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Benchmark


def plain_spans(text, items):
    keep = lambda t: ["".join(g) for g in _runs((t or "").lower() if (t or "").isascii() else "".join(c.lower() if c.isascii() else c for c in t or ""))]
    own, hit, found = keep(text), set(), set()
    for name, item in items:
        ws = keep(item)
        if not ws:
            continue
        n = min(13, len(ws))
        for k in range(len(ws) - n + 1):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == ws[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add("" if name is None else str(name))
    return len(own), len(hit), sorted(found)


def _runs(text):
    run = ""
    for c in text:
        if c.isascii() and not c.isalnum():
            if run:
                yield run
            run = ""
        else:
            run += c
    if run:
        yield run


@pytest.mark.parametrize("pass_words", [suffix.PASS_WORDS, 20])
def test_decontamination_is_brute_force(spark, pass_words):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, "en", 30))) for k in range(6)] + [(10, "Zebra"), (11, None), (12, "--- !"), (13, "un été là"), (None, "a null named item"), (2, " ".join(words(rng, "fr", 14)))]
    data = [(k, " ".join(words(rng, "en", 20)) + "." * 3 + items[k % 6][1][: 20 * k] + " " + " ".join(words(rng, "en", 5)), "en", "s", 0) for k in range(20)]
    data += [(50, "a zebra-crossing ZEBRA", "en", "s", 0), (51, None, "en", "s", 0), (52, "", "en", "s", 0), (53, items[0][1], "en", "s", 0), (53, items[0][1], "en", "s", 0), (54, items[0][1][:40] + " x " + items[0][1][40:], "en", "s", 0), (55, "un ÉTÉ là; Un été là", "fr", "s", 0), (56, "a NULL named item", "en", "s", 0)]
    table = spark.createDataFrame(data, DOCS).withColumn("row", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in suffix.decontaminate(table, bench, pass_words=pass_words).collect())
    expected = Counter((d[0], n, h, tuple(f)) for d in data for n, h, f in [plain_spans(d[1], items)])
    assert got == expected


def test_decontamination_of_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffix.decontaminate(docs, bench).where("n_hit > 0").count() == 0 and suffix.decontaminate(empty, bench).count() == 0


# Lines


def test_boilerplate_lines(spark, empty):
    data = [(k, f"Welcome to the site \nown line {k}\n\nfooter {k % 2}", "en", "a", 0) for k in range(10)] + [(20 + k, f"Welcome to the site\nother {k}", "en", "b", 0) for k in range(3)]
    data += [(40, None, "en", "a", 0), (41, "", "en", None, 0), (42, "Welcome to the site", "en", "a", 0), (42, "Welcome to the site", "en", "a", 0)]
    table = spark.createDataFrame(data, DOCS).withColumn("n_dropped", F.lit("x"))
    clash = table.withColumns({c: F.lit(1) for c in ("drop", "lines", "row", "host", "left", "key")})
    for rows, own in ((lines.BROADCAST_ROWS, table), (0, clash)):
        got = {(r.doc_id, r.text, r.n_dropped) for r in lines.drop_boilerplate(own, ratio=0.5, keep_whole=True, broadcast_rows=rows).collect()}
        assert (3, "own line 3\n\nfooter 1", 1) in got  # blank lines stay, the trailing blank doesn't matter
        assert (20, "Welcome to the site\nother 0", 0) in got  # too few pages
        assert (42, "Welcome to the site", 0) in got and (40, None, 0) in got and (41, "", 0) in got
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.drop_boilerplate(table, ratio=0.5).collect()}
    assert (42, "", 1, 1) in got and (40, None, 0, 0) in got and (41, "", 0, 0) in got
    assert lines.drop_boilerplate(empty).count() == 0


# Mixing


def test_mixture(spark, docs, empty):
    table = docs.withColumns({c: F.lit("x") for c in ("target", "__key", "key", "bin", "row", "of", "cut", "rest")})
    got = mixing.mix(table, mixing.word_count(F.col("text")), F.lit(1.0)).collect()
    assert len(got) == len(corpus())
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
        assert r.size == len((r.text or "").encode().split()) and 0 <= r.taken <= 3 * r.size
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:  # reshare the excess by weight until no source is above its cap
        rest = sum(sizes.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s] + 1e-9}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.mix(table.repartition(3), mixing.word_count(F.col("text")), F.lit(1.0), broadcast_rows=0).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(empty, mixing.word_count(F.col("text")), F.lit(1.0)).count() == 0


def test_quality_is_taken_first(spark):
    data = [(k, "w " * 10, "en", s, 0) for s in "ab" for k in range(400)]
    table = spark.createDataFrame(data, DOCS).withColumn("q", F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0))
    got = mixing.mix(table, mixing.word_count(F.col("text")), F.col("q")).where("source = 'b'").collect()
    good, bad = (sum(r.taken for r in got if r.doc_id % 2 == m) for m in (0, 1))
    assert good > 2 * bad


# Language


def test_language(spark, empty):
    rng = random.Random(6)
    data = [(i, " ".join(words(rng, lang, 40)), lang, "s", 0) for i in range(400) for lang in [rng.choice(list(SPELL))]]
    data += [(900, None, "en", "s", 0), (901, "12 ½ ²", "en", "s", 0), (902, "", None, "s", 0), (None, "the of and", "xx", "s", 0), (903, "é", "fr", "s", 0)]
    table = spark.createDataFrame(data, DOCS).withColumn("score", F.lit("x"))
    held = langid.remainder("doc_id", 4) == 2
    got = langid.identify(table, ~held).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 902)) and by[903].lang_pred != "und"
    test = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in test) >= 0.97 * len(test) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got} <= {*SPELL, "und"}
    assert langid.identify(empty, F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(table, F.lit(False)).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """A hundred languages of letters of their own: none is left out."""
    rng = random.Random(14)
    data = []
    for k in range(100):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(20)]
        data += [(100 * k + j, " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(12)), f"l{k:03d}", "s", 0) for j in range(12)]
    got = langid.identify(spark.createDataFrame(data, DOCS), F.lit(True)).collect()
    assert {r.lang_pred for r in got} == {f"l{k:03d}" for k in range(100)} and sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)


def test_scores_do_not_see_labels(spark):
    rng = random.Random(8)
    data = [(i, " ".join(words(rng, lang, 20)), lang, "s", 0) for i in range(120) for lang in [rng.choice(list(SPELL))]]
    held = lambda d: langid.remainder("doc_id", 4) == 2
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(data, DOCS), ~held(0)).collect()}
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in data]
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(changed, DOCS), ~held(0)).collect()}
    assert a == b


# Language model


def test_lm_counts_and_scores(spark, docs, empty):
    held = langid.remainder("doc_id", 7) == 2
    got = lm.score_texts(docs.withColumn("score", F.lit("x")), ~held, held).collect()
    data = corpus()
    learn = [r for r in data if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    tokens = lambda t: [*(t or "").encode().translate(LOWER).split(), b""]
    c = Counter(w for r in learn for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for r in data:
        own = tokens(r[1])
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)
        expected[r[0], len(own), sum(c[w] > 0 for w in own), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert lm.score_texts(empty, F.lit(True), F.lit(False)).count() == 0
    assert {r.train_tokens for r in lm.score_texts(docs, F.lit(False), F.lit(False)).collect()} == {0}


def test_lm_beats_the_unigram(spark, sf):
    got = lm.op5_lm_score(spark, sf).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_codes_are_prefix_codes():
    ptr, nodes, bits = mixmodel.paths(*mixmodel.code([5, 1, 1, 9, 2], [3, 0, 1, 2, 4]))
    seen = {tuple(zip(nodes[a:b].tolist(), bits[a:b].tolist(), strict=True)) for a, b in zip(ptr[:-1], ptr[1:], strict=True)}
    assert len(seen) == 5 and sum(2.0 ** -len(p) for p in seen) == 1 and all(p[0][0] == 0 for p in seen)


def lot(coder, docs):
    """Codes, cuts and rare words of tokenised documents."""
    found = [coder.numbers(pa.array(d, type=pa.large_binary())) for d in docs]
    return np.concatenate([c for c, _, _ in found]), np.r_[0, np.cumsum([len(d) for d in docs])], [r for _, _, r in found]


def test_bits_are_a_probability():
    """Over all words of a small vocabulary the paths' probabilities sum to one."""
    coder = mixmodel.Coder([b"aa", b"ab", b"ba"], [5, 3, 2], 1, 4)
    counts = coder.empty_counts()
    streams, _ = coder.encode(*lot(coder, [[b"aa", b"ab", b"aa", b"ba", b"aa"], [b"ab", b"zz"]]))
    mixmodel.count(counts, streams)
    predictor, total = mixmodel.Predictor.of(coder.above, counts), 0
    end = sum(mixmodel.run(mixmodel.Mixer(), predictor, coder.encode(*lot(coder, [[]]))[0][0]))
    for name in (b"aa", b"ab", b"ba", b"zz"):
        (word, _), _ = coder.encode(*lot(coder, [[name]]))
        k = int(np.diff(coder.word_code[0])[int(np.maximum(lot(coder, [[name]])[0][0], -1)) if name != b"zz" else coder.escape])
        one = mixmodel.Bits([s[:k] for s in word.slots], word.bit[:k], np.array([0, k]), mixmodel.WORDS)
        total += 2 ** -mixmodel.run(mixmodel.Mixer(), predictor, one)[0]
    assert total + 2**-end == pytest.approx(1, abs=1e-3)


def test_rare_nodes_keep_the_words_share():
    """What contexts don't predict of a path costs what the words' counts say."""
    words_ = [f"w{k:05d}".encode() for k in range(20_000)]
    coder = mixmodel.Coder(words_, [1 + 30_000 // (k + 1) for k in range(20_000)], 10, 10)
    own = np.array([*coder.counts, 10, 10], dtype=float)
    size = np.diff(coder.word_code[0])
    assert coder.tail.max() > 1 and size.max() <= 16 and coder.above.sum(axis=1).max() == own.sum()
    ptr, steps = coder.word_code
    share = coder.above / np.maximum(coder.above.sum(axis=1), 1)[:, None]
    cost = np.add.reduceat(-np.log2(share.reshape(-1)[steps]), ptr[:-1])
    assert np.allclose(2.0 ** -(cost + coder.tail), own / own.sum())


def test_counts_beyond_32_bits():
    """Sums are of 64 bits: a node that was passed five thousand million times keeps its odds and its trust."""
    coder = mixmodel.Coder([b"aa", b"ab"], [5 * 10**9, 10], 1, 4)
    assert coder.above.max() >= 5 * 10**9
    counts = [t.astype(np.uint64) for t in coder.empty_counts()]
    counts[0][:2] = 5 * 10**9, 1
    table = mixmodel.Predictor.of(coder.above, counts).tables[1]
    assert table[0] >> 2 == -127 and table[0] & 3 == 3


def test_weights_follow_short_documents():
    """A document's weights move within its first bits: predictors that are always wrong are trusted less and less."""
    n = 600
    stream = mixmodel.Bits([np.zeros(n, dtype=np.intp)] * 3, np.ones(n, dtype=np.uint8), np.array([0, 100, n]), mixmodel.WORDS)
    predictor = mixmodel.Predictor([np.full(1, (-24 << 2) + 3, dtype=np.int16)] * 6)
    short, long_ = mixmodel.run(mixmodel.Mixer(), predictor, stream)
    assert long_ / 500 < 0.8 * short / 100
    alone = mixmodel.Bits(stream.slots, stream.bit[:100], np.array([0, 100]), mixmodel.WORDS)
    assert mixmodel.run(mixmodel.Mixer(), predictor, mixmodel.Bits([s[:100] for s in alone.slots], alone.bit, alone.cut, alone.kind))[0] == pytest.approx(short)


def test_passages_follow_content():
    rng = np.random.default_rng(3)
    one, other = rng.integers(0, 500, 4000), rng.integers(0, 500, 300)
    codes = np.r_[one, other, one].astype(np.int32)
    doc, start, end, key, hashed = mixmodel.passages(codes, np.array([0, 4000, 4000, 4300 + 4000]))
    assert (end - start).max() <= mixmodel.LONGEST and (end > start).all() and set(doc) == {0, 2}
    for d, a, b in ((0, 0, 4000), (2, 4000, 8300)):
        own = doc == d
        assert start[own][0] == a + mixmodel.ANCHOR and end[own][-1] == b and (start[own][1:] == end[own][:-1]).all()
    first = set(zip(key[doc == 0], hashed[doc == 0]))
    assert len(first & set(zip(key[doc == 2], hashed[doc == 2]))) >= len(first) - 2
    assert all(len(x) == 0 for x in mixmodel.passages(np.zeros(3, dtype=np.int32), np.array([0, 3])))
    same = mixmodel.passages(np.zeros(5000, dtype=np.int32), np.array([0, 5000]))
    assert (same[2] - same[1]).max() <= mixmodel.LONGEST


def test_long_runs_take_few_bits():
    coder = mixmodel.Coder([b"aa", b"ab"], [5, 3], 1, 4)
    tries = [b"x" * 40, b"x" * 41, b"x" * 100_000, b"ab" * 50, b"y" + b"x" * 40, b"x" * 8]
    assert len({mixmodel.spelling(w) for w in tries}) == len(tries) and len(mixmodel.spelling(tries[2])) < 10
    assert coder.encode(*lot(coder, [[tries[2]]]))[0][1].cut[-1] < 200


def test_words_split_like_bytes(monkeypatch):
    """Arrow's words are those between ASCII white space, with A-Z in lower case and nothing else changed."""
    tries = ["A b\tC\n", None, "", " \x0b\x0c\r ", "\x1cx\u00a0Y\u2003\u00c4\x85 z", "  two  \x1f words"]
    found = list(mixmodel.tokens(pa.array(tries)))
    got = [w.encode() for words_, _ in found for w in words_.to_pylist()]
    assert got == [w for t in tries for w in (t or "").encode().translate(LOWER).split()]
    assert np.concatenate([per for _, per in found]).tolist() == [len((t or "").encode().split()) for t in tries]
    monkeypatch.setattr(mixmodel, "TEXT", 30)
    many = [f"Text {k} \u00e9 " * (k % 5) for k in range(50)]
    for column in (pa.array(many), pa.array(["x y", None, *many, "z"]).slice(2, 50)):
        found = list(mixmodel.tokens(column))
        assert len(found) > 20 and [w.encode() for words_, _ in found for w in words_.to_pylist()] == [w for t in many for w in t.encode().translate(LOWER).split()]


def test_repeated_passages_are_expected(spark):
    """A text that two training documents have costs less than one that is alone; a document doesn't expect itself."""
    rng = random.Random(13)
    data = [(k, " ".join(words(rng, "en", 300))) for k in range(60)]
    data += [(100, data[3][1]), (101, data[4][1] + " and more words"), (102, data[5][1])]
    table = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.bits_per_byte for r in lm.score_texts(table, F.col("doc_id") != 102, F.col("doc_id") == 102).collect()}
    alone = sorted(got[k] for k in range(6, 60))
    assert all(got[k] < 0.7 * alone[0] for k in (3, 100, 4, 101, 102)) and got[5] > 0.8 * alone[0]


def test_documents_do_not_expect_themselves(spark):
    """What is expected at each place, by counting all other training texts; a key or a passage may recur in a text."""
    rng = random.Random(29)
    texts = [(row, rng.random() < 0.8, [rng.randrange(12) for _ in range(size)]) for row, size in enumerate([0, 1, 2, 3, 5, 8, 13, 21, 2, 3, 4, 1])]
    texts = [(row, learn, keys, [k if rng.random() < 0.5 else rng.randrange(3) for k in keys]) for row, learn, keys in texts]
    texts += [(100, True, [50, 51, 50, 50], [7, 7, 7, 8]), (101, True, [60, 60, 60], [9, 9, 8]), (102, True, [60], [8]), (103, False, [50, 50], [7, 6])]
    table = spark.createDataFrame(texts, "row long, learn boolean, keys array<long>, hashes array<long>")
    got = {r.row: r.told for r in lm.told(table).collect()}
    pairs = Counter((k, h) for _, learn, keys, hashes in texts if learn for k, h in zip(keys, hashes))
    best = {}
    for (k, h), n in pairs.items():
        best[k] = max(best.get(k, (0, 0)), (n, h))
    wanted = []
    first = np.cumsum([0, *[len(t[2]) for t in texts]])
    for number, (row, learn, keys, hashes) in enumerate(texts):
        own = Counter(zip(keys, hashes))
        for place, (k, h) in enumerate(zip(keys, hashes)):
            if k in best:
                n, e = best[k]
                n -= own[k, e] if learn else 0
                if n > 0:
                    wanted.append((int(first[number]) + place, 0 if n == 1 else 1 if n < 4 else 2, int(h == e)))
    found = [np.array(got.get(t[0], ()), dtype=np.int64) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(t[2]) for t in texts])
    key = np.array([k for t in texts for k in t[2]], dtype=np.int64).view(np.uint64)
    assert list(zip(*(x.tolist() for x in lm.elsewhere(found, first, doc, key)))) == wanted
    alone = {int(first[k]) + p for k, t in enumerate(texts) for p in range(len(t[2])) if t[0] == 100}
    assert len(wanted) > 20 and not alone & {w[0] for w in wanted}
    assert all(len(x) == 0 for x in lm.elsewhere([np.zeros(0, dtype=np.int64)], np.array([0, 0]), doc[:0], key[:0]))


# Toxicity


def test_automaton_is_edit_distance():
    terms = [("loser", 1), ("trash", 1), ("scum", 0), ("vequ*", 0)]
    machine = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
        return out

    rng = random.Random(9)
    pool = [*"losertahcumvqé", ""]
    tries = ["".join(rng.choice(pool) for _ in range(rng.choice([3, 4, 5, 6]))) for _ in range(3000)] + ["loser", "losr", "loosers", "closer", "trsh", "scun", "scum", "vequxyz", "vequ", "veq", "x" * 60]
    got = machine.match(tries)
    for w in tries:
        expected = any((w.startswith(t[:-1]) if t.endswith("*") else distance(w, t) <= e) for t, e in terms)
        assert (w in got) == expected, w


def test_toxicity(spark, empty):
    rng = random.Random(10)
    data, labels = [], []
    for i in range(600):
        ws, bad = words(rng, "en", 40), rng.random() < 0.2
        if bad:
            ws[rng.randrange(40)] = rng.choice(["idiot", "moron", "trash", "you"])
            ws[rng.randrange(40)] = rng.choice(["idiot", "moron", "trash"])
        data.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    data += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "you idiiot", "en", "s", 0), (None, "moron", "en", "s", 0)]
    labels += [(0, 1, None), (None, 1, 1), (1, 1, labels[1][2])]
    table = spark.createDataFrame(data, DOCS).withColumn("predicted", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = langid.remainder("doc_id", 5) == 0
    got = {r.doc_id: r for r in toxicity.score_toxicity(table, marks, ~held).collect()}
    truth = {i: t for i, _, t in labels if t is not None and i is not None}
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == truth[i] for i in test) >= 0.97 * len(test)
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 1 and got[None].predicted == 1
    assert {r.score for r in toxicity.score_toxicity(table, marks.limit(0), F.lit(True)).collect()} == {0.5}
    assert toxicity.score_toxicity(empty, marks, ~held).count() == 0


def test_long_foreign_and_many_terms():
    """Terms of any length and script are met, whole words are read, and every term may be misspelled."""
    long_ = "".join(random.Random(3).choice("abcdefgh") for _ in range(40))
    terms = [(long_, 1), ("\u5927\u99ac\u9e7f\u9a8f\u9a6c", 1), ("\ud55c\uad6d*", 0), *[(f"{a}{b}term{c}", 1) for a in "qwrtz" for b in "psdfg" for c in "hjklyxcv"]]
    machine = toxicity.Automaton(terms)
    tries = [long_, long_[:-1], long_ + "x", long_ + "xy", long_[:25], "\u5927\u99ac\u9e7f\u9a8f\u9a6c", "\u5927\u99ac\u9e7f\u9a6c", "\u5927\u9a6c", "\ud55c\uad6d\uc5b4" * 30, "zgtermv", "zgterm", "zggermv", "zg"]
    assert [w in machine.match(tries) for w in tries] == [True, True, True, False, False, True, True, False, True, True, True, True, False]
    assert toxicity.learn_terms([("rare", 12, 0), ("rarer", 2, 0), ("often", 300, 3000)], 5000, 40_000)[0][0] == "rare"


def test_quotation_weighs_less():
    lexicon = toxicity.Lexicon.of([("moron", 5.0)])
    said, meant = lexicon.features([b'he said "what a moron" to her', b"what a moron you are"])
    assert said[6] < meant[6] and said[3] > 0 and meant[3] == 0 and meant[4] > 0


# Media


def test_media_round_trip(spark, empty):
    rng = random.Random(11)
    big = " ".join(words(rng, "en", 20_000))
    data = [(1, None), (2, ""), (3, "x"), (4, "é" * 32), (5, big), (6, big), (7, big[:30_000] + "changed" + big[30_000:]), (8, "y" * 64), (8, "y" * 64), (9, "z" * 50_000), (None, "x")]
    table = spark.createDataFrame(data, "doc_id long, text string").withColumn("media", F.lit(1))
    got = media.media_column(table).collect()
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in data)
    text = {d[0]: (d[1] or "").encode() for d in data}
    for r in got:
        raw = text[r.doc_id]
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44 and r.media_sha256 == hashlib.sha256(media.to_media(raw)[1]).hexdigest()
    assert media.media_column(empty).count() == 0
    rows, once = media.store(table.select("doc_id", "text"))
    kept = once.agg(F.count("*"), F.count_distinct("digest")).first()
    assert kept[0] == kept[1] and rows.where("doc_id in (5, 6) and pack is not null").count() == 0  # copies are stored once


def test_cuts_follow_content():
    rng = random.Random(12)
    a = bytes(rng.randrange(256) for _ in range(60_000))
    b = a[:20_000] + b"inserted" + a[20_000:]
    one, two = ({media.digest(c) for c in media.chunks(x)} for x in (a, b))
    assert b"".join(media.chunks(a)) == a and len(one & two) >= len(one) - 3
    sizes = [len(c) for c in media.chunks(a)]
    assert max(sizes) <= media.MOST and min(sizes[:-1]) >= media.LEAST


# HTML


def page(k, body, host="h.example.com"):
    return (k, f"https://{host}/p/{k}", f'<html><head><title>T{k}</title></head><body><div class="top-menu"><a href=1>A</a><a href=2>B</a></div><div id="wrap">{body}</div><p>All rights of {host}</p><footer>f {k}</footer></body></html>')


def test_main_text(spark):
    data = [page(k, f"<h1>Title {k}</h1><p>Body &amp; text<br>of <b>pa</b>ge\n\n {k}<p>second {k}<script>var a='<p>no</p>'</script><!-- <p>no --><aside>no</aside><form>no</form><ul class=comments><li>no</ul>") for k in range(8)]
    data += [(50, None, None), (51, "not a url", ""), (52, "https://x.example.org", "<p>alone &lt;3"), (53, None, "no tags   at all"), (52, "https://x.example.org", "<p>alone &lt;3"), (54, "http://y", "<script>never closed")]
    table = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for rows in (html.BROADCAST_ROWS, -1):
        got = html.extract(table, broadcast_rows=rows).collect()
        text = {r.page_id: r.text for r in got}
        assert len(got) == len(data)
        assert text[3] == "Title 3 Body & text of page 3 second 3"  # the repeated line on rights is the template's
        assert (text[50], text[51], text[52], text[53], text[54]) == ("", "", "alone <3", "no tags at all", "")
    assert html.extract(table.limit(0)).count() == 0


def test_articles_stay_whole(spark):
    article = "<article><p>the same words</p><p>and more</p></article>"
    plain = "<p>{0}a</p><p>{0}b</p>"
    data = [page(k, "<p>a copied</p><p>text</p>", "copies") for k in range(40)] + [page(100 + k, plain.format(k), "copies") for k in range(7)]
    data += [page(200 + k, f"{article}<p>read on day {k}</p>", "near") for k in range(9)]
    data += [page(300 + k, f"<article><p>see {k}</p><ul><li><a href=1>linked {k}</a></ul><table><tr><td><a href=2>cell {k}</a></table></article>", "lists") for k in range(9)]
    data += [page(400 + k, f'<div class="no-sidebar page-with-menu"><p>text {k}</p></div>', "layout") for k in range(9)]
    data += [page(500 + k, f'<div class="sidebar left"><article><p>inner {k}</p></article><p>bar {k}</p></div>', "wrapper") for k in range(9)]
    data += [page(600 + k, f'<article>own {k}</article><div class=related><article>other {k}</article></div>', "related") for k in range(9)]
    data += [page(700 + k, f'<p>body {k}</p><div class=related><article>other {k}</article></div>', "both") for k in range(9)]
    table = spark.createDataFrame(data + data[:5], "page_id long, url string, html string")
    got = html.extract(table).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(data) + 5
    assert {text[k] for k in range(40)} == {"a copied text"} and text[103] == "3a 3b"
    assert text[203] == "the same words and more" and text[304] == "see 4 linked 4 cell 4"
    assert text[402] == "text 2" and text[502] == "inner 2" and text[602] == "own 2" and text[702].startswith("body 2")


def plain_classes(bodies):
    """Brute force: the tokens of pages by their whole occurrence vectors."""
    found = [html.parse(b) for b in bodies]
    vectors = {}
    for t in set().union(*(p.tokens for p in found)):
        vectors.setdefault(tuple(p.tokens[t] for p in found), set()).add(t)
    return found, vectors


def test_classes_are_brute_force(spark):
    """Tokens have equal sums of hashes where their whole vectors are equal, and the valid classes make the template."""
    rng = random.Random(5)
    bodies = [f"<body><div class=x><p>{k}</p></div>" + "<i>s</i><section><p>q</section>" * rng.randrange(3) + "<ul><li>a<li>b</ul>" * (k % 2) + f"<div><p>{k} w</p><p>same</p></div>" for k in range(12)]
    found, vectors = plain_classes(bodies)
    rows = html.page_tokens(spark.createDataFrame([(1, b) for b in bodies], "host long, html string")).where("token != 0")
    got = rows.groupBy("token").agg(F.bit_xor(F.xxhash64("body", "number")).alias("v"), F.count("*").alias("n"), F.sum("number").alias("m")).collect()
    by = {}
    for r in got:
        by.setdefault((r.v, r.n, r.m), set()).add(r.token)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, vectors.values()))
    host = html.templates(spark.createDataFrame([(1, b) for b in bodies], "host long, html string")).first()
    often = {v: c for v, c in vectors.items() if sum(x > 0 for x in v) >= 6 and len(c) > 1}
    places = {t for p in found for t in p.holds}
    parent = {t: up for p in found for t, up in p.parents.items()}
    inside = {t for c in often.values() for t in c if t in places}

    def nested(t):
        return not t or (t in inside and nested(parent[t]))

    assert set(host.repeated) == {t for c in often.values() for t in c if t not in places and any(nested(x) for x in c if x in places) and nested(parent[t])}
    assert len(host.repeated) >= 2


def named_pages(rng, host, k, names):
    """A page without any telling element or, where names are random, name; and its article."""
    text = [" ".join(words(rng, "en", rng.choice([8, 20, 40]))) for _ in range(rng.choice([2, 4]))]
    title = " ".join(words(rng, "en", 5))
    said = "".join(f"<div class={names['one']}><b>u{rng.randrange(99)}</b><p>{' '.join(words(rng, 'en', 6))}</p></div>" for _ in range(rng.choice([1, 3, 5])))
    body = (
        f"<div class={names['menu']}>" + "".join(f"<a href={j}>{w}</a> " for j, w in enumerate(("home", "news", "all of it"))) + f"</div><div class={names['ad']}>{' '.join(words(rng, 'fr', 5))}</div>"
        f"<div class={names['text']}><h1>{title}</h1>" + "".join(f"<p>{t}</p>" for t in text) + f"</div><div class={names['said']}>{said}</div><div class={names['end']}>{host} {k}</div>"
    )
    return f"<html><head><title>x</title></head><body>{body}</body></html>", " ".join([title, *text])


def test_templates_decide(spark):
    """With random class names on half of the hosts the article is still found, and it is not found without templates."""
    rng, data, truth = random.Random(6), [], {}
    for h in range(8):
        plain = {"menu": "menu", "ad": "ad", "text": "content", "one": "comment", "said": "comments", "end": "footer"}
        names = {n: f"z{rng.randrange(10**6)}" for n in plain} if h % 2 else plain
        for k in range(12):
            source, truth[100 * h + k] = named_pages(rng, f"h{h}", k, names)
            data.append((100 * h + k, f"https://h{h}.example.com/{k}", source))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    hit = sum(sum((Counter(got[k].split()) & Counter(t.split())).values()) for k, t in truth.items())
    assert hit / sum(len(t.split()) for t in truth.values()) > 0.95 and hit / sum(len(got[k].split()) for k in truth) > 0.95
    without = {k: html.main_text(source) for k, _, source in data}
    odd = [k for k in truth if k // 100 % 2]
    assert sum(without[k] != got[k] for k in odd) == len(odd) and sum(got[k] == truth[k] for k in odd) > 0.9 * len(odd)


def test_names_of_inline_elements_and_articles(spark):
    assert html.main_text("<p>one <span class=ad>buy <span>it</span> now</span> two</p>") == "one two"
    assert html.main_text('<article class="post topic-privacy"><p>text</p></article>') == "text"
    assert html.main_text('<div><p>text here</p></div><article class="comment-body"><p>no</p></article>') == "text here"


def test_repeated_articles_stay(spark):
    """An article on three of a host's four pages, with different surroundings, is text on all of them."""
    data = [(k, f"http://few/{k}", f"<body><div><p>{'the long story of this page' if k else 'another one here'}</p></div><footer>{k}</footer></body>") for k in range(4)]
    data += [(10 + k, f"http://some/{k}", f"<body><div><p>{'the long story of this page' if k else 'another one here'}</p><p>at {k}</p></div></body>") for k in range(4)]
    text = {r.page_id: r.text for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert text[1] == text[3] == "the long story of this page" and text[12] == "the long story of this page at 2"


# Licences


def test_licenses(spark, empty):
    data = [
        (1, "code\nLicensed under the Apache License, Version 2.0.\nmore", "a/b/c.txt"), (2, "nothing", "a/b/d.txt"), (3, "Released under the MIT License.", "a/LICENSE"), (4, "plain", "a/b/e/f.txt"), (5, None, "a/x"), (6, "", "z/y"),
        (7, "nothing", None), (8, "We licensed nothing like a licence of the public sort here, said the very long line of other words.", "a/q.txt"), (9, "All rights reserved.", "top.txt"), (2, "nothing", "a/b/d.txt"),
    ]
    table = spark.createDataFrame(data, "doc_id long, text string, path string").withColumn("license", F.lit("clash"))
    for rows in (licenses.BROADCAST_ROWS, -1):
        got = licenses.inherit(licenses.scan(table, keep=("doc_id",)), keep=("doc_id",), broadcast_rows=rows).collect()
        by = {r.doc_id: (r.license, r.origin, r.inherited_from) for r in got}
        assert len(got) == len(data)
        assert by[1] == ("Apache-2.0", "header", None) and by[3] == ("MIT", "file", None) and by[9] == ("Proprietary", "file", None)
        assert by[2] == by[4] == by[5] == ("MIT", "inherited", "a/LICENSE") and by[8][1] == "inherited"
        assert by[6] == ("Proprietary", "inherited", "top.txt") and by[7] == (None, "none", None)
    assert licenses.license_scan(table.limit(0), keep=("doc_id",)).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_real_notices(spark):
    cases = {
        "    GNU GENERAL PUBLIC LICENSE\n       Version 3, 29 June 2007": "GPL-3.0",
        "# SPDX-License-Identifier: Apache-2.0\nimport os": "Apache-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD-2-Clause",
        "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n */": "Apache-2.0",
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "GPL-3.0",
        MIT_TEXT: "MIT",
        "SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1",
        "We publish our results and license nothing to the general public.": None,
    }
    rows = spark.createDataFrame([(k, t, f"d/{k}.txt") for k, t in enumerate(cases)], "doc_id long, text string, path string")
    got = {r.doc_id: r for r in licenses.scan(rows, keep=("doc_id",)).collect()}
    assert [got[k].license for k in range(len(cases))] == list(cases.values())
    assert got[6].is_file and not got[1].is_file


def test_needed_terms_lose_nothing():
    """No template's share outside the needed terms comes to the cosine."""
    needed = set(licenses.needed_terms())
    assert all(sum(x * x for t, x in v.items() if t not in needed) < licenses.COSINE**2 for _, v in licenses.template_vectors()[2])


def test_native_operators_have_no_python(spark, sf):
    for name in (lines.op3_line_dedup, licenses.op7_licenses):
        plan = name(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_schema_types(spark):
    assert isinstance(T._parse_datatype_string(media.MANIFEST), T.StructType)
