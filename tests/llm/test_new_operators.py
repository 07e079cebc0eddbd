"""Token files, Lloyd clustering and the filter audit: awkward rows, and every figure against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demandry.llm import audit, lloyd, tokens
from tests.llm.test_operators import DOCS, corpus

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


# Token files


def test_pieces_encode_as_whole_texts(plain):
    rng = random.Random(1)
    letters = "ab cd'  \n\n\t\r.,!-_(\"12\xe9\xdf\xb2\xbd€“’\x85\xa0 　\x00\x1c\x1f\x0b\x0c中\U0001f600́sdmtrevl<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", "x" * 5000, "<|endoftext|>", "<|endoftext|> a<|endoftext|>", " ", "\n\n"]
    encode = tokens.Encoder(open(BPE, encoding="utf-8").read())
    assert encode.by_piece
    for _ in range(2):  # the second time from what was remembered
        got = [row for ids, counts in encode(pa.array(texts), 7) for row in np.split(ids, np.cumsum(counts)[:-1])]
        assert [g.tolist() for g in got] == [[*plain(t), 7] for t in texts]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, whole = tokens.Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    assert not encode.by_piece
    texts = ["Hello there,  World", None, ""]
    got = [row.tolist() for ids, counts in encode(pa.array(texts), 1) for row in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def expected_tokens(rows, plain):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain(text), 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_by_brute_force(spark, docs, plain):
    clash = docs.select("*", *[F.lit(-1).alias(c) for c in ("id", "row", "part", "at", "start", "file", "place", "n_tokens")])
    got = tokens.token_files(clash, BPE)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([tuple(r) for r in got.collect()], key=order) == sorted(expected_tokens([(r[0], r[1]) for r in corpus()], plain), key=order)


def test_token_files_of_empty_tables_and_string_ids(spark, plain):
    assert tokens.token_files(spark.createDataFrame([], DOCS), BPE).collect() == []
    rows = [("b", "one two"), ("a", None), ("c", "three")]
    got = tokens.token_files(spark.createDataFrame(rows, "doc_id string, text string"), BPE).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start) for r in got] == [("a", 0), ("b", 1), ("c", 2 + len(plain("one two")))]


def test_sequences_and_masks_hold_all_ids(spark, docs, plain, tmp_path):
    folder = f"file://{tmp_path}"
    index = tokens.write_tokens(docs, folder, BPE, length=64, file_ids=3000)
    rows = tokens.sequences(spark, index, folder).orderBy("file", "sequence").collect()
    assert {len(r.ids) for r in rows} == {len(r.mask) for r in rows} == {64}
    assert len({r.file for r in rows}) > 4
    real = [i & 0xFFFF for r in rows for i, m in zip(r.ids, r.mask, strict=True) if m]
    by_key = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter(real) == Counter(i for r in by_key for i in [*plain(r[1]), 0])
    # A sequence of a file by its number, and ids across sequences by their place, without what comes before.
    name = Counter(r.file for r in rows).most_common(1)[0][0]
    file = tokens.SequenceFile(*[x if k == 0 else f"{x}/{name}" for k, x in enumerate(tokens.open_folder(folder))])
    own = [r for r in rows if r.file == name]
    ids, mask = file.sequence(len(own) - 1)
    assert ids.tolist() == own[-1].ids and mask.to_pylist() == own[-1].mask
    flat = [i for r in own for i in r.ids]
    assert len(flat) > 300 and file.run(50, 200).tolist() == flat[50:250]
    with pytest.raises(ValueError, match="not in the file"):
        file.run(len(flat) - 1, 2)


def test_op11_on_the_given_table(spark, sf, plain):
    from demandry.llm.tokens import op11_tokens

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op11_tokens(spark, sf).collect()) == expected_tokens(rows, plain)


# Lloyd


def plain_lloyd(rows, clusters=8, rounds=10):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    q = [(i, [math.floor(c * 1024) if abs(c) < 2**53 else int(c) * 1024 for c in v]) for i, v in kept]
    cents = [v for i, v in sorted(q, key=lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents)) for _, v in q]

    for _ in range(rounds):
        own = assign()
        for k in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(q, own, strict=True) if c == k]
            if mine:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    per = Counter()
    for d, c in own:
        per[c] += d
    fits = lambda n: n if n < 2**63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, fits(d), fits(per[c]), fits(sum(per.values())), names[c]) for (i, _), (d, c) in zip(q, own, strict=True)]


def vectors(n=120, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(k % 5, 0.4) if k < 8 else rng.random() for k in range(64)]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.5] * 63), (n + 2, [0.5] * 63 + [None]), (n + 3, [0.5] * 63 + [float("nan")]), (n + 4, [0.5] * 63 + [float("inf")]), (n + 5, [])]
    return rows + [rows[4], rows[4], (None, [0.25] * 64)]


ROW = "vec_id long, embedding array<float>, label int, cluster int, id int, digit int"


def as_table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 0, -1, -1, -1) for i, v in rows], ROW)


def got_rows(df):
    key = lambda r: tuple((x is not None, x or 0) for x in r[:3])
    return sorted([tuple(r) for r in df.collect()], key=key)


def wanted_rows(rows, **how):
    key = lambda r: tuple((x is not None, x or 0) for x in r[:3])
    return sorted(plain_lloyd([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], **how), key=key)


def test_lloyd_by_brute_force(spark):
    rows = vectors()
    assert got_rows(lloyd.cluster(as_table(spark, rows).repartition(3))) == wanted_rows(rows)


def test_lloyd_counts_any_size_exactly(spark):
    rng = random.Random(5)
    rows = vectors(40) + [(500 + i, [rng.choice([1e6, -3e9, 1.5e30, 0.1]) for _ in range(64)]) for i in range(12)]
    got = got_rows(lloyd.cluster(as_table(spark, rows), rounds=3))
    assert got == wanted_rows(rows, rounds=3)
    assert any(r[2] is None for r in got) and any(r[2] is not None for r in got)


def test_lloyd_of_few_and_no_vectors(spark):
    few = [(1, [0.1] * 64), (2, [0.9] * 64), (3, [0.9] * 64)]
    assert got_rows(lloyd.cluster(as_table(spark, few))) == wanted_rows(few)
    none = lloyd.cluster(as_table(spark, [(1, None)]))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ties_go_to_the_smaller_cluster():
    which, far = lloyd.nearest(np.array([[2, 2]], dtype=np.int64), [[9, 9], [1, 2], [2, 1]])
    assert which.tolist() == [1] and far.tolist() == [1]


@pytest.mark.parametrize("values", [[0, 0], [5, -7], [2**26, -(2**26)], [3 * 2**80 + 1, -(2**140) - 9]])
def test_digits_add_up(values):
    total = [0] * len(values)
    for place, part in lloyd.digits(values):
        assert all(abs(d) < 2**26 for d in part)
        total = [t + (d << 26 * place) for t, d in zip(total, part, strict=True)]
    assert total == values


# Filter audit


def plain_audit(rows, labels):
    def fails(text):
        ws = [w for w in text.encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if w]
        caps = sum("A" <= c <= "Z" for c in text)
        return {f for f, bad in zip("ABCD", (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * caps > 3 * len(text), any(c in "#$%&*|" for c in text)), strict=True) if bad}

    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    known = []
    for i, text, part in rows:
        own = fails(text or "")
        low = least.get(text or "")
        if low is not None and (i is None or i > low):
            own.add("E")
        known.append((part or "", own, i in good, i in toxic))
    out = {}
    for part in {k[0] for k in known}:
        mine = [k for k in known if k[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone, now = set(order[: step - 1]), [k for k in mine if f in k[1]]
                removed = [k for k in now if not k[1] & gone]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [sum(not k[1] & (gone | {f}) for k in mine), len(removed), len(now) - len(removed), sum(k[1] == {f} for k in mine), sum(k[2] for k in removed), sum(k[3] for k in removed), f]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]]
    return out


def audit_rows():
    rng, rows = random.Random(2), []
    for i in range(90):
        pool = [f"w{k}" for k in range(rng.choice([30, 400]))]
        text = " ".join(rng.choice(pool) for _ in range(rng.choice([0, 5, 199, 200, 450])))
        rows.append((i, rng.choice(["", "A", "# "]) + text + rng.choice(["", " THE END " * 20, "\x0b|"]), rng.choice(["en", "fr", None])))
    rows += [(200 + k, rows[3][1], rng.choice(["en", "fr"])) for k in range(30)] + [rows[3], rows[3], (7, "other text", "en"), (None, rows[3][1], "fr"), (None, "only of null ids", "en"), (None, "only of null ids", "en"), (300, None, "en"), (301, "", "xx"), (302, "Z" * 3 + "z" * 97, "en"), (303, "Z" * 4 + "z" * 96, "en"), (304, " ".join(["w"] * 100_000), "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def test_audit_by_brute_force(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, -1, -1, -1) for r in rows], "doc_id long, text string, lang string, x int, n int, fails int").repartition(5)
    rated = spark.createDataFrame([(*r, "extra") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = audit.audit(docs, rated).collect()
    assert len({r.filter_order for r in got}) == 120 and len(got) == 600 * len({r.part for r in got})
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == plain_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "one", "en")], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.where("false"), labels).collect() == []
    got = audit.audit(docs, labels)
    assert got.count() == 600 and got.where("good_lost + toxic_lost > 0").count() == 0
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
