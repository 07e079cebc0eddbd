"""Scoring documents with the context-mixing language model: Spark counts the corpus and scores every text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import mixmodel as model
from .common import materialise
from .langid import remainder

#: Words that a task counts before it passes them on; slots in a row of partial counts.
HELD_WORDS, BLOCK = 400_000, 4096
#: What stands for the end of a text among the words.
END = b""
#: Share of all passages from which a key is a heavy one: there are at most as many of these as the inverse.
HEAVY = 1e-4
#: Largest number of times that a passage is told to have been seen, in 30 bits.
SEEN = (1 << 30) - 1


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) of all words of the training texts (column text), and of END for their ends."""

    def merged(seen: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(seen).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, ends = [], 0, 0
        for part in parts:
            for words, per in model.tokens(part.column(0)):
                found = pc.value_counts(words.cast(pa.large_binary()))
                seen.append(pa.table([found.field(0).cast(pa.binary()), found.field(1)], ["word", "c"]))
                held += len(found)
                ends += len(per)
                if held > HELD_WORDS:
                    seen = [merged(seen)]
                    held = len(seen[0])
                    if held > HELD_WORDS // 2:
                        yield from seen[0].combine_chunks().to_batches()
                        seen, held = [], 0
        if seen or ends:
            yield from merged([*seen, pa.table([pa.array([END], type=pa.binary()), pa.array([ends], type=pa.int64())], ["word", "c"])]).combine_chunks().to_batches()

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


NUMBERED = "row long, learn boolean, held_out boolean, n_words long, n_bytes long, codes binary, rare binary, keys array<long>, hashes array<long>"


def numbered(own: DataFrame, coder) -> DataFrame:
    """The texts as numbers of words: one row of NUMBERED, and the id, for each row of own (id, text, learn, held_out)."""
    kind = dict(own.dtypes)["id"]
    signed = lambda v: v.view(np.int64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for part in parts:
            at = 0
            for words, per in model.tokens(part.column(1)):
                many, cut = len(per), np.r_[0, np.cumsum(per)]
                size = np.asarray(pc.binary_length(words), dtype=np.int64)
                n_bytes = np.diff(np.r_[0, np.cumsum(size)][cut]) + per
                codes, places, rare = coder.value.numbers(words)
                doc, _, _, key, hashed = model.passages(codes, cut)
                first = np.searchsorted(doc, np.arange(many + 1)).astype(np.int32)
                lists = lambda v, f=first: pa.ListArray.from_arrays(pa.array(f), pa.array(signed(v)))
                whose = np.searchsorted(places, cut)
                # Bytes of the same weight lie together, which compresses better.
                packed = [pa.compress(codes[a:b].view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                spelled = [b" ".join(rare[a:b]) for a, b in zip(whose[:-1].tolist(), whose[1:].tolist(), strict=True)]
                some = lambda i, a=at, m=many: part.column(i).slice(a, m)
                yield pa.RecordBatch.from_arrays(
                    [some(0), pa.array(np.arange(number, number + many)), some(2), some(3), pa.array(per, type=pa.int64()), pa.array(n_bytes), pa.array(packed, type=pa.binary()), pa.array(spelled, type=pa.binary()), lists(key), lists(hashed)],
                    ["id", "row", "learn", "held_out", "n_words", "n_bytes", "codes", "rare", "keys", "hashes"],
                )
                number += many
                at += many

    return own.select("id", "text", "learn", "held_out").mapInArrow(run, f"id {kind}, {NUMBERED}")


def lots(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[list[bytes]]]]:
    """(first row, codes, cuts between documents, rare words of each) of numbered texts, in lots of bounded size."""
    packed, spelled = part.column("codes").to_pylist(), part.column("rare").to_pylist()
    sizes = np.asarray(part.column("n_words"), dtype=np.int64).tolist()
    k = 0
    while k < len(packed):
        first, some, many = k, [], 0
        while k < len(packed) and (k == first or many + sizes[k] + len(spelled[k]) <= model.TOKENS):
            raw = pa.decompress(packed[k], decompressed_size=4 * sizes[k], codec="zstd", asbytes=True) if sizes[k] else b""
            some.append(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T.copy().view(np.int32).reshape(-1))
            many += sizes[k] + len(spelled[k])
            k += 1
        yield first, np.concatenate(some), np.r_[0, np.cumsum([len(x) for x in some])], [s.split() for s in spelled[first:k]]


def add_bit_counts(texts: DataFrame, coder, tables: list[np.ndarray]) -> None:
    """Adds the bit counts of numbered texts to the tables, which hold 64-bit integers. Tasks count into tables of a fixed size, of which
    blocks are summed by their place while they stream by, so that no task or group grows with the corpus."""
    width = 2 * BLOCK

    def row(number: int, block: int, counts: np.ndarray) -> tuple[int, int, bytes]:
        return number, block, pa.compress(counts.view(np.uint8).reshape(width, -1).T.tobytes(), "zstd", asbytes=True)

    def unpack(packed: bytes, kind) -> np.ndarray:
        each = np.dtype(kind).itemsize
        return np.frombuffer(pa.decompress(packed, decompressed_size=width * each, codec="zstd", asbytes=True), dtype=np.uint8).reshape(each, -1).T.copy().view(kind).reshape(-1)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        number, block, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(number, type=pa.int32()), pa.array(block, type=pa.int32()), pa.array(counts, type=pa.binary())], ["number", "block", "counts"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counted = coder.value.empty_counts(), 0
        for part in parts:
            for _, codes, cut, rare in lots(part):
                streams, _ = coder.value.encode(codes, cut, rare)
                model.count(own, streams)
                counted += sum(len(s.bit) for s in streams)
                if counted > 1 << 31:  # no count has reached the 32 bits that it has
                    yield from flush(own)
                    own, counted = coder.value.empty_counts(), 0
        yield from flush(own)

    def flush(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(own):
            blocks = table.reshape(-1, width)
            used = np.flatnonzero(blocks.any(axis=1))
            for k in range(0, len(used), 256):
                yield out([row(number, int(b), blocks[b]) for b in used[k : k + 256]])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for part in parts:
            for number, block, packed in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                counts = unpack(packed, np.uint32)
                if (number, block) in sums:
                    sums[number, block] += counts
                else:
                    sums[number, block] = counts.astype(np.uint64)
        yield out([row(*k, v) for k, v in sums.items()])

    kind = "number int, block int, counts binary"
    merged = texts.select("codes", "rare", "n_words").mapInArrow(run, kind).repartition("number", "block").mapInArrow(merge, kind)
    for number, block, packed in merged.toLocalIterator():
        tables[number].reshape(-1, width)[block] += unpack(packed, np.uint64)


def expected_passages(texts: DataFrame) -> tuple[DataFrame, float]:
    """(key, hash, n) of the passage that most often follows a key's words in the training texts, and the number of all.

    Passages are counted exactly, by 64-bit hashes, in a table that grows with the corpus and stays spread.
    """
    every = texts.where("learn").select(F.explode(F.arrays_zip("keys", "hashes")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.hashes").alias("hash"))
    best = every.groupBy("key", "hash").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "hash")).alias("best"), F.sum("n").alias("seen"))
    found = materialise(best.select("key", "best.hash", "best.n", "seen"), "passages")
    return found, float(found.agg(F.sum("seen")).first()[0] or 0)


def told(texts: DataFrame) -> DataFrame:
    """(row, told): for the rows with expected passages, 2^32 * place + 4 * seen + 2 * learn + hit of each, where place counts
    the row's passages, seen says how often the training texts have the expected one (up to SEEN), learn whether the row is
    one of them, and hit whether the expected one follows. `elsewhere` takes off what a training document has itself.

    Keys that many passages share are joined by broadcast, as they are few; the others by a shuffle.
    """
    known, total = expected_passages(texts)
    own = texts.select("row", "learn", F.posexplode(F.arrays_zip("keys", "hashes")).alias("place", "p")).select("row", "learn", "place", F.col("p.keys").alias("key"), F.col("p.hashes").alias("own"))
    heavy = F.broadcast(known.where(F.col("seen") > HEAVY * total).select("key", F.col("hash").alias("h"), F.col("n").alias("m")))
    split = own.join(heavy, "key", "left")
    light = split.where("h is null").select("row", "learn", "place", "key", "own").join(known.where(F.col("seen") <= HEAVY * total).hint("merge"), "key")
    both = light.select("row", "learn", "place", "own", "hash", "n").unionByName(split.where("h is not null").select("row", "learn", "place", "own", F.col("h").alias("hash"), F.col("m").alias("n")))
    packed = F.col("place").cast("long") * (1 << 32) + F.least("n", F.lit(SEEN)) * 4 + F.col("learn").cast("int") * 2 + (F.col("own") == F.col("hash")).cast("int")
    return both.select("row", packed.alias("told")).groupBy("row").agg(F.array_sort(F.collect_list("told")).alias("told"))


def elsewhere(found: list[np.ndarray], first: np.ndarray, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, step, hit) of the passages of a lot for which other texts expect one: step says how often they have it (once,
    up to three times, more). found is the documents' `told`, first the number of each document's first passage, doc and key
    those of all passages.

    A training document doesn't count itself: every place of it that has the expected passage is taken off, at hits as at
    places where something else follows the same key. So what it alone has is expected nowhere, however often it has it.
    """
    every = np.concatenate([np.zeros(0, dtype=np.int64), *found])
    at = np.repeat(first[: len(found)], [len(f) for f in found]) + (every >> 32)
    hit, learn, seen = every & 1, (every >> 1) & 1, (every >> 2) & SEEN
    order = np.lexsort((key[at], doc[at]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(doc[at][order]) != 0) | (np.diff(key[at][order]) != 0)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    itself = np.bincount(group, weights=hit).astype(np.int64)[group] if len(order) else group
    left = seen - learn * itself
    step = np.where(left == 1, 0, np.where(left < 4, 1, 2))
    return at[left > 0], step[left > 0], hit[left > 0]


def price(coder, mixer: model.Mixer, predictor, codes: np.ndarray, cut: np.ndarray, rare: list, expected: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list]:
    """(bits of the words and flags, bits of the spelled words, the rare words that were coded) of the documents of a lot."""
    many = len(cut) - 1
    doc, start, end, key, _ = model.passages(codes, cut)
    at, step, hit = elsewhere(expected, np.searchsorted(doc, np.arange(many + 1)), doc, key)
    rows = np.split(np.c_[hit, step], np.searchsorted(doc[at], np.arange(1, many)))
    hidden = np.zeros(len(codes) + 1, dtype=np.int32)
    hidden[start[at[hit == 1]]] += 1
    hidden[end[at[hit == 1]]] -= 1
    hidden = np.cumsum(hidden[:-1]) > 0
    if hidden.any():
        at = np.flatnonzero(codes < 0)
        whose = np.searchsorted(at, cut)
        rare = [[w for w, t in zip(r, hidden[at[a:b]].tolist(), strict=True) if not t] for r, a, b in zip(rare, whose[:-1], whose[1:], strict=True)]
    streams, tails = coder.encode(codes, cut, rare, hidden)
    word, byte, flag = (model.run(mixer, predictor, s) for s in (*streams, model.flags(rows)))
    return word + tails + flag, byte, rare


SCORED = "row long, held_out boolean, n_tokens long, n_known long, logs double, word_bits double, byte_bits double, n_bytes long, tail array<long>, times array<int>, coded array<int>"


def score_texts(docs: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id column, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    All counts come from all rows where `learn` holds; the mixer begins each text with the same weights, which follow the
    text's own bits, so that nothing is learned from some of the rows alone. base_score is the add-one unigram of the
    words; score is the model's log10 probability over the same events (the training words and one unknown word): the
    bits of the words in the vocabulary and of expected passages, and for other words the escape and their share of what
    the vocabulary leaves. bits_per_byte is the cost of the whole text with such words spelled byte by byte.

    Words outside the vocabulary and passages are counted exactly in tables that grow with the corpus, and joined by
    Spark on 64-bit hashes; the tables of bits have a size that follows the training tokens up to 2^MOST_BITS slots.
    Ids may be of any type. A null text counts as empty (one end); repeated rows stay; null ids are neither learned from
    nor held out; without training rows all counts are 0; an empty table gives no rows; other columns of docs are not read.
    """
    spark = docs.sparkSession
    learn = F.coalesce(learn, F.lit(False))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), learn.alias("learn"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialise(word_counts(own.where("learn")), "words")
    sizes = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("c")))).first()
    n, v, ends = sizes[0] or 0, sizes[1], sizes[2] or 0

    # The least count whose words all fit in the vocabulary, from the number of words of each count.
    steps = counts.where((F.length("word") > 0) & (F.col("c") > 1)).groupBy("c").count().orderBy(F.desc("c")).limit(model.VOCABULARY).collect()
    room, cut = model.VOCABULARY, None
    for c, many in steps:
        room -= many
        if room < 0:
            break
        cut = c
    words = counts.where((F.length("word") > 0) & (F.col("c") >= (cut or 1 << 62))).toArrow()
    words = words.take(pc.sort_indices(words, [("c", "descending"), ("word", "ascending")]))
    often = words.column("c").to_numpy()
    tail_n, tail_v = n - ends - int(often.sum()), v - len(words) - bool(ends)
    coder = spark.sparkContext.broadcast(model.Coder(words.column("word").to_pylist(), often, tail_n, ends))
    del words

    texts = materialise(numbered(own, coder), "numbered")
    tables = [np.zeros(len(t), dtype=np.uint64) for t in coder.value.empty_counts()]
    add_bit_counts(texts.where("learn"), coder, tables)
    found = materialise(texts.select("row", "id", "held_out", "n_words", "n_bytes", "codes", "rare").join(told(texts).hint("merge"), "row", "left"), "told")
    predictor, mixer = spark.sparkContext.broadcast(model.Predictor.of(coder.value.above, tables)), model.Mixer()
    del tables
    end_log = float(np.log10(ends + 1))
    kind = dict(own.dtypes)["id"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder.value
        logs = np.log10(np.array([*code.counts, 0, 0], dtype=np.float64) + 1)
        for part in parts:
            every = part.column("told").to_pylist()
            for at, codes, cut, rare in lots(part):
                many = len(rare)
                word_bits, byte_bits, coded = price(code, mixer, predictor.value, codes, cut, rare, [np.array(t or (), dtype=np.int64) for t in every[at : at + many]])
                is_known = codes >= 0
                log = np.bincount(np.repeat(np.arange(many), np.diff(cut))[is_known], logs[codes[is_known]], minlength=many) + end_log
                known = np.diff(np.r_[0, np.cumsum(is_known)][cut]) + (ends > 0)
                own_, left = [Counter(r) for r in rare], [Counter(r) for r in coded]
                lists = lambda rows, t: pa.array(rows, type=pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row").slice(at, many), part.column("id").slice(at, many), part.column("held_out").slice(at, many), pa.array(np.diff(cut) + 1), pa.array(known, type=pa.int64()), pa.array(log),
                        pa.array(word_bits), pa.array(byte_bits), part.column("n_bytes").slice(at, many), lists([np.array([xxh64_intdigest(w, 42) for w in c], dtype=np.uint64).view(np.int64) for c in own_], pa.int64()),
                        lists([list(c.values()) for c in own_], pa.int32()), lists([[b[w] for w in a] for a, b in zip(own_, left, strict=True)], pa.int32()),
                    ],
                    ["row", "id", "held_out", "n_tokens", "n_known", "logs", "word_bits", "byte_bits", "n_bytes", "tail", "times", "coded"],
                )

    scored = materialise(found.mapInArrow(run, f"row long, id {kind}, {SCORED.removeprefix('row long, ')}"), "scored")
    rare = counts.where((F.length("word") > 0) & (F.col("c") < (cut or 1 << 62))).select(F.xxhash64("word").alias("h"), "c")
    tails = scored.select("row", F.explode(F.arrays_zip("tail", "times", "coded")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.times").alias("times"), F.col("t.coded").alias("coded"))
    log = F.log10(F.col("c") + 1)
    sums = tails.join(rare, "h").groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * log).alias("tail_logs"), F.sum(F.col("coded") * log).alias("coded_logs"))
    outside = F.aggregate("coded", F.lit(0).cast("long"), lambda a, x: a + x)
    zero = F.lit(0.0)
    joined = scored.join(sums, "row", "left")
    return joined.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("tail_logs", zero) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.coalesce("coded_logs", zero) - outside * float(np.log10(tail_n + tail_v + 1)) - F.col("word_bits") * float(np.log10(2))).alias("score"),
        ((F.col("word_bits") + F.col("byte_bits")) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = remainder("doc_id", 7) == 2
    return score_texts(docs, ~held, held)
