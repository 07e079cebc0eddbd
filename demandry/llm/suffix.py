"""Benchmark decontamination by suffix arrays over the training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, ranges, texts

WINDOW = 13
#: Keeps 0-9, a-z and every byte of a non-ASCII character, lower-cases A-Z, and turns the rest of ASCII into spaces.
ITEM_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Documents of a shard, whose suffixes are sorted together.
SHARD = 2000
#: Words of benchmark text that one pass over the documents searches for; more go in further passes.
PASS_WORDS = 2_000_000
SPANS = "row string, n_words long, starts array<long>, ends array<long>, items array<string>"


class Tests:
    """The test suffixes of some items: word ids in one array, and the windows that start in it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        flat, start, width, owner, self.names = [], [], [], [], []
        for name, text in items:
            words = text.translate(ITEM_WORDS).split()
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            w = min(window, len(ids))
            for k in range(len(ids) - w + 1):
                start.append(len(flat) + k)
                width.append(w)
                owner.append(len(self.names))
            flat += ids
            self.names.append(name)
        self.flat = np.array(flat + [0] * window, dtype=np.int32)
        self.start, self.width, self.owner = (np.array(x, dtype=np.int64) for x in (start, width, owner))
        self.shortest = int(self.width.min(initial=window))
        # Windows of one width with the same words are one search.
        self.words = self.flat[self.start[:, None] + np.arange(window)] if len(self.start) else np.zeros((0, window), dtype=np.int32)
        self.words[np.arange(window) >= self.width[:, None]] = 0
        # The first words of any window, for leaving suffixes out that no test suffix can reach.
        self.lead = min(2, self.shortest)
        many = len(self.vocabulary) + 1
        first = self.words[:, 0].astype(np.int64)
        self.leads = np.unique(first * many + self.words[:, 1] if self.lead == 2 else first)
        self.many = many


def suffix_array(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The positions `at` sorted by the `window` ids that begin there, which is as deep as any search looks; ids ends with zeros."""
    if not len(at):
        return at
    words = ids[at[:, None] + np.arange(window)]
    return at[np.lexsort(words.T[::-1])]


def search(ids: np.ndarray, array: np.ndarray, words: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the part of the suffix array that begins with its first `width` words: (from, to)."""
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(array), dtype=np.int64)
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) // 2
            differ = ids[array[mid][:, None] + np.arange(words.shape[1])].astype(np.int64) - words[k]
            differ[np.arange(words.shape[1]) >= width[k][:, None]] = 0
            first = np.argmax(differ != 0, axis=1)
            sign = differ[np.arange(len(k)), first]
            right = sign <= 0 if upper else sign < 0
            low[k[right]] = mid[right] + 1
            high[k[~right]] = mid[~right]
        bounds.append(low)
    return bounds[0], bounds[1]


def shard_matches(docs: list[bytes | None], tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard of documents: its word counts, and each match as (document, first word, test window)."""
    get, parts, counts = tests.vocabulary.get, [], []
    for text in docs:
        words = (text or b"").translate(ITEM_WORDS).split()
        counts.append(len(words))
        parts.append(np.fromiter(map(get, words, [0] * len(words)), dtype=np.int32, count=len(words)))
        parts.append(np.zeros(1, dtype=np.int32))  # no match crosses from a document to the next
    ids = np.concatenate([*parts, np.zeros(tests.window, dtype=np.int32)])
    counts = np.array(counts, dtype=np.int64)
    base = np.cumsum(counts + 1) - counts - 1
    key = ids[:-1].astype(np.int64) * tests.many + ids[1:] if tests.lead == 2 else ids.astype(np.int64)
    at = np.flatnonzero(ids[: len(key)])
    at = at[np.isin(key[at], tests.leads)]
    array = suffix_array(ids, at, tests.window)
    low, high = search(ids, array, tests.words, tests.width)
    place = array[ranges(low, high - low)] if len(array) else np.zeros(0, dtype=np.int64)
    which = np.repeat(np.arange(len(low)), high - low)
    doc = np.searchsorted(base, place, side="right") - 1
    return counts, doc, place - base[doc] if len(doc) else place, which


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans (sorted by start) with overlapping ones made one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    return start[first], reach[np.r_[first[1:] - 1, len(start) - 1]]


def match_spans(docs: DataFrame, items: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its longest verbatim matches as word spans [start, end), and the matched items."""
    tests = Tests(items, window)
    kind = dict(docs.dtypes)[id_col]
    schema = pa.schema([("row", pa.string()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (whole.slice(k, SHARD) for whole in parts for k in range(0, whole.num_rows, SHARD)):
            counts, doc, first, which = shard_matches(texts(part.column(2)), tests)
            order = np.lexsort((first, doc))
            doc, first, which = doc[order], first[order], which[order]
            cut = np.searchsorted(doc, np.arange(len(counts) + 1))
            starts, ends, names = [], [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                s, e = _merged(first[a:b], first[a:b] + tests.width[which[a:b]])
                starts.append(s)
                ends.append(e)
                names.append(sorted({tests.names[k] for k in np.unique(tests.owner[which[a:b]])}))
            found = batches({"row": part.column(1), "n_words": counts, "starts": starts, "ends": ends, "items": names}, schema)
            yield pa.RecordBatch.from_arrays([part.column(0), *found.columns], ["id", *schema.names])

    own = (F.col(id_col), F.col(text_col))
    row = F.concat(F.hex(F.xxhash64(*own)), F.lit("-"), F.hex(F.xxhash64(F.lit("row"), *[c.isNull() for c in own], *own)))
    return docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {SPANS}")


def _union_spans(rows: DataFrame) -> DataFrame:
    """Spans of the same row from several passes made one. Copies of a row are counted before the rows are grouped, and
    repeated after, so that a group has one row for each pass; a row's matches are bounded by its own words."""
    once = rows.groupBy("row", "pass").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("id", "n_words", "starts", "ends", "items")])

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        s = np.concatenate([np.asarray(x, dtype=np.int64) for x in part["starts"]])
        e = np.concatenate([np.asarray(x, dtype=np.int64) for x in part["ends"]])
        order = np.argsort(s, kind="stable")
        s, e = _merged(s[order], e[order])
        return pd.DataFrame([{"row": key[0], "n_words": part["n_words"].iloc[0], "starts": s, "ends": e, "items": sorted({x for names in part["items"] for x in names})}])

    spans = once.groupBy("row").applyInPandas(one, SPANS)
    ids = once.where("pass = 0").select(F.col("row").alias("of"), "id", F.sequence(F.lit(1).cast("long"), "copies").alias("copy"))
    return spans.join(ids, F.col("row") == F.col("of")).select("id", *[c.split()[0] for c in SPANS.split(", ")], F.explode("copy")).drop("col")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per document: (id column, row, n_words, starts, ends, items, n_hit); row names it by 128 bits of
    the id and the text.

    Each shard of documents (SHARD of them at most) becomes an array of word suffixes; every test suffix is binary-searched in
    it, which gives all its verbatim matches and their locations. A window is `window` consecutive words of an item, or
    the whole of a shorter item; matches of neighbouring windows join into the longest match. Suffixes whose leading
    words begin no window are left out, as no search reaches them. The benchmark is taken in passes of at most
    `pass_words` words, whose matches are united, so that what each task holds is bounded.

    A null or empty text has no words and no hit; an item without words has no window; repeated rows stay; empty tables
    are fine. An item with a null id is searched like any other and named by the empty string. Ids of documents may be
    of any type. The items of a row are in ascending string order.
    """
    tests = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.encode("text", "UTF-8").alias("text")).withColumn("words", F.length(F.col("text")))
    size = tests.agg(F.sum("words")).first()[0] or 0  # bytes, at least the number of words
    passes = max(1, -(-size // (4 * pass_words)))
    found = []
    for k in range(passes):
        items = tests.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == k).select("name", "text").orderBy("name").collect()
        found.append(match_spans(docs, [(r[0], bytes(r[1])) for r in items], id_col, text_col, window).withColumn("pass", F.lit(k)))
    rows = found[0].drop("pass")
    if passes > 1:
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        rows = _union_spans(every)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(F.col("id").alias(id_col), "row", "n_words", "starts", "ends", F.array_sort("items").alias("items"), hit.alias("n_hit"))


def contaminated(n_hit, n_words):
    """The rule: some word is hit, and a twentieth of all words at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
