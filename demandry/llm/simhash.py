"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import vptree
from .common import LOWER, batches, materialise, shared_dir, texts
from .components import components

SEED = 42
#: Shares into which the rows of one component, and those of one fingerprint, are dealt.
SALTS = 16


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The majority of each bit over the XXH64 of all shingles, repeats included; 0 without words.

    A-Z is lower-cased, words are split at ASCII white space and joined by one space; a text of fewer words than a
    shingle is one shingle.
    """
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per document, fp the fingerprint as a signed long. A null text counts as empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prints = np.array([fingerprint(t, shingle) for t in texts(part.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fp long")


def links(prints: DataFrame, radius: int = 4, leaf: int = 2000, sample: int = 50_000, blocks: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) within the radius, as stars of each shard's components.

    Every fingerprint is routed through all trees; `sample` bounds what the driver draws to place vantage points.
    """
    n = prints.count()
    blocks = blocks or vptree.blocks_for(n, radius)
    share = min(1.0, sample / max(n, 1))
    drawn = prints.where((F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))) | F.lit(share >= 1)).collect()
    points = np.sort(np.array([r[0] for r in drawn], dtype=np.int64)).view(np.uint64)
    width = max(16, int(leaf * share))
    trees = [vptree.build(points, m, radius, width) for m in vptree.masks(blocks, radius)]
    first = np.cumsum([0] + [t.leaves for t in trees]).tolist()
    mask_of = [t.mask for t in trees for _ in range(t.leaves)]
    # Where the drawn points are too few for small leaves, a leaf is dealt by what its close pairs agree on.
    parts_of = [max(1, -(-n // (t.leaves * 4 * leaf))) for t in trees]
    shards = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("fp", pa.int64())])

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fp = part.column(0).to_numpy(zero_copy_only=False)
            for tree, base, parts_ in zip(trees, first, parts_of, strict=False):
                at, where = tree.route(fp.view(np.uint64))
                yield batches({"shard": pa.array(where + np.int32(base)), "part": pa.array(vptree.part_of(fp[at].view(np.uint64), tree.mask, parts_)), "fp": pa.array(fp[at])}, shards)

    def join(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(shard["fp"].to_numpy()).view(np.uint64)
        a, b = vptree.link(fp, mask_of[key[0]], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return prints.select("fp").mapInArrow(route, "shard int, part int, fp long").groupBy("shard", "part").applyInPandas(join, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per document: (id column, fp, component_id).

    Documents link when their fingerprints differ in at most `radius` bits; component_id is the smallest id reachable,
    the document's own included. Null and empty texts have fingerprint 0 and link like any other; repeated rows stay;
    a null id never becomes a component_id unless the whole component has none; ids may be of any ordered type. An empty
    table gives no rows. Columns of docs other than the two named are not read.

    Components are found over distinct fingerprints. The last joins, by component and by fingerprint, are dealt by a
    salt as well, as one component or fingerprint may hold a third of all rows.
    """
    shared_dir(docs.sparkSession)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = lambda c: F.pmod(F.xxhash64(c, F.lit("salt")), F.lit(SALTS)).cast("int").alias("salt")
    own = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = own.groupBy("fp").agg(F.min("id").alias("least")).checkpoint()
    roots = components(links(classes.select("fp"), radius, blocks=blocks))
    grouped = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = grouped.select("fp", "root", salt("fp")).join(least.select("root", "component_id", salts), ["root", "salt"]).select("fp", "component_id")
    return own.select("id", "fp", salt("id")).join(labels.select("fp", "component_id", salts), ["fp", "salt"]).select(F.col("id").alias(id_col), "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_groups(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
