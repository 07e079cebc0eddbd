"""Plain Lloyd iterations over integer vectors: centroids are broadcast, sums are merged by Spark, all figures are exact."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Components of a vector, and what a component is multiplied by.
DIMENSIONS, SCALE = 64, 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
#: Components below 2^LIMB in size are counted in machine integers, larger ones in digits of this base: a sum of 2^37 of
#: them fits a long, and so does the squared distance of two vectors of them.
LIMB = 26
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, small, large) of the vectors with exactly `dimensions` components, none null or not finite: floor(scale * x).

    small has the components as little-endian 32-bit integers; where one is of 2^LIMB or more, large has them all as
    decimal integers joined by commas instead.
    """
    kind = vectors.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = rows.where((F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, dimensions))
            fits = (np.abs(x) < (1 << LIMB) / scale).all(axis=1)
            q = np.floor(np.where(fits[:, None], x, 0) * scale).astype("<i4")
            small = [r.tobytes() if ok else None for r, ok in zip(q, fits, strict=True)]
            large = [None if ok else ",".join(str(math.floor(Fraction(c) * scale)) for c in r.tolist()) for r, ok in zip(x, fits, strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "small": small, "large": large})

    return whole.mapInPandas(run, f"id {kind}, small binary, large string")


def components(small: bytes | None, large: str | None) -> list[int]:
    return np.frombuffer(small, dtype="<i4").tolist() if small is not None else [int(c) for c in large.split(",")]


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors of the smallest sha256 of `seed:id`, in this order (a null id reads as empty; ties by the components)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [components(r.small and bytes(r.small), r.large) for r in vectors.orderBy(name, "small", "large").limit(clusters).select("small", "large").collect()]


def squared(q: np.ndarray, centroid: Sequence[int]) -> np.ndarray:
    """Squared distance of each row to a centroid: integers of the machine, or Python's where those may not do."""
    if q.dtype != object and max(map(abs, centroid)) < 1 << LIMB:
        apart = q - np.array(centroid, dtype=np.int64)
        return np.einsum("ij,ij->i", apart, apart)
    apart = q.astype(object) - np.array(centroid, dtype=object)
    return (apart * apart).sum(axis=1)


def nearest(q: np.ndarray, centroids: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of each row: the nearest centroid, ties to the smaller number."""
    far = np.stack([squared(q, c) for c in centroids], axis=1)
    which = np.argmin(far, axis=1)
    return which, far[np.arange(len(far)), which]


def _blocks(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, components) of the small and of the large vectors of a batch."""
    large = pdf["small"].isna().to_numpy()
    for rows, of in ((np.flatnonzero(~large), lambda part: np.frombuffer(b"".join(part["small"]), dtype="<i4").reshape(len(part), -1).astype(np.int64)), (np.flatnonzero(large), lambda part: np.array([components(None, c) for c in part["large"]], dtype=object))):
        if len(rows):
            yield rows, of(pdf.iloc[rows])


def digits(values: Sequence[int]) -> Iterator[tuple[int, list[int]]]:
    """(place, digits) of integers in base 2^LIMB, each digit with its integer's sign; the last place takes what is left
    below it only, so values may be of any size."""
    place, left = 0, [abs(int(v)) for v in values]
    signs = [-1 if v < 0 else 1 for v in values]
    while place == 0 or any(left):
        yield place, [s * (v & ((1 << LIMB) - 1)) for s, v in zip(signs, left, strict=True)]
        left, place = [v >> LIMB for v in left], place + 1


def assigned_sums(vectors: DataFrame, centroids: Sequence[Sequence[int]]) -> tuple[list[list[int]], list[int], list[int]]:
    """For each centroid: the exact sum of its vectors, their number, and the sum of their squared distances.

    Each partition adds its own up and gives a row for each cluster, component and place of digits; Spark adds these.
    """
    k, width, known = len(centroids), len(centroids[0]), vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, inertia = [[0] * width for _ in range(k)], [0] * k, [0] * k
        for pdf in parts:
            for _, q in _blocks(pdf):
                which, far = nearest(q, known.value)
                for c in range(k):
                    own = which == c
                    if own.any():
                        total[c] = [a + int(b) for a, b in zip(total[c], q[own].sum(axis=0), strict=True)]
                        n[c] += int(own.sum())
                        inertia[c] += sum(far[own].tolist())
        rows = [(c, place, d, digit) for c in range(k) if n[c] for place, part in digits([*total[c], n[c], inertia[c]]) for d, digit in enumerate(part)]
        yield pd.DataFrame(rows, columns=["cluster", "place", "dimension", "digit"])

    parts = vectors.select("small", "large").mapInPandas(run, "cluster int, place int, dimension int, digit long")
    sums = [[0] * (width + 2) for _ in range(k)]
    for cluster, place, dimension, digit in parts.groupBy("cluster", "place", "dimension").agg(F.sum("digit")).collect():  # of a fixed size
        sums[cluster][dimension] += digit << LIMB * place
    return [s[:width] for s in sums], [s[-2] for s in sums], [s[-1] for s in sums]


def lloyd(vectors: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """The centroids after some rounds: each becomes the floor of its vectors' mean, an empty one stays."""
    for _ in range(rounds):
        sums, n, _ = assigned_sums(vectors, centroids)
        centroids = [[s // m for s in total] if m else old for total, m, old in zip(sums, n, centroids, strict=True)]
    return centroids


def fits(value: int) -> int | None:
    return value if value <= LONG else None


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: its id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Vectors that are null, of another length, or with a component that is null or not finite are left out. Fewer kept
    vectors than clusters give as many clusters as vectors; none gives no rows. Repeated rows stay, a null id is kept
    and hashed as an empty one; other columns aren't read. Components of any size are counted exactly; a distance or sum
    beyond a long is null. A round reads the kept vectors once and shuffles a row of sums for each partition and cluster.
    """
    kept = materialise(quantised(vectors, id_col, vector_col, dimensions, scale), "vectors")
    centroids = first_centroids(kept, clusters, seed)
    kind = kept.schema["id"].dataType.simpleString()
    schema = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return kept.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    centroids = lloyd(kept, centroids, rounds)
    inertia = assigned_sums(kept, centroids)[2]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = kept.sparkSession.sparkContext.broadcast((centroids, [fits(i) for i in inertia], fits(sum(inertia)), names))
    return kept.mapInPandas(_assign(known), schema).withColumnRenamed("id", id_col)


def _assign(known) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, inertia, total, names = known.value
        for pdf in parts:
            which, far = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=object)
            for rows, q in _blocks(pdf):
                which[rows], far[rows] = nearest(q, centroids)
            own = which.tolist()
            yield pd.DataFrame(
                {
                    "id": pdf["id"],
                    "cluster": which,
                    "distance": pd.array([fits(int(d)) for d in far], dtype="Int64"),
                    "cluster_inertia": pd.array([inertia[c] for c in own], dtype="Int64"),
                    "inertia": pd.array([total] * len(own), dtype="Int64"),
                    "centroid_sha256": [names[c] for c in own],
                }
            )

    return run


def op12_lloyd(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """The rounds unrolled, as SQL has no loop over aggregates."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"q AS MATERIALIZED (SELECT rid, unnest(range(1, {dimensions + 1})) AS d, floor(unnest(embedding)::DOUBLE * {scale})::BIGINT AS v FROM kept)",
        f"start AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) - 1 AS c FROM kept QUALIFY c < {clusters})",
        "c0 AS MATERIALIZED (SELECT c, d, v FROM start JOIN q USING (rid))",
    ]
    for k in range(rounds + 1):
        steps.append(f"f{k} AS MATERIALIZED (SELECT rid, c, sum((q.v - c{k}.v) * (q.v - c{k}.v))::BIGINT AS far FROM q JOIN c{k} USING (d) GROUP BY rid, c)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT rid, min(far) AS far, arg_min(c, far * {clusters} + c) AS c FROM f{k} GROUP BY rid)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT a.c, d, sum(v) AS s, count(*) AS n FROM a{k} a JOIN q USING (rid) GROUP BY a.c, d)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, v)::BIGINT AS v FROM c{k} LEFT JOIN m{k} USING (c, d))")
    return f"""
WITH {", ".join(steps)},
names AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c),
own AS (SELECT c, sum(far)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, a.c::INTEGER AS cluster, far AS distance, cluster_inertia, (SELECT sum(far)::BIGINT FROM a{rounds}) AS inertia, centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN own ON own.c = a.c JOIN names ON names.c = a.c
"""


OP12_SQL = _sql()
