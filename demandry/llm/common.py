"""What the operators of this subpackage share: byte-level text access, shared-folder tables, sized broadcasts."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandry.session import shared_folder

#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A word of the corpus: anything between ASCII white space (space, \t, \n, \v, \f, \r).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that may be broadcast; beyond it the caller joins by shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; an error on a cluster where spark.checkpoint.dir is unset."""
    return shared_folder(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: later steps neither repeat its work nor depend on its executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcasting if its counted rows are within the limit, else df as it is (a shuffled join follows)."""
    return F.broadcast(df) if rows <= limit else df


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def batches(arrays: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(arrays[f.name], type=f.type) if not isinstance(arrays[f.name], pa.Array) else arrays[f.name].cast(f.type) for f in schema], schema=schema)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] values, then the same for starts[1] and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
