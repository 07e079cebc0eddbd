"""Sources and sinks: checked CSV and Parquet scans, JSON documents per outlet, append-only logs, resumable fetches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandry.config import DOMAIN
from demandry.functions.exprs import null_token
from demandry.operators.quality import conform

#: The raw tables' schemas; everything that may be dirty is read as text.
SCHEMAS = {
    "transactions": "Outlet_ID string, Year string, Month string, Distributor_ID string, SKU_ID string, Volume_Liters string, Total_Bill_Value string",
    "outlet_master": "Outlet_ID string, Outlet_Size string, Cooler_Count string, Outlet_Type string",
    "outlet_coordinates": "Outlet_ID string, Latitude string, Longitude string",
    "distributor_seasonality": "Distributor_ID string, Year string, Month string, Seasonality_Index string",
    "holiday_list": "Date string, Holiday_Name string, Holiday_Type string",
}
POI = "Outlet_ID string, Latitude double, Longitude double, fetched_at_utc string, n_elements long, endpoint string, counts map<string, map<string, bigint>>, _corrupt_record string"


class SourceMissing(FileNotFoundError):
    """No folder (code 2) or no such table in it (code 3)."""

    def __init__(self, what: str, code: int):
        super().__init__(what)
        self.code = code


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).limit(0).count()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def require(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Every table's file is there, by whatever file system the folder is on; else SourceMissing."""
    if not _exists(spark, folder):
        raise SourceMissing(folder, 2)
    for name in names:
        if not _exists(spark, f"{folder}/{name}.csv"):
            raise SourceMissing(f"{folder}/{name}.csv", 3)


def read_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A raw table as text, with the tokens that mean nothing made null."""
    raw = spark.read.csv(f"{folder}/{name}.csv", schema=SCHEMAS[name], header=True)
    return raw.select(*[null_token(F.col(c), DOMAIN.null_tokens).alias(c) for c in raw.columns])


def ingest(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All raw tables, and a report (dataset, missing, unexpected) of their headers against the schemas."""
    require(spark, folder, SCHEMAS)
    rows = []
    for name, schema in SCHEMAS.items():
        header = spark.read.csv(f"{folder}/{name}.csv", header=True).columns
        expected = [f.name for f in T._parse_datatype_string(schema)]
        found = conform(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in header)), expected)
        rows.append((name, found["missing"], found["unexpected"]))
    return {name: read_csv(spark, folder, name) for name in SCHEMAS}, spark.createDataFrame(rows, "dataset string, missing array<string>, unexpected array<string>")


def profile(df: DataFrame, name: str, head: int = 3) -> DataFrame:
    """One row: the table's name, columns with types, number of rows, and the first rows as JSON."""
    first = df.limit(head).agg(F.collect_list(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})).alias("head"))
    one = df.agg(F.lit(name).alias("dataset"), F.lit(", ".join(f"{c}:{t}" for c, t in df.dtypes)).alias("columns"), F.count("*").alias("n_rows"))
    return one.crossJoin(F.broadcast(first))  # one row each


def read_poi(spark: SparkSession, folder: str) -> DataFrame:
    """(outlet_id, counts) of one JSON document per outlet; unreadable ones are left out, a missing id is the file's name."""
    docs = spark.read.schema(POI).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return docs.where(F.col("_corrupt_record").isNull()).select(F.coalesce("Outlet_ID", stem).alias("outlet_id"), "counts")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """A JSON object per line, keyed by an id."""
    df.select(F.to_json(F.struct(F.col(key).cast("string").alias("id"), F.struct(*[c for c in df.columns if c != key]).alias("record"))).alias("value")).write.mode("overwrite").text(path)


def append_log(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Append (outlet_id, status, n_elements) with the time to a log that readers may follow."""
    spark.createDataFrame(rows, "outlet_id string, status string, n_elements long").withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def pending(wanted: DataFrame, done: DataFrame, key: str = "outlet_id") -> DataFrame:
    """What has no document yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def fetch(points: DataFrame, request: Callable[[float, float], dict | None]) -> DataFrame:
    """(outlet_id, document) of points (outlet_id, lat, lon) by a caller's request function, run on the executors.

    The function holds the transport, its pauses and its retries; None or an exception leaves the document null, for a
    later run over `pending` to ask again.
    """
    import json

    def run(parts):
        for part in parts:
            out = []
            for lat, lon in zip(part["lat"], part["lon"], strict=True):
                try:
                    got = request(float(lat), float(lon))
                except Exception:
                    got = None
                out.append(None if got is None else json.dumps(got, sort_keys=True))
            yield part[["outlet_id"]].assign(document=out)

    return points.select("outlet_id", "lat", "lon").mapInPandas(run, f"outlet_id {dict(points.dtypes)['outlet_id']}, document string")


def load_env(path: str, env: dict[str, str]) -> dict[str, str]:
    """env with the KEY=value lines of a file that it doesn't have yet; blank lines and # comments are skipped."""
    out = dict(env)
    if Path(path).exists():
        for line in Path(path).read_text().splitlines():
            key, sep, value = line.strip().partition("=")
            if sep and not key.startswith("#"):
                out.setdefault(key.strip(), value.strip().strip("'\""))
    return out


def markdown(row: dict, title: str) -> str:
    """A one-row result as a table of text."""
    return "\n".join([f"# {title}", "", "| Metric | Value |", "|---|---|", *[f"| {k} | {v:,.2f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in row.items()], ""])
