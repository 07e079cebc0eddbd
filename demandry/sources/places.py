"""A place service as a Spark data source: one request for each point, with pauses and retries, and appends that a run
which was stopped half-way repeats nothing of.

    spark.dataSource.register(PlaceSource)
    spark.read.format("places").options(points="/points", endpoints="https://a/api,https://b/api").load()
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from demandry.config import DECAY
from demandry.operators.spatial import POI_TAGS, poi_counts, radius_query

#: Attempts for a point; seconds of the first pause, which doubles with each attempt; answers of a busy
#: service, after which to pause; least seconds between two requests to an endpoint; seconds to wait for an answer.
ATTEMPTS, PAUSE, BUSY, INTERVAL, TIMEOUT = 5, 4.0, (429, 502, 503, 504), 1.2, 90.0

ROW = """outlet_id string, lat double, lon double, status string, attempts int, error string, n_elements long, endpoint string,
fetched_at_utc string, elements array<struct<kind: string, element_id: bigint, elat: double, elon: double, tags: map<string, string>>>"""
ELEMENT = pa.struct([("kind", pa.string()), ("element_id", pa.int64()), ("elat", pa.float64()), ("elon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string()))])
ARROW = pa.schema([("outlet_id", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("status", pa.string()), ("attempts", pa.int32()), ("error", pa.string()), ("n_elements", pa.int64()), ("endpoint", pa.string()), ("fetched_at_utc", pa.string()), ("elements", pa.list_(ELEMENT))])


class Client:
    """Requests to one endpoint, one after the other.

    A busy service (BUSY) is asked again after 4, 8, 16, ... seconds and a random part of one, any other error status at
    once, and a broken connection or answer after the same pauses without the random part; the last attempt isn't
    followed by a pause. Requests begin at least `interval` seconds after the one before has ended.
    """

    def __init__(self, endpoint: str, attempts: int = ATTEMPTS, pause: float = PAUSE, interval: float = INTERVAL, timeout: float = TIMEOUT, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random):
        self.endpoint, self.attempts, self.pause, self.interval, self.timeout = endpoint, attempts, pause, interval, timeout
        self.sleep, self.jitter, self.ended = sleep, jitter, -float("inf")

    def _post(self, query: str) -> dict:
        data = urllib.parse.urlencode({"data": query}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.endpoint, data=data, headers={"User-Agent": "demandry"}), timeout=self.timeout) as answer:
            if answer.status != 200:
                raise urllib.error.HTTPError(self.endpoint, answer.status, "", answer.headers, None)
            got = json.load(answer)
        if not isinstance(got, dict):
            raise ValueError("not an object")
        return got

    def ask(self, query: str) -> tuple[dict | None, int, str | None]:
        """(answer, attempts, last error); no answer after all attempts."""
        early = self.interval - (time.monotonic() - self.ended)
        if early > 0:
            self.sleep(early)
        answer, error, attempt = None, None, 0
        while answer is None and attempt < self.attempts:
            attempt, wait = attempt + 1, 0.0
            try:
                answer = self._post(query)
            except urllib.error.HTTPError as failed:
                error = f"HTTP {failed.code}"
                wait = self.pause * 2 ** (attempt - 1) + self.jitter() if failed.code in BUSY else 0.0
            except (OSError, ValueError) as failed:
                error, wait = type(failed).__name__, self.pause * 2 ** (attempt - 1)
            if answer is None and wait and attempt < self.attempts:
                self.sleep(wait)
        self.ended = time.monotonic()
        return answer, attempt, error


def element_rows(answer: dict) -> list[dict]:
    """Elements with their own point, or their centre's; tags as text."""
    out = []
    for e in answer.get("elements") or ():
        centre = e.get("center") or {}
        tags = [(str(k), None if v is None else str(v)) for k, v in (e.get("tags") or {}).items()]
        out.append({"kind": e.get("type"), "element_id": e.get("id"), "elat": e.get("lat", centre.get("lat")), "elon": e.get("lon", centre.get("lon")), "tags": tags})
    return out


def ask_point(client: Client, outlet_id: str | None, lat: float | None, lon: float | None, radius: int) -> dict:
    """The row of a point. A point without coordinates isn't asked for (status skipped_null_coords)."""
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    row = {"outlet_id": outlet_id, "lat": lat, "lon": lon, "endpoint": client.endpoint, "fetched_at_utc": now, "attempts": 0, "error": None, "n_elements": None, "elements": None}
    if lat is None or lon is None or lat != lat or lon != lon:
        return row | {"status": "skipped_null_coords"}
    answer, attempts, error = client.ask(radius_query(lat, lon, radius))
    if answer is None:
        return row | {"status": "failed", "attempts": attempts, "error": error}
    found = element_rows(answer)
    return row | {"status": "ok", "attempts": attempts, "error": error, "n_elements": len(found), "elements": found}


@dataclass
class Share(InputPartition):
    """The points whose number has this remainder, asked of this endpoint."""

    endpoint: str
    number: int
    of: int


class PlaceReader(DataSourceReader):
    """One partition for each endpoint, as it takes one request at a time: points are dealt to them in turn."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.endpoints = [e.strip() for e in options["endpoints"].split(",") if e.strip()]
        if not self.endpoints:
            raise ValueError("no endpoints")

    def partitions(self) -> list[InputPartition]:
        return [Share(e, k, len(self.endpoints)) for k, e in enumerate(self.endpoints)]

    def _points(self) -> Iterator[tuple]:
        import pyarrow.dataset

        uri = self.options["points"]
        system, path = pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        names = [self.options.get(k, d) for k, d in (("id", "outlet_id"), ("lat", "lat"), ("lon", "lon"))]
        for batch in pa.dataset.dataset(path, filesystem=system, format="parquet").to_batches(columns=names):
            yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        number = lambda name, default: type(default)(self.options.get(name, default))
        client = Client(partition.endpoint, number("attempts", ATTEMPTS), number("pause", PAUSE), number("interval", INTERVAL), number("timeout", TIMEOUT))
        for k, (outlet_id, lat, lon) in enumerate(self._points()):
            if k % partition.of == partition.number:
                row = ask_point(client, None if outlet_id is None else str(outlet_id), lat, lon, number("radius", DECAY.rings[-1]))
                yield pa.RecordBatch.from_pylist([row], schema=ARROW)


class PlaceSource(DataSource):
    """Options: points (a Parquet folder or file of id, lat, lon), endpoints (comma-joined); id, lat, lon (column names),
    attempts, pause, interval, timeout, radius."""

    @classmethod
    def name(cls) -> str:
        return "places"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return PlaceReader(self.options)


def audit_log(rows: DataFrame) -> DataFrame:
    """(timestamp_utc, outlet_id, status, n_elements): a line for each point that was taken up."""
    return rows.select(F.col("fetched_at_utc").alias("timestamp_utc"), "outlet_id", "status", "n_elements")


def place_documents(rows: DataFrame) -> DataFrame:
    """(outlet_id, doc): a JSON document for each answered point, with the counts of every type in every ring."""
    answered = rows.where("status = 'ok'")
    elements = answered.select("outlet_id", "lat", "lon", F.explode("elements").alias("e")).select("outlet_id", "lat", "lon", "e.*")
    counts = poi_counts(elements).groupBy("outlet_id").agg(F.map_from_entries(F.collect_list(F.struct("poi_type", F.create_map(*[x for r in DECAY.rings for x in (F.lit(str(r)), F.col(f"n_{r}"))])))).alias("found"))
    none = F.create_map(*[x for r in DECAY.rings for x in (F.lit(str(r)), F.lit(0).cast("long"))])
    kinds = list(dict.fromkeys(kind for kind, _, _ in POI_TAGS))
    every = F.create_map(*[x for t in kinds for x in (F.lit(t), F.coalesce(F.try_element_at("found", F.lit(t)), none))])
    fields = F.struct(F.col("outlet_id").alias("Outlet_ID"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), "fetched_at_utc", "n_elements", "endpoint", every.alias("counts"))
    return answered.join(counts, "outlet_id", "left").select("outlet_id", F.to_json(fields).alias("doc"))


# Appends that count once


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The batches that have been written whole."""
    try:
        return [r[0] for r in spark.read.schema("batch string, n_rows long").json(f"{folder}/commits").select("batch").distinct().collect()]
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise


def append_batch(df: DataFrame, folder: str, batch: str) -> bool:
    """Appends df as a batch, once: nothing happens if the batch is committed, and what a stopped run left of it is replaced.

    The rows are written to the batch's own folder first; the line in commits that makes them count comes after.
    """
    spark = df.sparkSession
    if batch in committed(spark, folder):
        return False
    path = f"{folder}/rows/batch={batch}"
    df.write.mode("overwrite").parquet(path)
    n = spark.read.schema(df.schema).parquet(path).count()
    spark.createDataFrame([(batch, n)], "batch string, n_rows long").coalesce(1).write.mode("append").json(f"{folder}/commits")
    return True


def read_batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all committed batches, with their batch; what was written and not committed isn't read."""
    kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    done = committed(spark, folder)
    if not done:
        return spark.createDataFrame([], f"{kind}, batch string")
    rows = spark.read.schema(f"{kind}, batch string").parquet(*[f"{folder}/rows/batch={b}" for b in sorted(done)])
    return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batch=([^/]+)/", 1))


def ask(points: DataFrame, todo: str, **options: str) -> DataFrame:
    """Rows of the service for points (outlet_id, lat, lon), which are written to the folder todo for the source to read."""
    spark = points.sparkSession
    spark.dataSource.register(PlaceSource)
    points.select("outlet_id", "lat", "lon").coalesce(1).write.mode("overwrite").parquet(todo)
    return spark.read.format("places").options(points=todo, **{k: str(v) for k, v in options.items()}).load()


def collect_places(points: DataFrame, folder: str, run: str, fetch: Callable[[DataFrame, str], DataFrame], batches: int = 10) -> DataFrame:
    """Asks for every point that has no answer yet, in batches, and returns all rows so far.

    points has outlet_id, lat, lon; fetch(points, todo) asks (see `ask`). Points are dealt to batches by a hash, so that a
    run of the same name that was stopped goes on with the batches that weren't committed, and asks for no point of the
    others again. Points that failed, or had no coordinates, are asked for again by the next run.
    """
    spark = points.sparkSession
    known = read_batches(spark, folder, ROW).where("status = 'ok'").select("outlet_id").distinct()
    own = points.withColumn("outlet_id", F.col("outlet_id").cast("string"))
    waiting = own.join(known, "outlet_id", "left_anti")
    for k in range(batches):
        name = f"{run}-{k}"
        if name not in committed(spark, folder):
            part = waiting.where(F.pmod(F.xxhash64("outlet_id"), F.lit(batches)) == k)
            append_batch(fetch(part, f"{folder}/todo/{name}"), folder, name)
    return read_batches(spark, folder, ROW)
