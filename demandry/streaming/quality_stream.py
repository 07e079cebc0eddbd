"""The quality rules over a stream of events: the same tagged plan, counted in event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandry.operators import quality as q
from demandry.session import shared_folder


def tag_events(events: DataFrame) -> DataFrame:
    """events with failure_reason: missing keys, negative values, unreadable properties."""
    readable = F.from_json("props", "k bigint")["k"].isNotNull()
    return q.tag(events, q.null_reason(events, ["event_id", "user_id", "ts"]), q.range_reason("value", 0.0), F.when(~F.coalesce(readable, F.lit(False)), "props unreadable"))


def event_quality_stream(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """(day, status, n): events by day and by whether they passed, from a stream that ends with the files.

    Each batch writes the counts that it changed to a folder of its own in out/counts, so that a batch that runs again
    after a failure replaces its own rows; the state is in out/state, from which a stream started again with the same out
    goes on. Counts of a day are kept until events of more than a day later have come; what comes later still is left out.
    Without out a new folder in the shared one is taken.
    """
    if out is None:
        out = f"{shared_folder(spark)}/quality-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, so that a folder of files and a single file are read alike.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    tagged = tag_events(stream).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    counts = tagged.groupBy(F.window("ts", "1 day").alias("w"), F.when(F.col(q.REASON).isNull(), "passed").otherwise("rejected").alias("status")).agg(F.count("*").alias("n"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.select(F.to_date("w.start").alias("day"), "status", "n").write.mode("overwrite").parquet(f"{out}/counts/batch={batch}")

    run = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    written = spark.read.schema("day date, status string, n long, batch long").parquet(f"{out}/counts")
    return written.groupBy("day", "status").agg(F.max_by("n", "batch").alias("n"))
