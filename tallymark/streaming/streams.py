"""Structured Streaming jobs: ingest, dedupe, hourly flows, sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..registry import register


def ingest(spark: SparkSession, path: str, schema, files_per_step: int = 1) -> DataFrame:
    """A stream over a folder of landed Parquet files, a few per step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(path)


def deduped(records: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Records once per key, with state bounded by the watermark."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def hourly(records: DataFrame, keys: list[str], time: str, value: str, delay: str) -> DataFrame:
    """Hourly counts and sums; late rows inside the watermark merge."""
    return records.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("hour"), "n", "total")


def sessions(records: DataFrame, key: str, time: str, gap: str, delay: str | None = None) -> DataFrame:
    """Sessions of a key: events closer than ``gap``.  Works on streams (with ``delay``) and on tables."""
    rows = records.withWatermark(time, delay) if delay else records
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table in the shared folder, and read it back."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream in update mode, and keep the last word on each of ``keys``: open windows count too."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/updates-{uuid.uuid4().hex}"

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/step={batch_id}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    return spark.read.parquet(f"{base}/out").groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def all_sessions(rows: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a finite stream, the last ones too: after all rows a marker far in the future moves the watermark."""
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    marker = spark.range(1).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit("2999-01-01").cast("timestamp").alias(time))
    marker.limit(0).write.parquet(f"{base}/marker")
    for step in (0, 1):  # all rows, then the marker
        both = rows.select(key, time).unionByName(spark.readStream.schema(marker.schema).parquet(f"{base}/marker"))
        sessions(both, key, time, gap, delay).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        if step == 0:
            marker.write.mode("append").parquet(f"{base}/marker")
    return spark.read.schema(f"{key} {rows.schema[key].dataType.simpleString()}, start timestamp, n long").parquet(f"{base}/out").where(F.col(key).isNotNull())


def events_stream(v) -> DataFrame:
    return ingest(v.spark, f"{v.sf_dir}/event[s].parquet", v.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


register("st_ingest", lambda v: run_once(events_stream(v)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
register("st_dedup", lambda v: run_once(deduped(events_stream(v), "event_id", "ts", "1 hour")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
register("st_session", lambda v: all_sessions(events_stream(v), "user_id", "ts", "6 hours", "1 hour").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"), "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
register("st_hourly", lambda v: latest(hourly(events_stream(v), ["event_type"], "ts", "event_id", "2 hours"), ["event_type", "hour"]).withColumn("hour", F.col("hour").cast("timestamp_ntz")), "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL")
