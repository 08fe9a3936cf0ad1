"""The log of calls as a stream: last state of each call, counts by window, idempotent writes by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.files import scratch

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", schema: str | None = None) -> DataFrame:
    """Events as a stream of files."""
    schema = schema or spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def last_states(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The last event of each user so far (update mode); repeated events count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", F.col("m.ts").alias("ts"), F.col("m.event_id").alias("event_id"), F.col("m.event_type").alias("event_type"))


def window_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and their values by window and type; tumbling, or sliding with `slide`."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of users: runs of events with no gap as long as `gap`."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def drained(stream: DataFrame, name: str, *keys: str) -> DataFrame:
    """All that is there now run through the stream.

    With keys, each batch writes only the rows that it changed, closed windows leave the state, and the last row of a key
    stands. Without, each batch writes the full result (session windows can't be updated), and the last batch stands.
    A batch that runs again after a failure overwrites its own folder, so each counts once."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    mode = "update" if keys else "complete"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-progress").foreachBatch(put).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    df = spark.read.parquet(out)
    if keys:
        rest = [c for c in df.columns if c not in (*keys, "batch")]
        df = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*").select(*[c for c in df.columns if c != "batch"])
    else:
        last = df.agg(F.max("batch")).first()[0]
        df = df.where(F.col("batch") == last).drop("batch")
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Hourly counts by type, from a stream."""
    return drained(window_counts(event_stream(spark, sf_dir), "1 hour"), "tumbling", "start", "event_type")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    """Counts by hours that begin every half hour."""
    return drained(window_counts(event_stream(spark, sf_dir), "1 hour", "30 minutes"), "sliding", "start", "event_type")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, g")
def stream_sessions(spark, sf_dir):
    """Sessions of users, from a stream."""
    return drained(sessions(event_stream(spark, sf_dir), "4 hours"), "sessions")


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_last_state(spark, sf_dir):
    """The last state of each key, from a stream."""
    return drained(last_states(event_stream(spark, sf_dir), "60 days"), "last-state", "user_id")
