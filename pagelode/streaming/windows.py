"""Streams: files as they arrive, counted per event-time window with late data allowed for, and audited in batches.

Both queries run over what is there (``availableNow``) and return the sink's table, so a batch caller
gets a DataFrame; ``window_counts`` and ``first_seen`` themselves take any streaming DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shared_dir


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream; a table is one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{table}.parquet*")


def window_counts(stream: DataFrame, at: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and sum of value per tumbling window and key; windows close once the watermark has passed them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(20,4)")).alias("total"))


def first_seen(stream: DataFrame, at: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Each key once per watermark horizon: state is dropped behind the watermark, so it stays bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table in the shared folder and return the table, with the number of the batch each row came with.

    In ``update`` mode a row replaces those of its key from earlier batches; state behind the watermark is dropped in either mode."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/pagelode/stream-{name}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        # a batch's number names its folder: a batch run twice replaces itself
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/{number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{base}/out")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type.  Open windows are given as they stand (update mode), so none is held back for a watermark that no later event moves."""
    events = source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = drain(window_counts(events, "ts", "event_type", "value"), "hourly", "update")
    last = rows.groupBy("w", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return last.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "r.n", F.col("r.total").cast("double").alias("total"))


HOURLY_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"


def sessions(spark: SparkSession, sf_dir: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events with gaps under half an hour, by session windows."""
    from ..session import load

    rows = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


SESSIONS_SQL = """
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM g GROUP BY user_id, k
"""


def registry() -> tuple[dict, dict[str, str]]:
    return {"stream_hourly_events": hourly_events, "event_sessions": sessions}, {"stream_hourly_events": HOURLY_SQL, "event_sessions": SESSIONS_SQL}
