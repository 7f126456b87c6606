"""Call events from tables: the normative columns, and a rule that derives them from an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTER, EXIT, TICK = "ENTER", "EXIT", "TICK"
SCHEMA = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("tid", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("routine_id", T.StringType()),
        T.StructField("call_site", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("tick", T.LongType()),
    ]
)
#: Total order of a thread's events.
ORDER = ["ts", "seq"]
HOUR = 3_600_000_000


def from_event_log(events: DataFrame, granularity: int = HOUR, trace_id: str = "events") -> DataFrame:
    """Call events of an event log (event_id, ts, user_id, event_type, props).

    A user is a thread; errors and purchases are exits, all else enters; the routine is the event's
    type and the call site the number k of its properties modulo 4. granularity: microseconds a tick.
    """
    exits = F.col("event_type").isin("error", "purchase")
    site = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) % 4
    return events.select(
        F.lit(trace_id).alias("trace_id"),
        F.col("user_id").alias("tid"),
        F.col("event_id").alias("seq"),
        F.when(exits, EXIT).otherwise(ENTER).alias("kind"),
        F.col("event_type").alias("routine_id"),
        site.alias("call_site"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / granularity).cast("long").alias("tick"),
    )


def read_event_log(spark: SparkSession, sf_dir: str, granularity: int = HOUR) -> DataFrame:
    return from_event_log(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet"), granularity)


def stream_event_log(spark: SparkSession, folder: str, granularity: int = HOUR) -> DataFrame:
    """The same of files that arrive in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return from_event_log(spark.readStream.schema(schema).parquet(folder), granularity)
