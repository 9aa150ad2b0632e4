"""The test events, which have no tenant, session or item, as rows of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.events import cut_to_milliseconds


def sample_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column follows from event_id, user_id and ts, so another engine can derive the same."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    event, user = F.col("event_id"), F.col("user_id")
    plans = F.when(event % 3 == 0, '{"plan":"pro"}').when(event % 3 == 1, '{"plan":"free"}').otherwise(F.col("props"))
    return raw.select(
        event.cast("string").alias("event_id"),
        F.concat(F.lit("p"), (user % 2).cast("string")).alias("project_id"),
        F.concat(F.lit("t"), (user % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("s"), user.cast("string"), F.lit("-"), F.regexp_replace(F.to_date("ts").cast("string"), "-", "")).alias("session_id"),
        F.when(event % 10 != 0, F.concat(F.lit("u"), user.cast("string"))).alias("user_id"),
        "event_type",
        F.when(event % 4 != 0, F.concat(F.lit("/item/"), (event % 20).cast("string"))).alias("item_id"),
        plans.alias("metadata_json"),
        cut_to_milliseconds(F.col("ts")).alias("timestamp"),
    )


#: The same in SQL, for a table `events`.
SAMPLE_SQL = """
SELECT event_id::VARCHAR AS event_id, 'p' || (user_id % 2)::VARCHAR AS project_id, 't' || (user_id % 3)::VARCHAR AS tenant_id,
       's' || user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS session_id,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'u' || user_id::VARCHAR END AS user_id, event_type,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE '/item/' || (event_id % 20)::VARCHAR END AS item_id,
       CASE WHEN event_id % 3 = 0 THEN '{"plan":"pro"}' WHEN event_id % 3 = 1 THEN '{"plan":"free"}' ELSE props END AS metadata_json,
       date_trunc('millisecond', ts) AS timestamp
FROM events
"""
