"""The stored events: Parquet, one folder a day, rows of a tenant side by side."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.events import bucket
from tidewell.schema import DEDUP_KEY, EVENT_DATE, EVENT_SCHEMA

STORED_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField(EVENT_DATE, T.DateType())])


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Rows are dealt by day and, within it, by tenant, each file with a narrow range of keys for
    row groups to be skipped by. Spark joins small parts and splits large ones by their bytes,
    so a small batch writes few files and a large tenant's day as many as it needs."""
    dated = events.select(*EVENT_SCHEMA.names, F.to_date("timestamp").alias(EVENT_DATE))
    dealt = dated.hint("rebalance", EVENT_DATE, "project_id", "tenant_id")
    ordered = dealt.sortWithinPartitions(EVENT_DATE, "project_id", "tenant_id", "event_type", "timestamp")
    ordered.write.mode(mode).partitionBy(EVENT_DATE).option("compression", "zstd").parquet(path)


def read_events(spark: SparkSession, path: str, final: bool = False) -> DataFrame:
    """The table as it is, duplicates included; with `final`, one row of each event: the last written."""
    rows = spark.read.schema(STORED_SCHEMA).parquet(path)
    if not final:
        return rows
    written = rows.select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_name").alias("_file"))
    return deduplicated(written, F.desc("_at"), F.desc("_file")).drop("_at", "_file")


def deduplicated(events: DataFrame, *latest_first) -> DataFrame:
    """One row for each DEDUP_KEY, the first in the given order.

    The day follows from the key; it is named too, so that a filter on days reaches the scan.
    """
    day = [EVENT_DATE] if EVENT_DATE in events.columns else []
    order = Window.partitionBy(*DEDUP_KEY, *day).orderBy(*(latest_first or [F.lit(0)]))
    return events.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def retained(events: DataFrame, now: datetime, days: int) -> DataFrame:
    """Events younger than `days` days, by the second. Whole days before that aren't read."""
    cut = now - timedelta(days=days)
    second = bucket(F.col("timestamp"), "minute") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(F.second("timestamp")))
    kept = events.where(second > F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz"))
    return kept.where(F.col(EVENT_DATE) >= F.lit(cut.date())) if EVENT_DATE in events.columns else kept


def compact(spark: SparkSession, path: str, target: str, now: datetime, days: int) -> None:
    """Writes the table without duplicates and expired events to `target`, which then replaces it."""
    write_events(retained(read_events(spark, path, final=True), now, days), target, "overwrite")


def truncate(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], EVENT_SCHEMA).withColumn(EVENT_DATE, F.to_date("timestamp")).write.mode("overwrite").parquet(path)


def is_ready(spark: SparkSession) -> bool:
    """Whether a query can run."""
    return spark.sql("SELECT 1 AS one").first().one == 1
