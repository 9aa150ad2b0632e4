"""The queries over the events table by name, with the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.config import EngineConfig
from tidewell.operators.analytics import active, sessions, sessions_summary, timeline, timeseries, top, total_count
from tidewell.requests import ActiveRequest, SessionsRequest, TenantScope, TimelineRequest, TimeSeriesRequest, TopRequest
from tidewell.sources.events_table import deduplicated, retained
from tidewell.sources.payloads import as_lines, batched_events, single_events, valid
from tidewell.sources.sample_events import SAMPLE_SQL, sample_events

Query = Callable[[SparkSession, str], DataFrame]

SCOPE = TenantScope("p0", "t1")
START, END = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)
BEFORE, NOW = datetime(2024, 1, 15), datetime(2024, 4, 10)
LIMIT, PAGE, RETENTION_DAYS = 10_000, 100, 90
#: Share by which an approximate count may differ from the exact one.
TOLERANCE = 0.05
#: Bytes of events in a batch, on average and at most; a longer event has a batch of its own.
BATCH_BYTES, MOST_BATCH_BYTES = EngineConfig().max_body_bytes // 4, EngineConfig().max_body_bytes // 2

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_WITH = f"WITH e AS ({SAMPLE_SQL}), o AS (SELECT * FROM e WHERE project_id = 'p0' AND tenant_id = 't1'), r AS (SELECT * FROM o WHERE timestamp >= '{START}'::TIMESTAMP AND timestamp <= '{END}'::TIMESTAMP) "


def _add(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(sample_events(spark, sf_dir))
    ORACLE[name] = _WITH + sql


def _timeline(name: str, where: str, **filters) -> None:
    request = TimelineRequest(SCOPE, PAGE, **filters)
    _add(name, lambda e: timeline(e, request), f"SELECT event_id, session_id, user_id, event_type, item_id, metadata_json, timestamp FROM o WHERE {where} ORDER BY timestamp DESC, event_id LIMIT {PAGE}")


def _timeseries(name: str, interval: str, where: str = "true", series: str | None = None, limit: int = LIMIT, **filters) -> None:
    request = TimeSeriesRequest(SCOPE, START, END, limit, interval, group_by=series, **filters)
    keys, group, order = (f", {series} AS series", f", {series}", ", series NULLS LAST") if series else ("", "", "")
    _add(name, lambda e: timeseries(e, request), f"SELECT date_trunc('{interval}', timestamp)::TIMESTAMP AS bucket{keys}, count(*) AS event_count FROM r WHERE {where} GROUP BY date_trunc('{interval}', timestamp){group} ORDER BY bucket{order} LIMIT {limit}")


def _active(interval: str, by: str) -> None:
    request = ActiveRequest(SCOPE, START, END, LIMIT, interval, by)
    _add(f"active_{by}_{interval}", lambda e: active(e, request), f"SELECT date_trunc('{interval}', timestamp)::TIMESTAMP AS bucket, count(DISTINCT {by}_id) AS active_count FROM r GROUP BY 1 ORDER BY 1 LIMIT {LIMIT}")


def _approximate(events: DataFrame) -> DataFrame:
    """Whether approximate counts are near the exact ones; the estimates themselves have no SQL."""
    everyone = events.withColumns({"project_id": F.lit("p0"), "tenant_id": F.lit("t1")})
    exact = active(everyone, ActiveRequest(SCOPE, START, END, LIMIT))
    rough = active(everyone, ActiveRequest(SCOPE, START, END, LIMIT, mode="approx")).withColumnRenamed("active_count", "rough")
    near = F.abs(F.col("rough") - F.col("active_count")) <= TOLERANCE * F.col("active_count")
    return exact.join(rough, "bucket").select("bucket", F.col("active_count").alias("exact"), near.alias("near"))


def _arrived(events: DataFrame) -> DataFrame:
    """The events as JSON, with a UUID each; some lack what an event needs."""
    uuid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad("event_id", 12, "0"))
    n = F.col("event_id").cast("long")
    broken = {"session_id": F.when(n % 7 != 0, F.col("session_id")).otherwise(""), "tenant_id": F.when(n % 11 != 0, F.col("tenant_id"))}
    return events.withColumns(broken | {"event_id": uuid})


_ARRIVED = """SELECT '00000000-0000-0000-0000-' || lpad(event_id, 12, '0') AS event_id, project_id, tenant_id, session_id, user_id, event_type, item_id, metadata_json, timestamp
FROM e WHERE event_id::BIGINT % 7 <> 0 AND event_id::BIGINT % 11 <> 0"""


def _batched(events: DataFrame) -> DataFrame:
    """The events in JSON arrays, as many as their bytes ask for; none is larger than a body may be."""
    lines = as_lines(_arrived(events)).withColumn("size", F.octet_length("value") + 1)
    batches = (lines.agg(F.sum("size")).first()[0] or 0) // BATCH_BYTES + 1
    before = Window.partitionBy("batch").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    long = F.col("size") > MOST_BATCH_BYTES
    # a batch that came out large is cut, with its long events apart
    part = F.when(long, -1 - F.count("*").over(before)).otherwise(F.floor(F.coalesce(F.sum(F.when(~long, F.col("size"))).over(before), F.lit(0)) / MOST_BATCH_BYTES))
    lines = lines.withColumn("batch", F.pmod(F.xxhash64("value"), F.lit(batches))).withColumn("part", part)
    return lines.groupBy("batch", "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))


_timeline("timeline", "true")
_timeline("timeline_before_cursor", f"timestamp < '{BEFORE}'::TIMESTAMP", before=BEFORE)
_timeline("timeline_event_type", "event_type = 'click'", event_type="click")
_timeline("timeline_session", "session_id = 's4-20240110'", session_id="s4-20240110")
_timeline("timeline_item", "item_id = '/item/7'", item_id="/item/7")
_timeline("timeline_metadata", "json_type(metadata_json, '$.plan') = 'VARCHAR' AND metadata_json->>'$.plan' = 'pro'", meta_key="plan", meta_value="pro")
_add("timeline_metadata_nonstring", lambda e: timeline(e, TimelineRequest(SCOPE, PAGE, meta_key="k", meta_value="69")).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM o WHERE json_type(metadata_json, '$.k') = 'VARCHAR' AND metadata_json->>'$.k' = '69'")
for _interval in ("minute", "hour", "day"):
    _timeseries(f"timeseries_{_interval}", _interval)
_timeseries("timeseries_event_type_filter", "hour", "event_type = 'purchase'", event_type="purchase")
_timeseries("timeseries_by_event_type", "day", series="event_type")
_timeseries("timeseries_by_item", "day", series="item_id", limit=40)
_timeseries("timeseries_by_session", "day", series="session_id")
_add("timeseries_total", lambda e: total_count(timeseries(e, TimeSeriesRequest(SCOPE, START, END, 5, "day"))), "SELECT coalesce(sum(n), 0)::BIGINT AS total_count FROM (SELECT count(*) AS n FROM r GROUP BY date_trunc('day', timestamp) ORDER BY date_trunc('day', timestamp) LIMIT 5)")
for _interval in ("day", "month"):
    for _by in ("user", "session"):
        _active(_interval, _by)
_add("active_user_day_approx", _approximate, f"SELECT date_trunc('day', timestamp)::TIMESTAMP AS bucket, count(DISTINCT user_id) AS exact, true AS near FROM e WHERE timestamp >= '{START}'::TIMESTAMP AND timestamp <= '{END}'::TIMESTAMP GROUP BY 1 ORDER BY 1 LIMIT {LIMIT}")
_add("top_event_type", lambda e: top(e, TopRequest(SCOPE, START, END, 20)), "SELECT event_type AS key, count(*) AS event_count FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_add("top_item", lambda e: top(e, TopRequest(SCOPE, START, END, 5, "item_id")), "SELECT item_id AS key, count(*) AS event_count FROM r WHERE item_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
_SESSIONS = f"SELECT session_id, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS event_count, date_diff('millisecond', min(timestamp), max(timestamp)) / 1000.0::DOUBLE AS duration_seconds FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {PAGE}"
_add("sessions", lambda e: sessions(e, SessionsRequest(SCOPE, START, END, PAGE)), _SESSIONS)
_add("sessions_summary", lambda e: sessions_summary(sessions(e, SessionsRequest(SCOPE, START, END, PAGE))).withColumn("avg_duration_seconds", F.round("avg_duration_seconds", 6)), f"SELECT count(*)::INTEGER AS unique_session_count, coalesce(sum(event_count), 0)::BIGINT AS total_event_count, round(coalesce(avg(duration_seconds), 0.0), 6) AS avg_duration_seconds FROM ({_SESSIONS})")
_add("dedup_final", lambda e: deduplicated(e.union(e)), "SELECT * FROM e")
_add("retention", lambda e: retained(e, NOW, RETENTION_DAYS), f"SELECT * FROM e WHERE date_trunc('second', timestamp) + INTERVAL {RETENTION_DAYS} DAY > '{NOW}'::TIMESTAMP")
_add("valid_payloads", lambda e: valid(single_events(as_lines(_arrived(e)))), _ARRIVED)
_add("batch_json_roundtrip", lambda e: as_lines(valid(batched_events(_batched(e)))).select(F.sha2(F.col("value").cast("binary"), 256).alias("line_sha256")), """, a AS (SELECT * FROM (""" + _ARRIVED + """))
SELECT sha256('{"eventId":' || to_json(event_id) || ',"projectId":' || to_json(project_id) || ',"tenantId":' || to_json(tenant_id) || ',"sessionId":' || to_json(session_id)
  || coalesce(',"userId":' || to_json(user_id), '') || ',"eventType":' || to_json(event_type) || coalesce(',"itemId":' || to_json(item_id), '') || ',"metadataJson":' || to_json(metadata_json)
  || ',"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}') AS line_sha256 FROM a""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["timeseries_by_event_type"](spark, sf_dir)
