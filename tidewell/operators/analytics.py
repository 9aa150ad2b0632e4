"""The five queries. Each takes the events and a request and returns a plan of few rows.

Ties have a last sort key, so that a limit always keeps the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.events import bucket, metadata_equals, seconds_between
from tidewell.operators.scope import scoped
from tidewell.requests import ActiveRequest, RangeRequest, SessionsRequest, TimelineRequest, TimeSeriesRequest, TopRequest

TIMELINE_COLUMNS = ("event_id", "session_id", "user_id", "event_type", "item_id", "metadata_json", "timestamp")
#: Relative standard deviation of approximate counts.
APPROXIMATE = 0.01


def timeline(events: DataFrame, request: TimelineRequest) -> DataFrame:
    """Newest events first. A page goes on strictly before the last time of the page before it."""
    rows = scoped(events, request.scope, before=request.before)
    for name in ("event_type", "session_id", "item_id"):
        if value := getattr(request, name):
            rows = rows.where(F.col(name) == value)
    if request.meta_key and request.meta_value:
        rows = rows.where(metadata_equals(F.col("metadata_json"), request.meta_key, request.meta_value))
    return rows.select(*TIMELINE_COLUMNS).orderBy(F.desc("timestamp"), "event_id").limit(request.limit)


def timeseries(events: DataFrame, request: TimeSeriesRequest) -> DataFrame:
    """Counts by time, and by series if asked for; events without an item are a series of their own, last.

    Times without events have no row. The limit counts rows and may cut a time in two.
    """
    rows = scoped(events, request.scope, request.start, request.end)
    if request.event_type:
        rows = rows.where(F.col("event_type") == request.event_type)
    keys = [bucket(F.col("timestamp"), request.interval).alias("bucket")]
    order = [F.asc("bucket")]
    if request.group_by:
        keys.append(F.col(request.group_by).alias("series"))
        order.append(F.asc_nulls_last("series"))
    return rows.groupBy(*keys).agg(F.count("*").alias("event_count")).orderBy(*order).limit(request.limit)


def active(events: DataFrame, request: ActiveRequest) -> DataFrame:
    """Distinct users or sessions by day or month; a time with anonymous events only counts 0.

    Counts of days don't add up to that of their month.
    """
    who = F.col(f"{request.by}_id")
    count = F.count_distinct(who) if request.mode == "exact" else F.approx_count_distinct(who, APPROXIMATE)
    rows = scoped(events, request.scope, request.start, request.end)
    return rows.groupBy(bucket(F.col("timestamp"), request.interval).alias("bucket")).agg(count.alias("active_count")).orderBy("bucket").limit(request.limit)


def top(events: DataFrame, request: TopRequest) -> DataFrame:
    """The most frequent event types, or items; events without an item don't count there."""
    rows = scoped(events, request.scope, request.start, request.end)
    if request.dimension == "item_id":
        rows = rows.where(F.col("item_id").isNotNull())
    return rows.groupBy(F.col(request.dimension).alias("key")).agg(F.count("*").alias("event_count")).orderBy(F.desc("event_count"), "key").limit(request.limit)


def sessions(events: DataFrame, request: SessionsRequest) -> DataFrame:
    """First and last time, events and seconds of each session, over its events in the range; latest start first."""
    rows = scoped(events, request.scope, request.start, request.end)
    found = rows.groupBy("session_id").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("event_count"))
    found = found.orderBy(F.desc("first_seen"), "session_id").limit(request.limit)
    return found.withColumn("duration_seconds", seconds_between(F.col("first_seen"), F.col("last_seen")))


def sessions_summary(page: DataFrame) -> DataFrame:
    """Totals of the sessions that were returned, not of all."""
    return page.agg(F.count("*").cast("int").alias("unique_session_count"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_event_count"), F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_duration_seconds"))


def total_count(points: DataFrame) -> DataFrame:
    """Sum over the points that were returned."""
    return points.agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_count"))


def as_json(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """One JSON object a row in `value`, with the given names and without null properties."""
    columns = [(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if dict(rows.dtypes)[c] == "timestamp_ntz" else F.col(c)).alias(n) for c, n in names.items()]
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


_POINTS = {"bucket": "bucket", "series": "series", "event_count": "count", "active_count": "activeCount", "key": "key", "session_id": "sessionId", "first_seen": "firstSeen", "last_seen": "lastSeen", "duration_seconds": "durationSeconds", "event_id": "eventId", "user_id": "userId", "event_type": "eventType", "item_id": "itemId", "metadata_json": "metadataJson", "timestamp": "timestamp"}


def _iso(t: datetime) -> str:
    return t.isoformat(timespec="milliseconds") + "Z"


def envelope(rows: DataFrame, request: TimelineRequest | RangeRequest) -> dict:
    """The answer as a whole: the request's terms, the rows (as many as its limit at most) and their totals."""
    out = {"projectId": request.scope.project_id, "tenantId": request.scope.tenant_id}
    if isinstance(request, RangeRequest):
        out |= {"from": _iso(request.start), "to": _iso(request.end)}
    out |= {n: getattr(request, n) for n in ("interval", "by", "mode", "dimension") if hasattr(request, n)}
    found = [r.asDict() for r in rows.collect()]
    if isinstance(request, TimeSeriesRequest):
        out["totalCount"] = sum(r["event_count"] for r in found)
    if isinstance(request, SessionsRequest):
        seconds = [r["duration_seconds"] for r in found]
        out |= {"uniqueSessionCount": len(found), "totalEventCount": sum(r["event_count"] for r in found), "avgDurationSeconds": sum(seconds) / len(seconds) if seconds else 0.0}
    names = _POINTS | ({"event_count": "eventCount"} if isinstance(request, SessionsRequest) else {})
    out["items"] = [{names[k]: _iso(v) if isinstance(v, datetime) else v for k, v in r.items() if v is not None} for r in found]
    return out
