"""The one place where a query is bound to a tenant and a time range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.requests import TenantScope
from tidewell.schema import EVENT_DATE


def _time(t: datetime):
    return F.lit(t.isoformat(sep=" ", timespec="milliseconds")).cast("timestamp_ntz")


def scoped(events: DataFrame, scope: TenantScope, start: datetime | None = None, end: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """Events of one tenant from start to end, both included, and before `before`, not included.

    Bounds on the time are repeated on the partition column, where the table has one, as Spark
    doesn't derive them; so only the days in question are listed and read.
    """
    out = events.where((F.col("project_id") == scope.project_id) & (F.col("tenant_id") == scope.tenant_id))
    ts, day, dated = F.col("timestamp"), F.col(EVENT_DATE), EVENT_DATE in events.columns
    if start is not None:
        out = out.where(ts >= _time(start))
        out = out.where(day >= F.lit(start.date())) if dated else out
    for bound, inside in ((end, lambda t: ts <= t), (before, lambda t: ts < t)):
        if bound is not None:
            out = out.where(inside(_time(bound)))
            out = out.where(day <= F.lit(bound.date())) if dated else out
    return out
