"""Expressions over events. None depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(ts: Column, interval: str) -> Column:
    """Start of the minute, hour, day or month of a TIMESTAMP_NTZ."""
    day = F.to_date(ts)
    if interval == "month":
        return F.trunc(day, "month").cast("timestamp_ntz")
    start = day.cast("timestamp_ntz")
    if interval == "day":
        return start
    minutes = F.minute(ts) if interval == "minute" else F.lit(0)
    return start + F.make_dt_interval(F.lit(0), F.hour(ts), minutes)


def metadata_equals(metadata: Column, key: str, value: str) -> Column:
    """Whether the JSON object has `key` (a name, not a path) with the JSON string `value`.

    Numbers, booleans and other values never match, nor does text that isn't a JSON object.
    """
    found = F.element_at(F.from_json(metadata, "map<string,variant>"), F.lit(key))
    return (F.schema_of_variant(found) == "STRING") & (F.try_variant_get(found, "$", "string") == value)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with milliseconds."""
    return F.timestamp_diff("MILLISECOND", start, end) / F.lit(1000.0)


def utc_milliseconds(instant: Column) -> Column:
    """A TIMESTAMP as UTC wall clock, cut to milliseconds."""
    return F.timestamp_add("MILLISECOND", F.unix_millis(instant), F.lit("1970-01-01").cast("timestamp_ntz"))


def event_time(text: Column) -> Column:
    """ISO-8601 text as UTC wall clock in milliseconds, null if it can't be read; without an offset it is UTC."""
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    zoned = F.when(dated.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), dated).otherwise(F.concat(dated, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), utc_milliseconds(zoned.try_cast("timestamp")))


def cut_to_milliseconds(ts: Column) -> Column:
    """A TIMESTAMP_NTZ without what is below a millisecond."""
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long") % 1000
    return F.timestamp_add("MICROSECOND", -micros, ts)
