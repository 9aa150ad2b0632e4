"""Events as JSON: reading and checking what arrives, and writing lines that last.

Reading is strict. A field that isn't a JSON string or null, an id that isn't a UUID or a
time that can't be read makes the whole event invalid; so do a missing project, tenant,
session or event type. Invalid events are told apart, not lost silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.config import EngineConfig
from tidewell.functions.events import event_time, utc_milliseconds
from tidewell.schema import EVENT_SCHEMA, JSON_NAMES

_OBJECT = "map<string,variant>"
_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
REQUIRED = ("project_id", "tenant_id", "session_id", "event_type")


def _typed(fields: Column, received: Column) -> tuple[list[Column], Column]:
    """The table's columns from a JSON object's fields, and whether they make an event."""
    value = {c: F.element_at(fields, F.lit(n)) for c, n in JSON_NAMES.items()}
    text = {c: F.try_variant_get(v, "$", "string") for c, v in value.items()}
    ok = fields.isNotNull()
    for v in value.values():
        ok = ok & F.coalesce(F.schema_of_variant(v).isin("STRING", "VOID"), F.lit(True))
    for name in REQUIRED:
        ok = ok & F.coalesce(text[name] != "", F.lit(False))
    ok = ok & F.coalesce(text["event_id"].rlike(_UUID), F.lit(True))
    when = event_time(text["timestamp"])
    ok = ok & (text["timestamp"].isNull() | when.isNotNull())
    default = {"event_id": F.lower(F.coalesce(text["event_id"], F.expr("uuid()"))), "metadata_json": F.coalesce(text["metadata_json"], F.lit("{}")), "timestamp": F.coalesce(when, received)}
    return [default.get(c, text[c]).alias(c) for c in JSON_NAMES], F.coalesce(ok, F.lit(False))


def _received(received: Column | None) -> Column:
    return utc_milliseconds(F.current_timestamp()) if received is None else received


def single_events(bodies: DataFrame, received: Column | None = None, value: str = "value", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Each row's `value` is one event. Adds nothing to the table's columns but `is_valid`."""
    columns, ok = _typed(F.from_json(F.col(value), _OBJECT), _received(received))
    small = F.coalesce(F.octet_length(F.col(value)) <= config.max_body_bytes, F.lit(False))
    return bodies.select(*columns, (ok & small).alias("is_valid"))


def batched_events(bodies: DataFrame, received: Column | None = None, value: str = "value", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Each row's `value` is an array of events, which count one by one. An array that can't be read has none, one that is too large is one invalid event."""
    large = F.octet_length(F.col(value)) > config.max_body_bytes
    fields = F.when(large, F.array(F.lit(None).cast(_OBJECT))).otherwise(F.from_json(F.col(value), f"array<{_OBJECT}>"))
    each = bodies.select(F.explode(fields).alias("_fields"))
    columns, ok = _typed(F.col("_fields"), _received(received))
    return each.select(*columns, ok.alias("is_valid"))


def valid(events: DataFrame) -> DataFrame:
    """The valid events as rows of the table."""
    return events.where("is_valid").select(*EVENT_SCHEMA.names)


def as_lines(events: DataFrame) -> DataFrame:
    """One JSON object an event in `value`; null fields are left out. Ids and times are written out, so reading a line twice gives one event."""
    columns = [(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if c == "timestamp" else F.col(c)).alias(n) for c, n in JSON_NAMES.items()]
    return events.select(F.to_json(F.struct(*columns)).alias("value"))


def land(events: DataFrame, folder: str) -> None:
    """Appends the events as lines to the landing folder. Files appear whole or not at all."""
    as_lines(events).write.mode("append").text(folder)
