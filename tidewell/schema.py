"""Schemas of events: as they arrive in JSON, and as the table holds them."""

from pyspark.sql import types as T

#: JSON name of each column, in the table's order.
JSON_NAMES = {
    "event_id": "eventId",
    "project_id": "projectId",
    "tenant_id": "tenantId",
    "session_id": "sessionId",
    "user_id": "userId",
    "event_type": "eventType",
    "item_id": "itemId",
    "metadata_json": "metadataJson",
    "timestamp": "timestamp",
}

#: The table. Times are UTC wall clock in milliseconds; null user_id means an anonymous event.
EVENT_SCHEMA = T.StructType(
    [T.StructField(name, T.TimestampNTZType() if name == "timestamp" else T.StringType(), name in ("user_id", "item_id")) for name in JSON_NAMES]
)

#: The partition column of the stored table.
EVENT_DATE = "event_date"

#: Rows that agree in these are one event. The same event_id at another time is another event.
DEDUP_KEY = ("project_id", "tenant_id", "event_type", "timestamp", "event_id")
