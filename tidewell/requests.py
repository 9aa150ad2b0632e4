"""Validated requests: raw strings become immutable values, or a RequestError with a status."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from tidewell.config import EngineConfig

INTERVALS = ("minute", "hour", "day")
ACTIVE_INTERVALS = ("day", "month")
SERIES = ("event_type", "item_id", "session_id")
ACTIVE_BY = ("user", "session")
MODES = ("exact", "approx")
DIMENSIONS = ("event_type", "item_id")
TOP_LIMIT = 20
LIST_LIMIT = 100


class RequestError(ValueError):
    def __init__(self, status: int, message: str = ""):
        super().__init__(message or str(status))
        self.status, self.message = status, message


@dataclass(frozen=True)
class TenantScope:
    """Whose events a query may see. Comes from verified claims only."""

    project_id: str
    tenant_id: str


@dataclass(frozen=True)
class TimelineRequest:
    scope: TenantScope
    limit: int = LIST_LIMIT
    before: datetime | None = None
    event_type: str | None = None
    session_id: str | None = None
    item_id: str | None = None
    meta_key: str | None = None
    meta_value: str | None = None


@dataclass(frozen=True)
class RangeRequest:
    scope: TenantScope
    start: datetime
    end: datetime
    limit: int


@dataclass(frozen=True)
class TimeSeriesRequest(RangeRequest):
    interval: str = "hour"
    event_type: str | None = None
    group_by: str | None = None


@dataclass(frozen=True)
class ActiveRequest(RangeRequest):
    interval: str = "day"
    by: str = "user"
    mode: str = "exact"


@dataclass(frozen=True)
class TopRequest(RangeRequest):
    dimension: str = "event_type"


@dataclass(frozen=True)
class SessionsRequest(RangeRequest):
    pass


def _units(text: str) -> int:
    """Length in UTF-16 units, by which limits count."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _scope(project: str | None, tenant: str | None, config: EngineConfig) -> TenantScope:
    if not (project or "").strip() or not (tenant or "").strip():
        raise RequestError(403)
    if max(_units(project), _units(tenant)) > config.max_text_units:
        raise RequestError(400, "a claim is too long")
    return TenantScope(project, tenant)


def _choice(name: str, value: str | None, allowed: tuple[str, ...], default: str | None) -> str | None:
    if not value:
        return default
    if value not in allowed:
        raise RequestError(400, f"{name} must be one of: {', '.join(allowed)}")
    return value


def _limit(value: str | None, default: int, config: EngineConfig) -> int:
    """Text that isn't a 32-bit integer counts as absent."""
    try:
        n = int(value) if value is not None and "_" not in value else None
    except ValueError:
        n = None
    if n is None or not -(2**31) <= n < 2**31:
        return default
    return max(1, min(n, config.max_query_limit))


def instant(value: str | None) -> datetime | None:
    """An ISO-8601 instant as UTC wall clock in milliseconds; without an offset it is UTC. None if it can't be read."""
    try:
        t = datetime.fromisoformat(value.strip())
    except (AttributeError, ValueError):
        return None
    t = t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t
    return t.replace(microsecond=t.microsecond // 1000 * 1000)


def _range(start: str | None, end: str | None, now: datetime, config: EngineConfig) -> tuple[datetime, datetime]:
    low = instant(start) or now - timedelta(hours=config.default_range_hours)
    high = instant(end) or now
    if low > high:
        raise RequestError(400, "from is after to")
    return low, high


def _filter(name: str, value: str | None, config: EngineConfig) -> str | None:
    if not (value or "").strip():
        return None
    if _units(value) > config.max_text_units:
        raise RequestError(400, f"{name} is too long")
    return value


def timeline_request(project: str | None, tenant: str | None, limit: str | None = None, before: str | None = None, event_type: str | None = None, session_id: str | None = None, item_id: str | None = None, meta_key: str | None = None, meta_value: str | None = None, config: EngineConfig = EngineConfig()) -> TimelineRequest:
    scope = _scope(project, tenant, config)
    key, value = _filter("metaKey", meta_key, config), _filter("metaValue", meta_value, config)
    if key is None or value is None:  # half a filter is none
        key = value = None
    return TimelineRequest(scope, _limit(limit, LIST_LIMIT, config), instant(before), _filter("eventType", event_type, config), _filter("sessionId", session_id, config), _filter("itemId", item_id, config), key, value)


def timeseries_request(project: str | None, tenant: str | None, now: datetime, limit: str | None = None, interval: str | None = None, start: str | None = None, end: str | None = None, event_type: str | None = None, group_by: str | None = None, config: EngineConfig = EngineConfig()) -> TimeSeriesRequest:
    scope = _scope(project, tenant, config)
    step = _choice("interval", interval, INTERVALS, "hour")
    rows = _limit(limit, config.max_query_limit, config)
    low, high = _range(start, end, now, config)
    kind = _filter("eventType", event_type, config)
    return TimeSeriesRequest(scope, low, high, rows, step, kind, _choice("groupBy", group_by, SERIES, None))


def active_request(project: str | None, tenant: str | None, now: datetime, limit: str | None = None, interval: str | None = None, by: str | None = None, mode: str | None = None, start: str | None = None, end: str | None = None, config: EngineConfig = EngineConfig()) -> ActiveRequest:
    scope = _scope(project, tenant, config)
    step, who, how = _choice("interval", interval, ACTIVE_INTERVALS, "day"), _choice("by", by, ACTIVE_BY, "user"), _choice("mode", mode, MODES, "exact")
    rows = _limit(limit, config.max_query_limit, config)
    return ActiveRequest(scope, *_range(start, end, now, config), rows, step, who, how)


def top_request(project: str | None, tenant: str | None, now: datetime, limit: str | None = None, dimension: str | None = None, start: str | None = None, end: str | None = None, config: EngineConfig = EngineConfig()) -> TopRequest:
    scope = _scope(project, tenant, config)
    what = _choice("dimension", dimension, DIMENSIONS, "event_type")
    rows = _limit(limit, min(TOP_LIMIT, config.max_query_limit), config)
    return TopRequest(scope, *_range(start, end, now, config), rows, what)


def sessions_request(project: str | None, tenant: str | None, now: datetime, limit: str | None = None, start: str | None = None, end: str | None = None, config: EngineConfig = EngineConfig()) -> SessionsRequest:
    scope = _scope(project, tenant, config)
    rows = _limit(limit, LIST_LIMIT, config)
    return SessionsRequest(scope, *_range(start, end, now, config), rows)
