from datetime import datetime, timedelta

import pytest

from tidewell.auth import ApiKeys, Tokens
from tidewell.config import EngineConfig
from tidewell.requests import RequestError, active_request, instant, sessions_request, timeline_request, timeseries_request, top_request
from tidewell.streaming.ingest import delay_ms

NOW = datetime(2026, 6, 15, 12)


@pytest.mark.parametrize("text, limit", [("0", 1), ("-5", 1), ("999999", 10_000), ("x", 100), ("99999999999", 100), (None, 100), ("7", 7)])
def test_limits_are_clamped_and_unreadable_ones_default(text, limit):
    assert timeline_request("p", "t", limit=text).limit == limit


def test_defaults():
    series = timeseries_request("p", "t", NOW)
    assert (series.start, series.end, series.interval, series.limit, series.group_by) == (NOW - timedelta(days=1), NOW, "hour", 10_000, None)
    assert (active_request("p", "t", NOW).by, active_request("p", "t", NOW).mode) == ("user", "exact")
    assert top_request("p", "t", NOW).limit == 20
    assert top_request("p", "t", NOW, config=EngineConfig(max_query_limit=10)).limit == 10
    assert sessions_request("p", "t", NOW, start="no date").start == NOW - timedelta(days=1)


@pytest.mark.parametrize("call, status", [
    (lambda: timeline_request(" ", "t"), 403), (lambda: timeline_request("p", None), 403), (lambda: timeline_request("p" * 257, "t"), 400),
    (lambda: timeline_request("p", "t", event_type="x" * 257), 400), (lambda: timeseries_request("p", "t", NOW, interval="HOUR"), 400),
    (lambda: timeseries_request("p", "t", NOW, group_by="user_id"), 400), (lambda: active_request("p", "t", NOW, start="2026-06-16", end="2026-06-15"), 400),
    (lambda: top_request("p", "t", NOW, dimension="session_id"), 400),
])
def test_refusals(call, status):
    with pytest.raises(RequestError) as e:
        call()
    assert e.value.status == status


def test_accepted_borders():
    assert timeline_request("p", "t", event_type="x" * 256).event_type == "x" * 256
    assert timeline_request("p", "t", event_type="  ").event_type is None
    half = timeline_request("p", "t", meta_key="plan")
    assert (half.meta_key, half.meta_value) == (None, None)
    same = active_request("p", "t", NOW, start="2026-06-15", end="2026-06-15", interval="")
    assert same.start == same.end and same.interval == "day"


def test_instants_are_utc_milliseconds():
    assert instant("2026-01-01T02:00:00.123456+02:00") == datetime(2026, 1, 1, 0, 0, 0, 123000)
    assert instant("2026-01-01") == datetime(2026, 1, 1)
    assert instant("soon") is None


def test_delays_double_up_to_the_ceiling():
    assert [delay_ms(k, 30_000) for k in range(6)] == [1000, 2000, 4000, 8000, 16_000, 30_000]


def test_keys_and_tokens():
    import base64
    import hashlib
    import hmac
    import json

    keys = ApiKeys(["a"])
    assert keys.allows("a") and keys.allows(None, "a") and not keys.allows("b", "a") and not ApiKeys([]).allows("")
    key = "k" * 32
    code = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()

    def token(body, key=key, alg="HS256"):
        signed = code(json.dumps({"alg": alg}).encode()) + "." + code(json.dumps(body).encode())
        return signed + "." + code(hmac.new(key.encode(), signed.encode(), hashlib.sha256).digest())

    at = NOW.timestamp()
    from datetime import UTC

    at = NOW.replace(tzinfo=UTC).timestamp()
    good = {"project_id": "p", "tenant_id": "t", "exp": at - 20}
    assert Tokens(key).scope(token(good), NOW).tenant_id == "t"
    for bad, status in ((token(good, "z" * 32), 401), (token(good, alg="none"), 401), (token(good | {"exp": at - 40}), 401), (token({"exp": at}), 403), ("x", 401)):
        with pytest.raises(RequestError) as e:
            Tokens(key).scope(bad, NOW)
        assert e.value.status == status
    with pytest.raises(ValueError):
        Tokens("short")
