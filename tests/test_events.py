import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators.analytics import active, as_json, envelope, sessions, timeline, timeseries, top
from tidewell.plans import catalog
from tidewell.requests import ActiveRequest, SessionsRequest, TenantScope, TimelineRequest, TimeSeriesRequest, TopRequest
from tidewell.schema import EVENT_SCHEMA
from tidewell.sources import events_table
from tidewell.sources.payloads import batched_events, land, single_events, valid
from tidewell.streaming import ingest

SCOPE, OTHER = TenantScope("p", "t"), TenantScope("p", "other")
DAY = datetime(2026, 1, 31)
FOREVER = (datetime(2000, 1, 1), datetime(2100, 1, 1))


def events(spark, *rows):
    """Rows of (time, and what differs from a click in session s without user, item and metadata)."""
    base = {"project_id": "p", "tenant_id": "t", "session_id": "s", "user_id": None, "event_type": "click", "item_id": None, "metadata_json": "{}"}
    return spark.createDataFrame([base | {"event_id": f"e{i}", "timestamp": at} | more for i, (at, more) in enumerate(rows)], EVENT_SCHEMA)


def test_pages_go_on_before_the_last_time(spark):
    e = events(spark, *((DAY - timedelta(minutes=m), {}) for m in (3, 2, 1)))
    first = timeline(e, TimelineRequest(SCOPE, 2)).collect()
    assert [r.event_id for r in first] == ["e2", "e1"]
    assert [r.event_id for r in timeline(e, TimelineRequest(SCOPE, 2, before=first[-1].timestamp)).collect()] == ["e0"]
    assert timeline(e, TimelineRequest(OTHER, 2)).collect() == []


@pytest.mark.parametrize("metadata, key, hit", [
    ('{"plan":"pro"}', "plan", True), ('{"plan":5}', "plan", False), ('{"plan":null}', "plan", False), ('{"plan":["pro"]}', "plan", False), ('{"plan":{"a":"pro"}}', "plan", False),
    ("not json", "plan", False), ('{"a.b":"pro"}', "a.b", True), ('{"a":{"b":"pro"}}', "a.b", False), ('{"it\'s":"pro"}', "it's", True), ("{}", "plan", False), ('["pro"]', "plan", False),
])
def test_metadata_matches_json_strings_only(spark, metadata, key, hit):
    e = events(spark, (DAY, {"metadata_json": metadata}))
    assert timeline(e, TimelineRequest(SCOPE, 9, meta_key=key, meta_value="pro")).count() == hit


def test_ranges_include_both_ends_and_null_series_come_last(spark):
    e = events(spark, (DAY, {}), (DAY + timedelta(hours=1), {"item_id": "/z"}), (DAY + timedelta(hours=1, milliseconds=1), {}))
    rows = timeseries(e, TimeSeriesRequest(SCOPE, DAY, DAY + timedelta(hours=1), 10, "day", group_by="item_id")).collect()
    assert [(r.series, r.event_count) for r in rows] == [("/z", 1), (None, 1)]
    cut = timeseries(e, TimeSeriesRequest(SCOPE, *FOREVER, 1, "day", group_by="item_id"))
    assert envelope(cut, TimeSeriesRequest(SCOPE, *FOREVER, 1, "day"))["totalCount"] == 1


def test_active_users_over_month_ends_and_anonymous_days(spark):
    e = events(spark, (DAY, {"user_id": "u1"}), (DAY, {"user_id": "u1"}), (DAY + timedelta(days=1), {}), (datetime(2025, 12, 31), {"user_id": "u2"}))
    months = active(e, ActiveRequest(SCOPE, *FOREVER, 10, "month")).collect()
    assert [(r.bucket, r.active_count) for r in months] == [(datetime(2025, 12, 1), 1), (datetime(2026, 1, 1), 1), (datetime(2026, 2, 1), 0)]
    assert [r.active_count for r in active(e, ActiveRequest(SCOPE, *FOREVER, 10, "day", mode="approx")).collect()] == [1, 1, 0]


def test_top_skips_missing_items_and_settles_ties_by_name(spark):
    e = events(spark, (DAY, {"item_id": "/b"}), (DAY, {"item_id": "/a"}), (DAY, {}))
    assert [tuple(r) for r in top(e, TopRequest(SCOPE, *FOREVER, 5, "item_id")).collect()] == [("/a", 1), ("/b", 1)]


def test_sessions_are_clipped_by_the_range_and_folded(spark):
    e = events(spark, (DAY - timedelta(hours=1), {}), (DAY, {}), (DAY + timedelta(seconds=1.5), {}), (DAY, {"session_id": "z"}))
    request = SessionsRequest(SCOPE, DAY, FOREVER[1], 10)
    page = sessions(e, request)
    assert [(r.session_id, r.event_count, r.duration_seconds) for r in page.collect()] == [("s", 2, 1.5), ("z", 1, 0.0)]
    answer = envelope(page, request)
    assert (answer["uniqueSessionCount"], answer["totalEventCount"], answer["avgDurationSeconds"]) == (2, 3, 0.75)
    none = envelope(sessions(e, SessionsRequest(OTHER, *FOREVER, 10)), request)
    assert (none["uniqueSessionCount"], none["avgDurationSeconds"]) == (0, 0.0)


def test_json_leaves_nulls_out(spark):
    line = as_json(timeline(events(spark, (DAY, {})), TimelineRequest(SCOPE, 1)), {"user_id": "userId", "event_id": "eventId", "timestamp": "timestamp"}).first().value
    assert json.loads(line) == {"eventId": "e0", "timestamp": "2026-01-31T00:00:00.000Z"}


def payload(**more):
    return json.dumps({"eventId": "00000000-0000-0000-0000-0000000000aa", "projectId": "p", "tenantId": "t", "sessionId": "s", "eventType": "click", "timestamp": "2026-01-31T02:00:00.1239+02:00"} | more)


@pytest.mark.parametrize("more, ok", [
    ({}, True), ({"userId": None}, True), ({"userId": 5}, False), ({"eventType": ""}, False), ({"eventType": " "}, True), ({"tenantId": None}, False),
    ({"eventId": "x"}, False), ({"eventId": None}, True), ({"timestamp": "soon"}, False), ({"timestamp": None}, True), ({"metadataJson": None}, True),
])
def test_events_are_read_strictly(spark, more, ok):
    rows = single_events(spark.createDataFrame([(payload(**more),)], "value string")).collect()
    assert [r.is_valid for r in rows] == [ok]


def test_values_and_defaults_of_events(spark):
    r = valid(single_events(spark.createDataFrame([(payload(metadataJson=None),)], "value string"))).first()
    assert (r.timestamp, r.metadata_json, r.user_id) == (datetime(2026, 1, 31, 0, 0, 0, 123000), "{}", None)
    lines = spark.createDataFrame([("not json",), ("",), (None,), ("x" * (1 << 21),)], "value string")
    assert valid(single_events(lines)).count() == 0


def test_arrays_count_element_by_element(spark):
    bodies = spark.createDataFrame([(f"[{payload()},{{}},{payload(sessionId='z')}]",), ("[]",), ("[{bad",), (None,)], "value string")
    assert sorted(r.session_id for r in valid(batched_events(bodies)).collect()) == ["s", "z"]


def test_large_bodies_are_invalid_not_lost(spark):
    bodies = spark.createDataFrame([(f"[{payload(itemId='x' * (1 << 20))}]",), (f"[{payload()}]",)], "value string")
    assert sorted(r.is_valid for r in batched_events(bodies).collect()) == [False, True]


def test_batches_stay_small_enough_whatever_the_events(spark, monkeypatch):
    monkeypatch.setattr(catalog, "BATCH_BYTES", 1 << 30)  # all in one batch before it is cut
    rows = [(DAY, {"event_id": str(i), "metadata_json": json.dumps({"k": "x" * (600_000 if i < 3 else 30_000)})}) for i in range(80)]
    batches = catalog._batched(events(spark, *rows))
    assert batches.where(F.octet_length("value") > 1 << 20).count() == 0
    assert valid(batched_events(batches)).count() == sum(i % 7 != 0 and i % 11 != 0 for i in range(80))


def test_stored_duplicates_and_expired_rows_go_when_compacted(spark, tmp_path):
    path, target = str(tmp_path / "a"), str(tmp_path / "b")
    now = DAY + timedelta(days=90)
    e = events(spark, (DAY, {}), (DAY, {}), (DAY + timedelta(seconds=1), {}), (DAY - timedelta(days=100), {}))
    events_table.write_events(e, path)
    events_table.write_events(e, path)
    assert events_table.read_events(spark, path).count() == 8
    assert events_table.read_events(spark, path, final=True).count() == 4
    events_table.compact(spark, path, target, now, 90)
    assert [r.event_id for r in events_table.read_events(spark, target).collect()] == ["e2"]
    plan = events_table.read_events(spark, path).transform(lambda t: timeline(t, TimelineRequest(SCOPE, 1, before=DAY)))._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0] and "BatchEvalPython" not in plan
    assert events_table.is_ready(spark)


def test_final_reads_only_the_days_asked_for(spark, tmp_path):
    path = str(tmp_path / "a")
    events_table.write_events(events(spark, *((DAY - timedelta(days=d), {}) for d in range(5))), path)
    rows = timeline(events_table.read_events(spark, path, final=True), TimelineRequest(SCOPE, 9, before=DAY - timedelta(days=3)))
    assert [r.timestamp for r in rows.collect()] == [DAY - timedelta(days=4)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_files_follow_the_bytes_of_a_day(spark, tmp_path):
    import glob

    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    events_table.write_events(events(spark, *((DAY, {"tenant_id": f"t{i}"}) for i in range(40))), small)
    assert len(glob.glob(f"{small}/*/*.parquet")) <= 2
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        wide = events(spark, (DAY, {})).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40_000)))).withColumn("event_id", F.sha2(F.col("n").cast("string").cast("binary"), 256)).drop("n").repartition(16)
        events_table.write_events(wide, large)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(glob.glob(f"{large}/*/*.parquet")) >= 4
    assert events_table.read_events(spark, large).count() == 40_000


def test_truncated_tables_take_new_events(spark, tmp_path):
    path = str(tmp_path / "a")
    events_table.write_events(events(spark, (DAY, {})), path)
    events_table.truncate(spark, path)
    assert events_table.read_events(spark, path).count() == 0
    events_table.write_events(events(spark, (DAY, {"event_id": "new"})), path)
    assert [r.event_id for r in events_table.read_events(spark, path).collect()] == ["new"]


def test_landed_files_are_archived(spark, tmp_path):
    import glob

    landing, table, checkpoint, archive = (str(tmp_path / x) for x in ("landing", "table", "checkpoint", "archive"))
    for k in range(3):
        land(events(spark, (DAY, {"event_id": f"00000000-0000-0000-0000-{k:012d}"})), landing)
        ingest.supervised(lambda: ingest.start(spark, landing, table, checkpoint, once=True, archive=archive))
    assert glob.glob(f"{archive}/**/*.txt", recursive=True)
    assert events_table.read_events(spark, table).count() == 3


def test_a_changed_time_or_type_is_another_event(spark):
    e = events(spark, (DAY, {"event_id": "x"}), (DAY, {"event_id": "x", "event_type": "view"}), (DAY + timedelta(days=1), {"event_id": "x"}), (DAY, {"event_id": "x"}))
    assert events_table.deduplicated(e).count() == 3


def test_all_that_lands_is_stored_once_whatever_its_age(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / x) for x in ("landing", "table", "checkpoint"))
    old = events(spark, *((DAY - timedelta(days=d), {"event_id": f"00000000-0000-0000-0000-{d:012d}"}) for d in range(0, 200, 5)))
    land(old, landing)
    land(old.limit(7), landing)  # delivered twice
    with open(f"{landing}/broken.txt", "w") as f:
        f.write("not json\n\n")
    run = lambda: ingest.start(spark, landing, table, checkpoint, once=True)
    ingest.supervised(run)
    land(old.limit(3).withColumn("session_id", F.lit("later")), landing)
    ingest.supervised(run)
    stored = events_table.read_events(spark, table, final=True)
    assert stored.count() == 40 and events_table.read_events(spark, table).count() == 50
    assert stored.where("session_id = 'later'").count() == 3
    assert stored.agg(F.min("timestamp")).first()[0] == DAY - timedelta(days=195)


def test_a_failing_query_is_begun_again_a_few_times():
    class Broken:
        lastProgress = None

        def awaitTermination(self):
            raise RuntimeError("down")

    waits = []
    with pytest.raises(RuntimeError):
        ingest.supervised(Broken, sleep=waits.append)
    assert waits == [1, 2, 4, 8, 16]
