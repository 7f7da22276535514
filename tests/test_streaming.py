import os

import pytest
from pyspark.sql import functions as F

from memlode.sources.parquet import table
from memlode.streaming import windows

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in order of time, in four files."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = table(spark, SMALL, "events").orderBy("ts", "event_id")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(folder)
    return folder, events


def run(spark, query, tmp_path, name):
    started = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    started.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_tumbling_windows_agree_with_batch(spark, parts, tmp_path):
    folder, events = parts
    stream = windows.tumbling(windows.events_stream(spark, folder, events.schema, 4), "1 hour")
    got = run(spark, stream, tmp_path, "tumbling")
    batch = {tuple(r) for r in windows.tumbling(events, "1 hour").collect()}
    assert got <= batch  # windows the watermark hasn't closed yet stay open
    assert len(got) >= len(batch) - 10


def test_budget_state_agrees_with_a_range_window(spark, parts, tmp_path):
    folder, events = parts
    stream = windows.budget(windows.events_stream(spark, folder, events.schema, 4), 100.0, 3600)
    got = {(u, e): s for u, e, s, _ in run(spark, stream, tmp_path, "budget")}
    from datetime import timedelta

    from memlode.operators import logs

    rows = logs.spent(events, "value", "ts", timedelta(hours=1), key="user_id")
    want = {(r.user_id, r.event_id): r.s for r in rows.select("user_id", "event_id", F.round("spent", 4).alias("s")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_fan_out_reaches_handlers_once(spark, parts, tmp_path):
    folder, events = parts
    seen, every = [], []
    query = windows.fan_out(windows.events_stream(spark, folder, events.schema, 4), {"click": lambda df, n: seen.append(df.count())}, str(tmp_path / "fan"), lambda df, n: every.append(df.count()))
    query.trigger(availableNow=True).start().awaitTermination(120)
    assert sum(seen) == events.where("event_type = 'click'").count()
    assert sum(every) == events.count()


def test_watch_checks_the_owners_of_each_batch(spark, parts, tmp_path):
    folder, events = parts
    got = []
    owed = events.select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("id"), "event_type")
    checks = {"errors": lambda owners: owed.where("event_type = 'error'").join(owners, "entity_id", "left_semi"), "none": lambda owners: owed.where("false")}
    stream = windows.events_stream(spark, folder, events.schema, 4).withColumnRenamed("user_id", "entity_id")
    windows.watch(stream, checks, lambda df, n: got.extend(df.collect()), str(tmp_path / "watch")).trigger(availableNow=True).start().awaitTermination(120)
    assert sum(r.check == "errors" for r in got) == events.where("event_type = 'error'").count()
    assert sum(r.n for r in got if r.check == "all") == events.where("event_type = 'error'").count()
    assert {r.entity_id for r in got if r.check == "all"} == {r[0] for r in events.select("user_id").distinct().collect()}


def test_late_events_within_the_watermark_count(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    files = [[(1, 1, start, 5.0), (2, 1, start + timedelta(seconds=100), 7.0)], [(3, 1, start + timedelta(seconds=50), 1.0)], [(4, 1, start + timedelta(seconds=120), 2.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = {(e, s) for _, e, s, _ in run(spark, windows.budget(windows.events_stream(spark, str(tmp_path / "in"), schema, 1), 10.0, 60), tmp_path, "late")}
    assert (1, 5.0) in got and len(got) == 4
