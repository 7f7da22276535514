import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlode.functions.columns import NOW, cosine
from memlode.operators import filters, lifecycle, schedule, scoring, search, texts


def value(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


LIFE = "last_accessed_at timestamp_ntz, created_at timestamp_ntz, stability double, access_count int, importance double, confidence double"


@pytest.mark.parametrize(("days", "stability", "count", "expected"), [(0, 60.0, 0, 1.0), (60, 60.0, 0, math.exp(-1)), (60, 60.0, 9, math.exp(-1 / (1 + 0.5 * math.log(10)))), (60, -1.0, 0, math.exp(-1)), (None, 60.0, 0, 1.0), (-5, 60.0, 0, 1.0)])
def test_decay(spark, days, stability, count, expected):
    last = None if days is None else NOW - timedelta(days=days)
    assert value(spark, (last, NOW, stability, count, 0.5, 0.5), LIFE, scoring.decay_factor(NOW)) == pytest.approx(expected)


def test_decay_falls_with_time_and_states_follow(spark):
    rows = [(NOW - timedelta(days=d), NOW, 30.0, 0, 0.5, 0.5) for d in range(0, 200, 10)]
    got = [tuple(r) for r in spark.createDataFrame(rows, LIFE).select(scoring.decay_factor(NOW).alias("f"), scoring.decay_state(scoring.decay_factor(NOW)).alias("s")).collect()]
    assert [f for f, _ in got] == sorted((f for f, _ in got), reverse=True)
    order = ["active", "stale", "archived", "deleted"]
    assert [order.index(s) for _, s in got] == sorted(order.index(s) for _, s in got)


def test_mode_weights_sum_to_one():
    assert all(sum(w) == pytest.approx(1) for w in scoring.MODES.values())


@pytest.mark.parametrize(("a", "b", "expected"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), (None, [1.0], 0.0), ([float("nan"), 1.0], [1.0, 1.0], 0.0)])
def test_cosine(spark, a, b, expected):
    assert value(spark, (a, b), "a array<double>, b array<double>", cosine(F.col("a"), F.col("b"))) == pytest.approx(expected)


@pytest.mark.parametrize(
    ("tag", "after", "expected"),
    [
        ("hourly", datetime(2024, 1, 31, 5), datetime(2024, 1, 31, 6)),
        ("cron:every:1h30m", datetime(2024, 1, 31, 5), datetime(2024, 1, 31, 6, 30)),
        ("daily:09:00", datetime(2024, 1, 31, 9), datetime(2024, 2, 1, 9)),
        ("daily:09:00:America/New_York", datetime(2024, 3, 10, 3), datetime(2024, 3, 10, 13)),
        ("weekly:mon:08:15", datetime(2024, 1, 31, 9), datetime(2024, 2, 5, 8, 15)),
        ("weekdays:08:00", datetime(2024, 2, 2, 9), datetime(2024, 2, 5, 8)),
        ("monthly:31:08:00", datetime(2024, 1, 31, 9), datetime(2024, 3, 31, 8)),
        ("once:2024-03-01T08:00", datetime(2024, 1, 1), datetime(2024, 3, 1, 8)),
        ("once:2024-03-01", datetime(2024, 4, 1), None),
        ("daily:25:00", datetime(2024, 1, 1), "invalid"),
        ("every:soon", datetime(2024, 1, 1), "invalid"),
        ("home", datetime(2024, 1, 1), "invalid"),
    ],
)
def test_next_run(spark, tag, after, expected):
    rows = schedule.planned(spark.createDataFrame([([tag], after)], "tags array<string>, after timestamp_ntz"), F.col("after")).collect()
    assert (rows[0].next_at if rows else "invalid") == expected


@pytest.mark.parametrize(("text", "expected"), [("", 0.0), ("Thanks", 0.0), ("so it goes", 0.1), ("where is the other one now?", 0.2), ("I work at Initech and met Anna yesterday for 3 hours", 1.0)])
def test_significance(spark, text, expected):
    assert value(spark, (text,), "t string", texts.significance(F.col("t"))) == pytest.approx(expected)


@pytest.mark.parametrize(
    ("new", "old", "kind"),
    [("She no longer rows", "She rows", "negation"), ("Rows the blue boat now", "Rows the blue boat daily", "temporal"), ("Works at Initech", "Employed at Globex", "life"), ("Has 12 quiet boats", "Has 9 quiet boats", "numeric"), ("Paints clouds", "Builds kites", None)],
)
def test_conflicts(spark, new, old, kind):
    got = value(spark, (new, old), "n string, o string", texts.conflict(F.col("n"), F.col("o")))
    assert (got and got.kind) == kind


@pytest.mark.parametrize(("old", "new", "expected"), [("A red boat", "a red", "A red boat"), ("red", "a red boat", "a red boat"), ("The boat is red", "the boat is old", "The boat is red. Additionally: old"), ("One", "Two", "One. Two")])
def test_merged_text(spark, old, new, expected):
    assert value(spark, (old, new), "o string, n string", texts.merged(F.col("o"), F.col("n"))) == expected


@pytest.mark.parametrize(("visibility", "team", "agent", "seen"), [("global", "", "x", True), ("team", "t", "x", True), ("team", "u", "x", False), ("private", "t", "me", True), ("private", "t", "x", False), (None, "t", "me", False), ("odd", "t", "me", False)])
def test_visibility(spark, visibility, team, agent, seen):
    assert value(spark, (visibility, team, agent), "visibility string, team_id string, agent_id string", filters.visible_to(filters.Viewer("me", "t"))) is seen


def test_paging_covers_ties_without_gaps(spark):
    rows = spark.createDataFrame([(f"m{i}", datetime(2024, 1, 1 + i // 4)) for i in range(12)], "id string, created_at timestamp_ntz")
    seen = [r.id for r in filters.page(rows, limit=5).collect()]
    while len(seen) < 12:
        seen += [r.id for r in filters.page_after(rows, seen[-1], limit=5).collect()]
    assert sorted(seen) == sorted(f"m{i}" for i in range(12)) and len(set(seen)) == 12
    with pytest.raises(ValueError):
        filters.page(rows, "content")


def test_update_keeps_rows_without_change(spark):
    rows = spark.createDataFrame([("a", "active", 1, NOW), ("b", "active", 1, NOW)], "id string, state string, version int, updated_at timestamp_ntz")
    later = NOW + timedelta(days=1)
    got = {r.id: (r.state, r.version) for r in lifecycle.updated(rows, spark.createDataFrame([("b", "stale")], "id string, state string"), later).collect()}
    assert got == {"a": ("active", 1), "b": ("stale", 2)}


def test_similarity_pairs_equal_brute_force_over_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(f"m{i:02}", f"g{i % 2}", [float(v) for v in x[i]]) for i in range(60)] + [("z", "g0", None)], "id string, g string, embedding array<float>")
    got = {(r.a, r.b) for r in search.similarity_pairs(rows, "g", 0.8, block=7).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"m{i:02}", f"m{j:02}") for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and u[i] @ u[j] >= 0.8}
    assert got == want
