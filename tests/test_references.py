from datetime import datetime

import pytest

from memlode.operators.references import MEMORY_TABLES, orphan_cascade, orphan_report, orphans

T = datetime(2024, 1, 5)
SCHEMAS = {
    "memories": "id string, state string, created_at timestamp_ntz, updated_at timestamp_ntz, version int, derived_from array<string>, key string",
    "entities": "id string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "entity_mentions": "id string, entity_id string, memory_id string, created_at timestamp_ntz, reason string",
    "relationships": "id string, source_entity_id string, target_entity_id string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "surfaced_memories": "id string, memory_id string, surfaced_at timestamp_ntz",
}


def tables(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}


@pytest.fixture(scope="module")
def dirty(spark):
    late = datetime(2024, 1, 9)
    return tables(
        spark,
        memories=[("m1", "active", T, T, 1, None, "x"), ("m2", "active", T, T, 1, [], "x"), ("m2", "deleted", T, late, 2, [], "x"), ("m3", "active", late, late, 1, ["m9"], None), ("m4", "active", T, T, 1, ["m3", " M1 "], None), (None, "active", T, T, 1, [], None)],
        entities=[("e1", T, T)],
        entity_mentions=[("x1", "e1", " M1\n", T, "a"), ("x2", "e1", None, T, "a"), ("x3", "e1", "  ", T, "a"), ("x4", "e1", "m7", T, "a"), ("x4", "e1", "m7", T, "a"), ("x5", "e1", "m2", None, "a"), ("x6", "e1", "m4", late, None), (None, "e1", "m7", T, None)],
        relationships=[("l1", "E1 ", "e8", T, T)],
        surfaced_memories=[("f1", "m3", T), ("f2", "m2", T)],
    )


def test_reasons_in_order_and_once_per_record(dirty):
    got = {tuple(r) for r in orphans(dirty).collect()}
    assert got == {
        ("entity_mentions", "x4", "memory_id", "missing", "2024-01"),
        ("entity_mentions", "x5", "memory_id", "deleted", None),
        ("relationships", "l1", "target_entity_id", "missing", "2024-01"),
        ("surfaced_memories", "f1", "memory_id", "late", "2024-01"),
        ("surfaced_memories", "f2", "memory_id", "deleted", "2024-01"),
    }


def test_children_of_orphans_are_inherited(dirty):
    got = {(r.table_name, r.record_id): (r.kind, r.depth) for r in orphan_cascade(dirty).collect()}
    assert got["memories", "m3"] == ("direct", 0)  # derived from a record that doesn't exist
    assert got["memories", "m4"] == ("direct", 0)  # derived from one that came later
    assert got["entity_mentions", "x6"] == ("inherited", 1)
    assert ("entity_mentions", "x1") not in got
    report = {(r.table_name, r.month, r.reason): r.orphans for r in orphan_report(orphan_cascade(dirty)).collect()}
    assert report["entity_mentions", "2024-01", "missing"] == report["entity_mentions", "2024-01", "inherited"] == 1


def test_cycles_end(spark):
    rows = [("m1", "active", T, T, 1, ["m2"], None), ("m2", "active", T, T, 1, ["m1", "m0"], None)]
    got = {r.record_id: r.depth for r in orphan_cascade(tables(spark, memories=rows)).collect()}
    assert got == {"m2": 0, "m1": 1}


def test_empty_tables(spark):
    assert orphans(tables(spark)).collect() == []
    assert orphan_cascade(tables(spark)).collect() == []
    assert set(MEMORY_TABLES) == set(SCHEMAS)
