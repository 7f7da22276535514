"""References to records that do not exist: direct orphans by reason, and the cascade to their children.

A foreign key is an edge child.field -> parent. *Direct* orphans are references that lead nowhere, to a deleted
record or to one created later. A child whose reference does lead to a record, but to one that is itself an
orphan, is an *inherited* orphan; that spreads down the key graph until a round finds nothing new (the graph may
hold cycles, such as memories derived from memories).

All steps are shuffles on the compared key with narrow rows (ids and times only): no table's text is read. The
parent side has one row per key, so a join never multiplies rows, and a key that holds a third of all references
makes a large partition on one side only, which AQE splits (skew join; left joins may be split on the left).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.runtime import cut
from memlode.sources.parquet import clean_key, newest


@dataclass(frozen=True)
class ForeignKey:
    """``field`` of ``child`` refers to ``id`` of ``parent``. ``is_list``: the field is an array of references."""

    child: str
    field: str
    parent: str
    is_list: bool = False


@dataclass(frozen=True)
class TableSpec:
    """How to read a table: its id, its row time, what makes a row the newest of its id, and where its state is (or None)."""

    name: str
    id: str = "id"
    time: str = "created_at"
    order: Sequence[str] = ("created_at",)
    state: str | None = None


MEMORY_TABLES: dict[str, TableSpec] = {
    "memories": TableSpec("memories", order=("updated_at", "version"), state="state"),
    "entities": TableSpec("entities", order=("updated_at",)),
    "entity_mentions": TableSpec("entity_mentions"),
    "relationships": TableSpec("relationships", order=("updated_at",)),
    "surfaced_memories": TableSpec("surfaced_memories", time="surfaced_at", order=("surfaced_at",)),
}
REPORTED_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("entity_mentions", "memory_id", "memories"),
    ForeignKey("relationships", "source_entity_id", "entities"),
    ForeignKey("relationships", "target_entity_id", "entities"),
    ForeignKey("surfaced_memories", "memory_id", "memories"),
)
ALL_KEYS: tuple[ForeignKey, ...] = (*REPORTED_KEYS, ForeignKey("entity_mentions", "entity_id", "entities"), ForeignKey("memories", "derived_from", "memories", is_list=True))


#: Why a reference is a direct orphan, the first that fits.
REASONS = ("missing", "deleted", "late")


def _parents(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec], names: Sequence[str]) -> DataFrame:
    """One row per referable record: (parent, key, parent_time, gone)."""
    parts = []
    for name in names:
        spec = specs[name]
        state = F.col(spec.state).cast("string") if spec.state else F.lit("")
        slim = tables[name].select(clean_key(F.col(spec.id).cast("string")).alias("key"), F.col(spec.time).alias("parent_time"), state.alias("_state"), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(spec.order)])
        rows = newest(slim, "key", ["parent_time", "_state"], [f"_order{i}" for i in range(len(spec.order))])
        parts.append(rows.select(F.lit(name).alias("parent"), "key", "parent_time", (F.lower(F.trim("_state")) == "deleted").alias("gone")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _pairs(edge: ForeignKey, field: Column) -> Column:
    """The references in a field as structs (field_name, parent, key)."""
    refs = field.cast("array<string>") if edge.is_list else F.array(field.cast("string"))
    return F.transform(F.array_distinct(F.transform(refs, clean_key)), lambda key: F.struct(F.lit(edge.field).alias("field_name"), F.lit(edge.parent).alias("parent"), key.alias("key")))


def _references(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec], keys: Sequence[ForeignKey]) -> DataFrame:
    """One row per reference that says something: (table_name, record_id, field_name, parent, key, row_time)."""
    parts = []
    for name in dict.fromkeys(k.child for k in keys):
        spec, own = specs[name], [k for k in keys if k.child == name]
        fields = [F.col(k.field).alias(f"_f{i}") for i, k in enumerate(own)]
        slim = tables[name].select(F.col(spec.id).cast("string").alias("record_id"), F.col(spec.time).alias("row_time"), *fields, *[F.col(c).alias(f"_order{i}") for i, c in enumerate(spec.order)])
        rows = newest(slim, "record_id", ["row_time", *[f"_f{i}" for i in range(len(own))]], [f"_order{i}" for i in range(len(spec.order))])
        pairs = []
        for i, k in enumerate(own):
            pairs.append(_pairs(k, F.col(f"_f{i}")))
        parts.append(rows.select(F.lit(name).alias("table_name"), "record_id", "row_time", F.inline(F.flatten(F.array_compact(F.array(*pairs))))).where(F.col("key").isNotNull()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _judged(references: DataFrame, parents: DataFrame) -> DataFrame:
    reason = F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("parent_time") > F.col("row_time"), "late")
    joined = references.join(parents, ["parent", "key"], "left")
    return joined.select("table_name", "record_id", "field_name", "parent", "key", "row_time", reason.alias("reason"))


def orphan_cascade(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey] = ALL_KEYS, specs: Mapping[str, TableSpec] = MEMORY_TABLES) -> DataFrame:
    """Direct and inherited orphans: (table_name, record_id, field_name, reason, month, kind, depth), one row per orphaned record and field that makes it one.

    kind is 'direct' (depth 0) if one of the record's own references is an orphan; reason is then the first that fits
    of 'missing' (no such id), 'deleted' (the newest row of the target has state 'deleted'), 'late' (the target was
    created after the row). All other orphans are 'inherited', with the reason 'inherited' and as depth the number of
    steps to the nearest direct orphan. Each round semi-joins the references with the records orphaned in the round
    before and drops those known already; the rounds end when one adds nothing, which every graph reaches, cycles
    included. Frontier and result are written to the shared checkpoint folder, so lineage stays short and a lost
    executor loses no round. Defined cases: a null or blank reference is no case; ids are compared without white
    space around them and without case; a null row time gives a null month and is never 'late'; rows with a null id
    are dropped; repeated rows of an id count once, the newest; several references in one field that are orphans
    give one row with the first reason; an empty parent table makes every reference 'missing'; other columns,
    whatever their names, are ignored.
    """
    names = list(dict.fromkeys(k.parent for k in keys))
    judged = _judged(_references(tables, specs, keys), _parents(tables, specs, names))
    children = {k.child for k in keys}
    spread = [n for n in names if n in children]  # only orphans that are parents themselves have heirs
    if spread:
        judged = cut(judged)
    order = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    direct = judged.where("reason is not null").groupBy("table_name", "record_id", "field_name").agg(F.min(order).alias("_first"), F.min("row_time").alias("row_time"))
    found = cut(direct.select("table_name", "record_id", "field_name", F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("_first").cast("int")).alias("reason"), "row_time", F.lit(0).alias("depth")))
    sound = judged.where("reason is null").select("table_name", "record_id", "field_name", "row_time", "parent", "key")
    frontier, depth = found, 0
    while spread:
        heads = frontier.where(F.col("table_name").isin(spread)).select(F.col("table_name").alias("parent"), clean_key(F.col("record_id")).alias("key")).distinct()
        if heads.isEmpty():
            break
        depth += 1
        fresh = sound.join(heads, ["parent", "key"], "left_semi").groupBy("table_name", "record_id", "field_name").agg(F.min("row_time").alias("row_time"))
        fresh = fresh.join(found.select("table_name", "record_id"), ["table_name", "record_id"], "left_anti")
        frontier = cut(fresh.select("table_name", "record_id", "field_name", F.lit("inherited").alias("reason"), "row_time", F.lit(depth).alias("depth")))
        found = found.unionByName(frontier)
        if depth % 8 == 0:
            found = cut(found)
    return found.select("table_name", "record_id", "field_name", "reason", F.date_format("row_time", "yyyy-MM").alias("month"), F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("kind"), "depth")


def orphans(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey] = REPORTED_KEYS, specs: Mapping[str, TableSpec] = MEMORY_TABLES) -> DataFrame:
    """Direct orphans: (table_name, record_id, field_name, reason, month), one row per record and field; the cascade's first round."""
    return orphan_cascade(tables, keys, specs).where("depth = 0").select("table_name", "record_id", "field_name", "reason", "month")


def orphan_report(cascade: DataFrame) -> DataFrame:
    """Counts of the cascade per table, month and reason: (table_name, month, reason, orphans), every record once per reason."""
    return cascade.groupBy("table_name", "month", "reason").agg(F.countDistinct("record_id").alias("orphans"))
