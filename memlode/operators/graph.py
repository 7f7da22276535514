"""The entity graph: edges, neighbours, searches by rounds, aliases, merging, extraction of relations from text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.runtime import cut, kept
from memlode.sources.parquet import clean_key

# Relation patterns as (pattern, type, both ways, group of the source, group of the target, confidence); group 0 is the user.
_NAME, _THING = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)"
RELATION_PATTERNS = (
    (rf"{_NAME}\s+is\s+(?:my|the)\s+(wife|husband|spouse)", "married_to", True, 1, 0, 0.9),
    (rf"(?:my|the)\s+(wife|husband|spouse)\s+{_NAME}", "married_to", True, 0, 2, 0.9),
    (rf"{_NAME}\s+is\s+(?:my|the)\s+(mother|father|parent)", "parent_of", False, 1, 0, 0.9),
    (rf"{_NAME}\s+is\s+(?:my|the)\s+(son|daughter|child)", "child_of", False, 1, 0, 0.9),
    (rf"{_NAME}\s+is\s+(?:my|the)\s+(brother|sister|sibling)", "sibling_of", True, 1, 0, 0.9),
    (rf"{_NAME}\s+works?\s+(?:at|for)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)", "works_at", False, 1, 2, 0.85),
    (rf"{_NAME}\s+is\s+(?:my|the|a)\s+(boss|manager|supervisor)", "manages", False, 1, 0, 0.8),
    (rf"{_NAME}\s+is\s+(?:my|a)\s+(colleague|coworker|teammate)", "colleague_of", True, 1, 0, 0.8),
    (rf"{_NAME}\s+is\s+(?:my|a)\s+(friend|best friend)", "friend_of", True, 1, 0, 0.85),
    (rf"(?:my|a)\s+friend\s+{_NAME}", "friend_of", True, 0, 1, 0.85),
    (rf"{_NAME}\s+(?:and I|and me)\s+(?:are|were)\s+friends", "friend_of", True, 1, 0, 0.85),
    (rf"{_NAME}\s+lives?\s+in\s+{_NAME}", "lives_in", False, 1, 2, 0.8),
    (rf"{_NAME}\s+is\s+from\s+{_NAME}", "from", False, 1, 2, 0.8),
    (rf"{_NAME}\s+(?:is located|is based)\s+in\s+{_NAME}", "located_in", False, 1, 2, 0.85),
    (rf"{_NAME}\s+(?:uses|owns|has)\s+(?:a|an|the)\s+{_THING}", "uses", False, 1, 2, 0.7),
    (rf"{_NAME}\s+is\s+dating\s+{_NAME}", "dating", True, 1, 2, 0.85),
    (rf"{_NAME}\s+(?:and)\s+{_NAME}\s+are\s+(?:dating|together|a couple)", "dating", True, 1, 2, 0.85),
    (rf"{_NAME}\s+is\s+(?:a member of|part of)\s+{_THING}", "member_of", False, 1, 2, 0.8),
    (rf"{_NAME}\s+(?:joined|belongs to)\s+{_THING}", "member_of", False, 1, 2, 0.8),
)
VERBS = (("met", "knows", True), ("know", "knows", True), ("introduced", "knows", True), ("hired", "employed_by", False), ("taught", "taught_by", False), ("mentored", "mentored_by", False), ("recommended", "recommended_by", False), ("invited", "invited_by", False))


def strength(evidence: Column, recency: Column, confidence: Column) -> Column:
    return 0.4 * (1 - 1 / (1 + evidence)) + 0.3 * recency + 0.3 * confidence


def edges(relationships: DataFrame, entities: DataFrame, least: float = 0.3, types: Sequence[str] = (), entity_types: Sequence[str] = (), team: str | None = None) -> DataFrame:
    """(id, a, b, kind, strength): sound edges in both directions; references are compared cleaned, kinds in one writing.

    ``types`` of relations, ``entity_types`` of both ends and the ``team`` (of the relation) may be given.
    """
    if team is not None:
        relationships = relationships.where(F.col("team_id") == team)
    if entity_types:
        entities = entities.where(F.col("type").isin(*entity_types))
    rows = relationships.select("id", clean_key(F.col("source_entity_id")).alias("s"), clean_key(F.col("target_entity_id")).alias("t"), F.regexp_replace(F.lower(F.trim("relationship_type")), r"[\s-]+", "_").alias("kind"), "strength")
    rows = rows.where(F.col("strength") >= least)
    if types:
        rows = rows.where(F.col("kind").isin(*types))
    known = entities.select(F.col("id").alias("s"))
    sound = rows.join(known, "s", "left_semi").join(known.withColumnRenamed("s", "t"), "t", "left_semi").where("s <> t")
    return sound.select("id", F.inline(F.array(F.struct(F.col("s").alias("a"), F.col("t").alias("b")), F.struct(F.col("t").alias("a"), F.col("s").alias("b")))), "kind", "strength")


def neighbours(graph: DataFrame) -> DataFrame:
    """(a, neighbours, best): how many others each entity reaches in one step, and its strongest edge."""
    return graph.groupBy("a").agg(F.countDistinct("b").alias("neighbours"), F.max("strength").alias("best"))


def reached(graph: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): everything within ``depth`` steps of each root, with the fewest steps.

    One join per round from the frontier only; known nodes are removed by an anti-join and each round is cut off
    in the shared checkpoint folder, so the plan doesn't grow. Roots are searched together.
    """
    frontier = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    seen = cut(frontier)
    frontier = seen
    for step in range(1, depth + 1):
        nearer = frontier.join(graph, frontier["node"] == graph["a"]).select("root", F.col("b").alias("node")).distinct()
        frontier = cut(nearer.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(graph: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth, path): shortest path from each root to everything within ``depth`` steps; the first in the order of ids where several are shortest.

    Works in rounds like ``reached``. A path of a round extends the first path of the round before, so one row per
    root and node is carried.
    """
    frontier = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    seen = cut(frontier)
    frontier, steps = seen, graph.select("a", "b").distinct()
    for step in range(1, depth + 1):
        nearer = frontier.join(steps, frontier["node"] == steps["a"]).select("root", F.col("b").alias("node"), F.array_append("path", F.col("b")).alias("path"))
        fresh = nearer.join(seen.select("root", "node"), ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("path").alias("path"))
        frontier = cut(fresh.select("root", "node", F.lit(step).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def path_steps(found: DataFrame, graph: DataFrame) -> DataFrame:
    """(root, node, step, a, b, kind): the relation of each step of each path, the strongest where there are several (the first kind on ties)."""
    best = graph.groupBy("a", "b").agg(F.min(F.struct((-F.col("strength")).alias("s"), "kind")).alias("k")).select("a", "b", "k.kind")
    ahead = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))
    flat = found.where("depth > 0").select("root", "node", F.posexplode(ahead).alias("step", "_e")).select("root", "node", (F.col("step") + 1).alias("step"), "_e.a", "_e.b")
    return flat.join(best, ["a", "b"])


def explained(steps: DataFrame, entities: DataFrame) -> DataFrame:
    """(root, node, text): each path in words, 'A -[kind]-> B -[kind]-> C'. A path is short, so its steps are gathered."""
    names = entities.select(F.col("id").alias("b"), F.col("canonical_name").alias("_to"))
    said = steps.join(names, "b").groupBy("root", "node").agg(F.array_sort(F.collect_list(F.struct("step", "kind", "_to"))).alias("s"))
    start = entities.select(F.col("id").alias("root"), F.col("canonical_name").alias("_from"))
    return said.join(start, "root").select("root", "node", F.concat("_from", F.array_join(F.transform("s", lambda x: F.concat(F.lit(" -["), x["kind"], F.lit("]-> "), x["_to"])), "")).alias("text"))


def context_lines(ids: DataFrame, mentions: DataFrame, entities: DataFrame, graph: DataFrame) -> DataFrame:
    """(owner, line): relations one step around the entities that some memories (id) mention, each line once per owner."""
    named = entities.select("id", "owner_entity_id", "canonical_name", "type")
    touched = mentions.join(ids.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi").select(F.col("entity_id").alias("a")).distinct()
    near = graph.join(touched, "a", "left_semi").select("a", "b", "kind").distinct()
    both = near.join(named.select(F.col("id").alias("a"), F.col("owner_entity_id").alias("owner"), F.col("canonical_name").alias("_x"), F.col("type").alias("_tx")), "a").join(named.select(F.col("id").alias("b"), F.col("canonical_name").alias("_y"), F.col("type").alias("_ty")), "b")
    return both.select("owner", F.concat("_x", F.lit(" ("), "_tx", F.lit(") -["), "kind", F.lit("]-> "), "_y", F.lit(" ("), "_ty", F.lit(")")).alias("line")).distinct()


# What introduces an entity of a type in a text.
_SEVERAL = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
TYPED_PATTERNS = (
    (rf"(?:my|the)\s+(?:friend|colleague|coworker|boss|manager)\s+{_SEVERAL}", "person"),
    (rf"(?:works?\s+(?:at|for))\s+{_SEVERAL}", "organization"),
    (rf"(?:lives?\s+in|from)\s+{_SEVERAL}", "location"),
    (rf"(?:married\s+to|dating)\s+{_SEVERAL}", "person"),
)
# Words around an entity that tell its type, in the order in which they are tried.
TYPE_WORDS = (
    ("person", ("friend", "colleague", "coworker", "boss", "manager", "wife", "husband", "brother", "sister", "mother", "father", "son", "daughter", "partner", "he ", "she ", "his ", "her ", "they ")),
    ("organization", ("company", "corporation", "inc", "llc", "ltd", "works at", "works for", "employed by", "organization", "team", "department")),
    ("location", ("city", "country", "state", "lives in", "from", "located", "moved to", "visiting", "trip to", "travel to")),
    ("product", ("bought", "purchased", "using", "uses", "product", "app", "software", "device", "phone", "computer", "car")),
)


def around(text: Column, part: Column, width: int = 50) -> Column:
    """``width`` characters on both sides of the first occurrence of a part, without case; empty if there is none."""
    place = F.instr(F.lower(text), F.lower(part))
    start = F.greatest(place - width, F.lit(1))
    return F.when(place == 0, "").otherwise(F.substring(text, start, place + F.length(part) + width - start))


def inferred_type(context: Column) -> Column:
    """The type that the words of a context tell, the first list that fits; else 'other'."""
    low, out = F.lower(context), F.lit("other")
    for kind, parts in reversed(TYPE_WORDS):
        hit = F.lit(False)
        for part in parts:
            hit = hit | low.contains(part)
        out = F.when(hit, kind).otherwise(out)
    return out


def typed_entities(texts: DataFrame) -> DataFrame:
    """(id, name, type, context, inferred): entities that patterns find in texts (id, content), each name and type once per text, in one pass over each text."""
    of = lambda kind: lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), of(kind)) for p, kind in TYPED_PATTERNS]))
    flat = texts.where("content is not null").select("id", "content", F.explode(F.array_distinct(found)).alias("e")).select("id", "content", "e.name", "e.type")
    made = flat.select("id", "name", "type", around(F.col("content"), F.col("name")).alias("context"))
    return made.withColumn("inferred", inferred_type(F.col("context")))


def between_kind(between: Column) -> Column:
    """The relation that the text between two names tells, null if none."""
    low = F.lower(F.trim(between))
    return F.when(low.contains("and") & low.contains("work"), "works_with").when(low.contains("and") | low.contains("with"), "associated_with").when(low.contains("at"), "located_at").when(low.contains("from"), "from")


def components(links: DataFrame) -> DataFrame:
    """(id, root): smallest id of each connected component of undirected links (a, b); labels spread by min until none changes.

    Each round takes the least label of a node and its neighbours, then that label's own label, so long chains
    halve. State is written to the shared checkpoint folder every round. Nodes without a link don't appear.
    """
    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("id"), "root"))
    while True:
        near = both.join(state.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("_near"))
        least = state.join(near, state["id"] == near["a"]).select("id", F.least("root", "_near").alias("_new"), F.col("root").alias("_old"))
        jumps = state.select(F.col("id").alias("_new"), F.col("root").alias("_jump"))
        after = cut(least.join(jumps, "_new", "left").select("id", F.least("_new", F.coalesce("_jump", "_new")).alias("root"), "_old"))
        state = after.select("id", "root")
        if after.where("root <> _old").isEmpty():
            return state


def hops(graph: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(source, target, hops): length of the shortest path of each pair, null beyond ``depth``; one search from all sources."""
    found = reached(graph, pairs.select(F.col("source").alias("id")).distinct(), depth)
    return pairs.join(found.select(F.col("root").alias("source"), F.col("node").alias("target"), F.col("depth").alias("hops")), ["source", "target"], "left")


def resolved(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_id, how, confidence): each name by exact canonical name, else by alias without case, else new. The smallest id wins."""
    exact = entities.groupBy(F.col("canonical_name").alias("name")).agg(F.min("id").alias("_exact"))
    alias = entities.select("id", F.explode("aliases").alias("_a")).groupBy(F.lower("_a").alias("_key")).agg(F.min("id").alias("_alias"))
    joined = names.select("name").distinct().join(exact, "name", "left").withColumn("_key", F.lower("name")).join(alias, "_key", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "alias").otherwise("new")
    return joined.select("name", F.coalesce("_exact", "_alias").alias("entity_id"), how.alias("how"), F.when(F.col("_exact").isNotNull(), 1.0).when(F.col("_alias").isNotNull(), 0.95).otherwise(0.0).alias("confidence"))


def merged_entities(entities: DataFrame, groups: DataFrame, most_aliases: int = 10) -> DataFrame:
    """Entities of one group (id, root) as one: the root's name, all aliases up to a number, counts added."""
    joined = entities.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    pairs = joined.groupBy("root").agg(
        F.min(F.when(F.col("id") == F.col("root"), F.col("canonical_name"))).alias("canonical_name"), F.sum("mention_count").alias("mention_count"), F.max("last_mentioned_at").alias("last_mentioned_at"), F.count("*").alias("merged"),
    )
    spelled = joined.select("root", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).distinct()
    aliases = spelled.groupBy("root").agg(F.slice(F.array_sort(F.collect_list("alias")), 1, most_aliases).alias("aliases"))
    return pairs.join(aliases, "root", "left")


def relations(memories: DataFrame) -> DataFrame:
    """(source, target, kind, both_ways, confidence, evidence): relations told by the texts, each pair and kind once with the surest evidence.

    Patterns are a bounded list, so they run as expressions over each text, without a join.
    """
    parts = []
    for pattern, kind, both, source, target, confidence in (*RELATION_PATTERNS, *((rf"{_NAME}\s+{verb}\s+{_NAME}", kind, both, 1, 2, 0.75) for verb, kind, both in VERBS)):
        group = lambda g: F.regexp_extract_all("content", F.lit(pattern), F.lit(g))  # noqa: B023, E731
        zipped = F.arrays_zip(group(0).alias("e"), (group(source) if source else group(0)).alias("s"), (group(target) if target else group(0)).alias("t"))
        struct = lambda m: F.struct((m["s"] if source else F.lit("user")).alias("source"), (m["t"] if target else F.lit("user")).alias("target"), F.lit(kind).alias("kind"), F.lit(both).alias("both_ways"), F.lit(confidence).alias("confidence"), m["e"].alias("evidence"))  # noqa: B023, E731
        parts.append(F.when(F.col("content").rlike(pattern), F.transform(zipped, struct)))
    out = memories.where("content is not null").select(F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("r")).select("r.*")
    low, high = F.least("source", "target"), F.greatest("source", "target")
    swapped = out.withColumns({"source": F.when(F.col("both_ways"), low).otherwise(F.col("source")), "target": F.when(F.col("both_ways"), high).otherwise(F.col("target"))})
    return swapped.where("source <> target").groupBy("source", "target", "kind", "both_ways").agg(F.max(F.struct("confidence", "evidence")).alias("m")).select("source", "target", "kind", "both_ways", F.col("m.confidence").alias("confidence"), F.col("m.evidence").alias("evidence"))


def cooccurring(mentions: DataFrame, memories: DataFrame, near: int = 100) -> DataFrame:
    """(memory_id, a, b, distance): two mentions in one memory with fewer than ``near`` characters between them. A memory has few mentions, so the pairs stay small."""
    placed = mentions.join(memories.select(F.col("id").alias("memory_id"), "content"), "memory_id").withColumn("at", F.instr("content", F.col("mention_text"))).where("at > 0")
    spans = placed.select("memory_id", "entity_id", "at", (F.col("at") + F.length("mention_text")).alias("end"))
    a, b = spans.toDF("memory_id", "a", "at_a", "end_a"), spans.toDF("memory_id", "b", "at_b", "end_b")
    gap = F.greatest(F.col("at_b") - F.col("end_a"), F.col("at_a") - F.col("end_b"), F.lit(0))
    return a.join(b, "memory_id").where("a < b").groupBy("memory_id", "a", "b").agg(F.min(gap).alias("distance")).where(F.col("distance") < near)

