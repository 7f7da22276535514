"""Search, ranking, duplicates, conflicts and text functions: named queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.functions.columns import NOW, cosine
from memlode.functions.plugins import HashingEmbedder, RuleExtractor, embedding
from memlode.operators import consolidate, scoring, search, texts
from memlode.plans.base import WITH, Catalog, memories, messages, sql_days
from memlode.plans.relational import _DECAY
from memlode.sources.parquet import table

C = Catalog()
_ROW = ("entity_id", "content", "embedding", "importance", "confidence", "stability", "access_count", "created_at", "last_accessed_at", "state", "agent_id", "visibility", "team_id")
_VEC = """, q as (select list_transform(embedding, lambda x: x::double) q from embeddings where vec_id = 1),
v as (select *, list_transform(embedding, lambda x: x::double) e from mem),
n as (select *, case when len(e) = 64 then list_dot_product(e, e) end nn from v),
s as (select n.* exclude (e, nn), case when nn > 0 and nn < 'infinity'::double then list_dot_product(e, (select q from q)) / (sqrt(nn) * (select sqrt(list_dot_product(q, q)) from q)) else 0 end sim from n)
"""


def query_vector(spark, folder):
    """The vector that the search queries ask for."""
    return search.vector(table(spark, folder, "embeddings").where("vec_id = 1").select("embedding").first()[0])


@C.add(WITH + _VEC + "select id, round(sim, 6) similarity from s where state not in ('deleted', 'archived') order by round(sim, 9) desc, id limit 50")
def cosine_topk(spark, folder):
    rows = memories(spark, folder, "embedding", "state").where(~F.col("state").isin("deleted", "archived"))
    return search.similar(rows, query_vector(spark, folder), 50, least=-1.0).select("id", F.round("similarity", 6).alias("similarity"))


def _mode(mode: str):
    a, b, c, d, e = scoring.MODES[mode]
    recency = f"1 / (1 + ln(1 + {sql_days('greatest(created_at, coalesce(last_accessed_at, created_at))')}))"
    sql = f"""{WITH}{_VEC}, r as (select id, content, round({a} * sim + {b} * ({recency}) + {c} * {_DECAY} + {d} * coalesce(importance, 0) + {e} * coalesce(confidence, 0), 6) score from s where sim >= 0 and state in ('active', 'stale', 'resolved')),
d as (select *, row_number() over (partition by content order by score desc, id) n from r) select id, score from d where n = 1 order by score desc, id limit 100"""

    def query(spark, folder):
        rows = memories(spark, folder, *_ROW).where(F.col("state").isin("active", "stale", "resolved"))
        return search.search(rows, query_vector(spark, folder), NOW, mode, 100).select("id", "score")

    C.add(sql, f"search_{mode}")(query)


for _m in scoring.MODES:
    _mode(_m)


@C.add(
    WITH
    + _VEC
    + f""", r as (select id, sim, importance, {_DECAY} d, case when {sql_days('created_at')} * 24 <= 24 then 1 - {sql_days('created_at')} else 0 end f from s where state in ('active', 'resolved')),
k as (select id, (0.5 * sim + 0.3 * coalesce(importance, 0) + 0.2 * f) * (0.5 + 0.5 * d) x, f from r)
select id, round(case when f > 0.5 then x * (1 + 0.2 * (f - 0.5)) else x end, 6) score from k order by 2 desc, 1 limit 100"""
)
def enhanced_retrieve(spark, folder):
    return search.retrieve(memories(spark, folder, *_ROW), query_vector(spark, folder), NOW, 100).select("id", "score")


@C.add(WITH + _VEC + ", a as (select id, round(sim, 6) score from s order by round(sim, 9) desc, id limit 100), b as (select id, round(importance, 6) score from mem order by importance desc nulls last, id limit 100) select id, max(score) score from (select * from a union all select * from b) group by 1")
def tier_merge(spark, folder):
    rows = memories(spark, folder, "embedding", "importance")
    near = search.similar(rows, query_vector(spark, folder), 100, least=-1.0).select("id", F.round("similarity", 6).alias("score"))
    top = rows.orderBy(F.col("importance").desc_nulls_last(), "id").limit(100).select("id", F.round("importance", 6).alias("score"))
    return search.merged(near, top)


@C.add(
    WITH
    + _VEC
    + r""", r as (select *, round(sim, 6) similarity, row_number() over (partition by entity_id order by last_accessed_at desc nulls last, id) <= 20 hot, len(list_filter(['leaking', 'kettle'], lambda t: list_contains(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), t))) = 2 hit from s where state in ('active', 'stale')),
t as (select *, case when max(similarity) filter (hot) over (partition by entity_id) >= 0.35 then 1 when max(similarity) over (partition by entity_id) >= 0.25 then 2 else 3 end tier from r),
u as (select entity_id, id, tier, case when tier = 3 and hit and embedding is null then 0.3 else similarity end score from t where case tier when 1 then hot when 2 then true else hit or similarity > 0 end)
select entity_id, id, score, tier from (select *, row_number() over (partition by entity_id order by score desc, id) n from u) where n <= 5"""
)
def tiered_search(spark, folder):
    rows = memories(spark, folder, *_ROW).where(F.col("state").isin("active", "stale"))
    return search.tiered(rows, query_vector(spark, folder), "leaking kettle", 5, hot=20, hit=0.35, weak=0.25)


_W = r"list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


@C.add(WITH + f"select id from (select id, {_W} w from mem where state in ('active', 'stale', 'resolved')) where list_has_all(w, ['leaking', 'kettle'])")
def fts_and(spark, folder):
    rows = memories(spark, folder, "content", "state").where(F.col("state").isin("active", "stale", "resolved"))
    return rows.where(search.matches(F.col("content"), ["leaking", "kettle"])).select("id")


@C.add(
    WITH
    + f""", d as (select id, len(w) l, w from (select id, {_W} w from mem where state = 'active')), a as (select count(*) n, avg(l) m from d),
t as (select id, l, term, count(*) tf from (select id, l, unnest(w) term from d) where term in ('weekly', 'harbour', 'notes') group by all),
x as (select term, count(*) df from t group by 1),
y as (select id, count(*) c, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) s from t join x using (term), a group by 1)
select id, round(s, 6) score from y where c = 2 order by 2 desc, 1 limit 100"""
)
def fts_bm25(spark, folder):
    rows = memories(spark, folder, "content", "state").where("state = 'active'")
    return search.ranked_text(rows, ["weekly", "notes"], 100)


_STOP = ", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in sorted(search.STOP_WORDS))


@C.add(WITH + f"""select id, list_filter(list_transform(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> ''), lambda w: trim(w, '?.,!;:''"')), lambda w: strlen(w) > 2 and w not in ({_STOP})) terms from msg""")
def query_terms(spark, folder):
    return messages(spark, folder).select("id", search.query_terms_of(F.col("content")).alias("terms"))


_PAIRS = """, u as (select id, entity_id, state, content, list_transform(e, lambda x: x / sqrt(nn)) u from n where nn > 0 and nn < 'infinity'::double),
p as (select a.id a, b.id b, list_dot_product(a.u, b.u) c, a.content ca, b.content cb from u a join u b on a.entity_id = b.entity_id and a.id < b.id where a.state = 'active' and b.state = 'active')
"""
_VPAIRS = _VEC.rsplit(",\ns as", 1)[0] + _PAIRS


@C.add(WITH + _VPAIRS + "select a, b, round(c, 6) similarity from p where c >= 0.85 - 1e-9")
def cosine_pairs(spark, folder):
    rows = memories(spark, folder, "entity_id", "embedding", "state").where((F.col("state") == "active") & (F.size("embedding") == 64))
    return search.similarity_pairs(rows, "entity_id", 0.85).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _close(spark, folder, least):
    rows = memories(spark, folder, "entity_id", "embedding", "state", "content").where((F.col("state") == "active") & (F.size("embedding") == 64))
    pairs = search.similarity_pairs(rows, "entity_id", least)
    return pairs.join(rows.select(F.col("id").alias("a"), F.col("content").alias("ca")), "a").join(rows.select(F.col("id").alias("b"), F.col("content").alias("cb")), "b")


_COVER = r"(select case when len(x) = 0 then 1 else len(list_filter(x, lambda w: list_contains(y, w))) / len(x) end from (select list_filter(regexp_split_to_array(lower({new}), '\s+'), lambda w: w <> '') x, list_filter(regexp_split_to_array(lower({old}), '\s+'), lambda w: w <> '') y))"


@C.add(
    WITH + _VPAIRS + f"select a, b, case when ca = cb then 'skip' when c >= 0.97 then 'skip' when c >= 0.93 and (length(trim(cb)) < length(trim(ca)) and contains(lower(trim(ca)), lower(trim(cb))) or {_COVER.format(new='cb', old='ca')} >= 0.9) then 'skip' when c >= 0.93 then 'merge' else 'create' end decision from p where c >= 0.85 - 1e-9"
)
def dedup_decision(spark, folder):
    new, old = F.col("cb"), F.col("ca")
    said = F.when(new == old, "skip").when(F.col("similarity") >= 0.97, "skip").when((F.col("similarity") >= 0.93) & texts.is_subset(new, old), "skip").when(F.col("similarity") >= 0.93, "merge").otherwise("create")
    return _close(spark, folder, 0.85).select("a", "b", said.alias("decision"))


@C.add()
def merged_texts(spark, folder):
    rows = _close(spark, folder, 0.93).where("ca <> cb")
    return rows.select("a", "b", texts.merged(F.col("ca"), F.col("cb")).alias("content"))


@C.add()
def conflicts(spark, folder):
    rows = _close(spark, folder, 0.6)
    return rows.withColumn("c", texts.conflict(F.col("cb"), F.col("ca"))).where("c is not null").select("a", "b", "c.kind", "c.confidence")


# ---- text functions
_TRIM = "trim(content)"


def _like(parts) -> str:
    return "(" + " or ".join("contains(lower(trim(content)), '" + p.replace("'", "''") + "')" for p in parts) + ")"


_NOUN = "len(list_filter(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda w: w <> '')[2:], lambda w: regexp_matches(w, '^[A-Z]') and strlen(w) > 1)) > 0"
_COUNT = "len(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda w: w <> ''))"
_TRIVIAL = ", ".join(f"'{t}'" for t in texts.TRIVIAL)


@C.add(
    WITH
    + f"""select id, round(case when strlen({_TRIM}) = 0 or lower({_TRIM}) in ({_TRIVIAL}) then 0 when strlen({_TRIM}) < 15 and not {_NOUN} and not regexp_matches(content, '[0-9]') then 0.1 when ends_with({_TRIM}, '?') and strlen({_TRIM}) < 30 and not {_NOUN} then 0.2
else least(1, 0.4 + case when {_like(texts.FIRST_PERSON)} then 0.3 else 0 end + case when {_NOUN} then 0.2 else 0 end + case when regexp_matches(content, '[0-9]') then 0.1 else 0 end + case when {_like(texts.TEMPORAL)} then 0.15 else 0 end + case when {_COUNT} >= 10 then 0.1 else 0 end + case when {_COUNT} >= 20 then 0.1 else 0 end) end::double, 6) score from msg where content is not null"""
)
def significance(spark, folder):
    return messages(spark, folder).where("content is not null").select("id", F.round(texts.significance(F.col("content")), 6).alias("score"))


@C.add(WITH + r"select id, regexp_extract_all(regexp_replace(content, '^\S+\s*', ''), '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*') nouns from mem")
def proper_nouns(spark, folder):
    return memories(spark, folder, "content").select("id", texts.proper_nouns(F.col("content")).alias("nouns"))


@C.add(WITH + """select id, regexp_extract_all(content, '"([^"]+)"', 1) quotes from msg""")
def quoted(spark, folder):
    return messages(spark, folder).select("id", texts.quoted(F.col("content")).alias("quotes"))


@C.add(WITH + r"""select id, list_filter(list_transform(regexp_split_to_array(content, '\s+'), lambda w: trim(w, '.,!?;:''"')), lambda w: regexp_full_match(w, '[0-9]+')) numbers from mem""")
def numeric_tokens(spark, folder):
    return memories(spark, folder, "content").select("id", texts.numbers(F.col("content")).alias("numbers"))


@C.add(WITH + f", p as (select id, content cb, lag(content) over (partition by entity_id order by created_at, id) ca from mem) select id, round({_COVER.format(new='cb', old='ca')}, 6)::double share from p where ca is not null")
def word_subset(spark, folder):
    from pyspark.sql.window import Window

    rows = memories(spark, folder, "entity_id", "content", "created_at").withColumn("before", F.lag("content").over(Window.partitionBy("entity_id").orderBy("created_at", "id")))
    return rows.where("before is not null").select("id", F.round(texts.covered(F.col("content"), F.col("before")), 6).alias("share"))


_LESS = ", ".join(f"'{w}'" for w in texts.SUBJECTLESS)
_MEAN = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: strlen(w) > 2 and w not in (" + _LESS + ")))"


@C.add(WITH + f", p as (select id, content, lag(content) over (partition by entity_id order by created_at, id) old from mem), m as (select id, {_MEAN.format('content')} a, {_MEAN.format('old')} b from p where old is not null) select id, case when least(len(a), len(b)) = 0 then false else len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.3 end same from m")
def same_subject(spark, folder):
    from pyspark.sql.window import Window

    rows = memories(spark, folder, "entity_id", "content", "created_at").withColumn("before", F.lag("content").over(Window.partitionBy("entity_id").orderBy("created_at", "id")))
    return rows.where("before is not null").select("id", texts.same_subject(F.col("content"), F.col("before")).alias("same"))


@C.add(WITH + "select id, entity_id, used::bigint used from (select *, sum(least(strlen(content), 240) + 1) over (partition by entity_id order by importance desc nulls last, id rows unbounded preceding) used from mem where state = 'active') where used <= 4096")
def budget_prefix(spark, folder):
    rows = memories(spark, folder, "entity_id", "content", "importance", "state").where("state = 'active'")
    return texts.within_budget(rows, "content", [F.col("importance").desc_nulls_last(), F.col("id").asc()], 4096, "entity_id").select("id", "entity_id", "used")


@C.add(WITH + "select topic, count(*) n from (select unnest(list_concat([lower(memory_type)], list_transform(list_filter(tags, lambda t: not starts_with(t, 'cron:')), lambda t: lower(t)))) topic from mem) group by 1")
def tag_topics(spark, folder):
    rows = memories(spark, folder, "memory_type", "tags")
    return rows.select(F.explode(texts.topics(F.col("memory_type"), F.col("tags"))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@C.add(WITH + "select id, sha256(content) h, substr(sha256(content), 1, 16) short, substr(content, 1, 80) label from mem")
def sha(spark, folder):
    return memories(spark, folder, "content").select("id", F.sha2("content", 256).alias("h"), F.substring(F.sha2("content", 256), 1, 16).alias("short"), F.substring("content", 1, 80).alias("label"))


@C.add("with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings), c as (select * from v where vec_id = 1) select v.vec_id, round(list_dot_product(v.e, c.e) / sqrt(list_dot_product(v.e, v.e)) / sqrt(list_dot_product(c.e, c.e)), 6) similarity from v, c")
def vector_scan(spark, folder):
    query = query_vector(spark, folder)
    return table(spark, folder, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), query), 6).alias("similarity"))


_FREE = "len(list_filter(tags, lambda t: regexp_matches(t, '^(cron:|hourly|daily|weekly|weekdays|monthly|every:|once:)'))) = 0"
_GROUPS = (WITH + _VPAIRS).strip().removeprefix("with ") + f""", f as (select p.a, p.b from p join mem x on x.id = p.a join mem y on y.id = p.b where c >= 0.92 - 1e-9 and coalesce(x.agent_id, '') = coalesce(y.agent_id, '') and x.{_FREE.replace('tags', 'tags')} and len(list_filter(y.tags, lambda t: regexp_matches(t, '^(cron:|hourly|daily|weekly|weekdays|monthly|every:|once:)'))) = 0),
walk as (select a r, a n from f union select b, b from f union select r, case when f.a = n then f.b else f.a end from walk join f on f.a = n or f.b = n),
g as (select n id, min(r) root from walk group by 1)"""


def _groups(spark, folder):
    rows = memories(spark, folder, "entity_id", "embedding", "state", "tags", "agent_id", "importance", "confidence", "visibility")
    live = rows.where((F.col("state") == "active") & (F.size("embedding") == 64))
    return rows, consolidate.groups(rows, search.similarity_pairs(live, "entity_id", 0.92))


@C.add("with recursive " + _GROUPS.replace("x.len(list_filter(tags,", "len(list_filter(x.tags,") + " select * from g")
def consolidation_groups(spark, folder):
    return _groups(spark, folder)[1]


@C.add("with recursive " + _GROUPS.replace("x.len(list_filter(tags,", "len(list_filter(x.tags,") + """, j as (select m.*, g.root, coalesce(importance, 0) i, case lower(visibility) when 'private' then 1 when 'team' then 2 when 'global' then 3 else 1 end k from mem m join g using (id)),
h as (select root, arg_min(id, (-i, id)) first_id, count(*) members, round(least(1, avg(i) * (1 + 0.1 * (count(*) - 1))), 6)::double importance, max(confidence) confidence, ['private', 'team', 'global'][min(k)] visibility, list_sort(list(id)) ids from j group by 1)
select first_id "primary", members, importance, confidence, visibility, list_filter(ids, lambda x: x <> first_id) derived_from from h""")
def consolidated(spark, folder):
    rows, grouped = _groups(spark, folder)
    return consolidate.consolidated(rows, grouped)


@C.add()
def conflict_votes(spark, folder):
    rows = _close(spark, folder, 0.6).withColumn("c", texts.conflict(F.col("cb"), F.col("ca"))).where("c is not null")
    return consolidate.vote(rows.select(F.col("a").alias("id"), F.col("c.kind").alias("resolution"), F.col("c.confidence").alias("confidence")))


@C.add(WITH + "select id, round(1 / case when expires_at <= timestamp '2024-02-01' then 0.1 else greatest((epoch_us(expires_at) - epoch_us(timestamp '2024-02-01')) / 3600000000.0, 0.5) end, 6)::double proximity from mem where expires_at is not null and state = 'active'")
def deadline_proximity(spark, folder):
    rows = memories(spark, folder, "expires_at", "state").where("expires_at is not null and state = 'active'")
    return rows.select("id", F.round(scoring.deadline_proximity(F.col("expires_at"), NOW), 6).alias("proximity"))


@C.add()
def hashed_embeddings(spark, folder):
    return messages(spark, folder).select("id", embedding(F.col("content"), HashingEmbedder(64)).alias("embedding"))


@C.add()
def rule_extraction(spark, folder):
    return RuleExtractor().extract(messages(spark, folder))
