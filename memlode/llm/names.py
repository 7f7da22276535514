"""Variant spellings of names: entities of one owner and type that mean the same person or organisation.

Every spelling of an entity (its name, aliases and mentions) is cut into tokens, and the tokens' suffixes are the
blocks. A suffix that too many entities share is refined by the neighbouring token; none is discarded. Pairs that meet are compared by the
ratio of the longest common subsequence of their surnames (or of the organisations' own words), and by whether
the given names (or the lines of business) can be the same. Links are closed transitively per owner. Organisations'
names of three letters or fewer ('IBM', but 'HQ' too) link nothing that whole names keep apart (``_settled``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.llm.given_names import full_names, plain
from memlode.operators.graph import components
from memlode.runtime import kept
from memlode.sources.parquet import newest

# Fixed values, from general knowledge: words that open a role instead of a name; words that are a role alone; titles; legal forms; lines of business and their short forms.
DETERMINERS = {"the", "my", "our", "that", "this", "his", "her", "their", "your"}
ROLES = {"hq", "headquarters", "office", "client", "customer", "vendor", "supplier"}
TITLES = {"dr", "mr", "mrs", "ms", "miss", "prof", "professor", "herr", "frau", "sr", "sra", "mme"}
LEGAL = {"inc", "incorporated", "llc", "ltd", "limited", "gmbh", "plc", "corp", "corporation", "co", "company", "sa", "ag", "bv", "pty"}
BUSINESS = {
    "academy": ["acad"], "advertising": ["advert", "adv"], "agency": ["agcy"], "airlines": ["airl"], "architects": ["archs", "arch"], "associates": ["assoc", "assocs"], "association": ["assn"], "automotive": ["auto"], "aviation": ["avn", "avi"], "bank": ["bk"], "bakery": [], "brothers": ["bros", "bro"], "capital": ["cap"], "chemicals": ["chem", "chems"], "college": ["coll"], "communications": ["comm", "comms"], "construction": ["constr", "const"],
    "consulting": ["cons", "consult"], "contractors": ["contr"], "department": ["dept"], "design": ["des"], "development": ["dev"], "distribution": ["distr"], "education": ["edu", "educ"], "electronics": ["elec", "elect"], "energy": ["enrg"], "engineering": ["eng", "engr", "engg"], "enterprises": ["ent", "entpr"], "equipment": ["equip"], "finance": ["fin"], "foods": ["food", "fds"], "foundation": ["fdn", "found"], "group": ["grp"], "holdings": ["hldgs"],
    "hospital": ["hosp"], "industries": ["ind", "inds"], "institute": ["inst"], "insurance": ["ins", "insur"], "international": ["intl", "int"], "investments": ["inv", "invest"], "laboratories": ["labs", "lab"], "logistics": ["log", "logist"], "machinery": ["mach"], "management": ["mgmt", "mgt"], "manufacturing": ["mfg", "manuf"], "marketing": ["mktg"], "media": [], "medical": ["med"], "ministry": ["min"], "motors": ["mtrs"], "packaging": ["pkg"],
    "partners": ["ptnrs"], "pharmaceuticals": ["pharma", "pharm"], "printing": ["prtg"], "products": ["prods", "prod"], "properties": ["prop", "props"], "publishing": ["publ", "pub"], "railways": ["rlys", "rly"], "research": ["res", "rsch"], "restaurants": ["rest"], "retail": ["ret"], "school": ["sch"], "security": ["sec"], "services": ["svcs", "svc", "serv"], "shipping": ["shpg"], "society": ["soc"], "software": ["softw"], "solutions": ["soln", "solns"],
    "studios": ["stud"], "supplies": ["supp"], "systems": ["sys"], "technologies": ["tech", "techs"], "telecommunications": ["telecom", "tel"], "trading": ["trdg"], "transport": ["transp", "trans"], "travel": ["trvl"], "university": ["univ", "uni"], "ventures": ["vent"], "works": ["wks"],
}
_SHORT = {s: full for full, shorts in BUSINESS.items() for s in (full, *shorts)}
_TOKEN = re.compile(r"[^\W_]+")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel in the characters of ``a``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    return 0.0 if not a or not b else 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b))


def _tokens(form: str) -> list[str]:
    return _TOKEN.findall(plain(form))


def is_role(form: str) -> bool:
    """'the landlord', 'my sister': a determiner and no more than two words in all; 'HQ': a role alone."""
    t = _tokens(form)
    return not t or t[0] in DETERMINERS and len(t) <= 2 or len(t) == 1 and t[0] in ROLES


def person(form: str, known: dict[str, set[str]]) -> set[tuple[str, str]]:
    """Readings (given, surname) of a spelling; given '' if there is one token only.

    A comma, an initial or a list of given names may tell which token is the surname; where nothing does, both
    readings are kept and the comparison finds out which one fits.
    """
    t = [w for w in _tokens(form) if w not in TITLES]
    if not t:
        return set()
    if len(t) == 1:
        return {("", t[0])}
    if "," in form:
        head = [w for w in _tokens(form.split(",")[0]) if w not in TITLES]
        rest = [w for w in t if w not in head]
        if head and rest:
            return {(max(rest, key=len), head[-1])}
    first, last = t[0], t[-1]
    if len(last) == 1:
        return {(last, first)}
    if len(first) == 1 or first in known and last not in known or re.match(r"\W*\w{2,5}\.", form):
        return {(first, last)}
    if last in known and first not in known:
        return {(last, first)}
    return {(first, last), (last, first)}


def organisation(form: str) -> tuple[frozenset[str], str]:
    """(lines of business, the other words run together)."""
    t = [w for w in _tokens(form) if w not in LEGAL and w not in ("and", "the")]
    lines = frozenset(_SHORT[w] for w in t if w in _SHORT)
    own = [w for w in t if w not in _SHORT]
    if not lines:  # a misspelt line of business
        for w in own:
            best = max(BUSINESS, key=lambda b: ratio(w, b))
            if len(own) > 2 and ratio(w, best) >= 0.8:
                lines, own = frozenset([best]), [x for x in own if x != w]
                break
    return lines, "".join(own)


class Comparer:
    """Judges pairs of entities by all their spellings. ``least``: subsequence ratio of surnames and own words."""

    def __init__(self, known: dict[str, set[str]], least: float):
        self.known, self.least = known, least
        self.cache: dict[str, tuple] = {}
        self.full_of: dict[str, tuple[frozenset[str], str]] = {}
        self.longer = sorted(k for k in known if len(k) >= 4)

    def _fulls(self, given: str) -> tuple[frozenset[str], str]:
        """Full names a given name may stand for, and its letters if it is cut short."""
        if given not in self.full_of:
            if len(self.full_of) > 200_000:
                self.full_of.clear()
            self.full_of[given] = self._read_given(given)
        return self.full_of[given]

    def _read_given(self, given: str) -> tuple[frozenset[str], str]:
        if given in self.known:
            return frozenset(self.known[given]), ""
        if len(given) <= 5:
            begun = frozenset(f for fs in self.known.values() for f in fs if f.startswith(given))
            if begun or len(given) == 1:
                return begun, given
        best = max((k for k in self.longer if abs(len(k) - len(given)) < 3), key=lambda k: ratio(given, k), default="")
        if best and ratio(given, best) >= 0.78:
            return frozenset(self.known[best]) | {given}, ""
        return frozenset([given]), given if len(given) <= 4 else ""

    def _may_equal(self, a: str, b: str) -> bool:
        """Whether two given names may be one: the same full name, one cut short, or one misspelt."""
        if a == b:
            return True
        fulls_a, cut_a = self._fulls(a)
        fulls_b, cut_b = self._fulls(b)
        if fulls_a & fulls_b:
            return True
        if cut_a and any(f.startswith(cut_a) for f in (b, *fulls_b)) or cut_b and any(f.startswith(cut_b) for f in (a, *fulls_a)):
            return True
        unlisted = not (a in self.known and b in self.known)
        return unlisted and min(len(a), len(b)) > 3 and a[0] == b[0] and ratio(a, b) >= self.least + 0.02

    def _sure(self, given: str) -> bool:
        return not self._fulls(given)[1]

    def read(self, key: str, kind: str, forms: list[str]) -> tuple:
        if key not in self.cache:
            if len(self.cache) > 20_000:
                self.cache.clear()
            forms = [f for f in forms if f and not is_role(f)]
            if kind == "person":
                parsed = set().union(*(person(f, self.known) for f in forms))
                self.cache[key] = ({(g, s) for g, s in parsed if g}, {s for g, s in parsed if not g and s not in self.known})
            else:
                read = {f: organisation(f) for f in forms}
                whole = [[w for w in _tokens(f) if w not in LEGAL and w not in ("and", "the")] for f, (_, own) in read.items() if len(own) > 3]
                self.cache[key] = (set(read.values()), whole)
        return self.cache[key]

    def same(self, kind: str, a: tuple, b: tuple) -> bool:
        return bool(self.links(kind, a, b))

    def links(self, kind: str, a: tuple, b: tuple) -> list[tuple[str | None, bool, bool]]:
        """What links two entities: (None, ..) if nothing else is needed, else each short name they share and which of the two have a whole name beside it."""
        if kind == "person":
            return [(None, False, False)] if self._persons(a, b) else []
        return [(None, False, False)] if self._organisations(a[0], b[0]) else self._short_names(a, b)

    def _persons(self, a: tuple, b: tuple) -> bool:
        """One surname in common, and given names under it that may be one: whole ones decide, cut ones only where a side has no whole one."""
        whole_a, alone_a = a
        whole_b, alone_b = b
        for alone, whole, own in ((alone_a, whole_b, whole_a), (alone_b, whole_a, whole_b)):  # 'zhedfivmad' and Zoltan Hedfivmad
            if not any(self._sure(g) for g, _ in own) and any(len(t) > len(s) and ratio(t, g[:1] + s) >= 0.9 or ratio(t, g + s) >= 0.9 for t in alone for g, s in whole):
                return True
        for surname, other in {(s, t) for _, s in whole_a for _, t in whole_b}:
            if ratio(surname, other) < self.least or min(len(surname), len(other)) < 4 and surname != other:
                continue
            near = (surname, other)
            given_a = {g for g, s in whole_a if max(ratio(s, n) for n in near) >= self.least}
            given_b = {g for g, s in whole_b if max(ratio(s, n) for n in near) >= self.least}
            sure_a, sure_b = {g for g in given_a if self._sure(g)}, {g for g in given_b if self._sure(g)}
            if sure_a and sure_b:
                given_a, given_b = sure_a, sure_b
            if any(self._may_equal(x, y) for x in given_a for y in given_b):
                return True
        return False

    def _organisations(self, a: set, b: set) -> bool:
        for lines, own in a:
            for other_lines, other in b:
                if not own or not (lines & other_lines or not lines and not other_lines):
                    continue
                if len(own) > 3 and len(other) > 3 and ratio(own, other) >= self.least + 0.05:
                    return True
        return False

    def _short_names(self, a: tuple, b: tuple) -> list[tuple[str | None, bool, bool]]:
        """Equal names of three letters or fewer. Whole names that aren't alike deny them, unless the short name is the initials of both."""
        got: set[tuple[str | None, bool, bool]] = set()
        for lines, own in a[0]:
            for other_lines, other in b[0]:
                if not own or own != other or len(own) > 3 or not (lines & other_lines or not lines and not other_lines):
                    continue
                told_a, told_b = (any(own not in words for words in side[1]) for side in (a, b))
                initials = all(any("".join(w[0] for w in words) == own for words in side[1]) for side in (a, b))
                if initials or all({o for _, o in side[0]} == {own} for side in (a, b)):
                    return [(None, False, False)]
                if not (told_a and told_b):
                    got.add((f"{own} {min(lines & other_lines, default='')}", told_a, told_b))
        return sorted(got)


def _name_tokens(known: dict[str, set[str]]):
    """Tokens of each entity to be indexed, with the first letters of the tokens beside them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, tokens, beside = [], [], []
            for id_, forms in zip(batch["id"], batch["forms"], strict=True):
                got: dict[str, set[str]] = {}
                for form in forms:
                    if is_role(form):
                        continue
                    t = [w for w in _tokens(form) if w not in LEGAL and w not in TITLES and w not in _SHORT and w not in ("and", "the")]
                    more = ["".join(t)] if 2 <= len(t) <= 3 else []
                    more += [full for w in t if len(t) > 1 for full in known.get(w, ()) if full != w]  # short forms also stand under the full name
                    for i, w in enumerate(t + more):
                        if len(w) > 1:
                            got.setdefault(w, set()).update([x[:1] for j, x in enumerate(t) if j != i] or [w[:1]])
                for token, others in got.items():
                    ids.append(id_), tokens.append(token), beside.append(sorted(others))
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "token": pd.Series(tokens, dtype=object), "beside": pd.Series(beside, dtype=object)})

    return run


def _judge(known: dict[str, set[str]], least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        comparer = Comparer(known, least)
        for batch in batches:
            rows = []
            for kind, owner, a, b, fa, fb in zip(*(batch[c] for c in ("type", "owner", "a", "b", "fa", "fb")), strict=True):
                rows += [(owner, a, b, *link) for link in comparer.links(kind, comparer.read(a, kind, list(fa)), comparer.read(b, kind, list(fb)))]
            yield pd.DataFrame(rows, columns=["owner", "a", "b", "name", "told_a", "told_b"]).astype({"owner": object, "a": object, "b": object, "name": object, "told_a": bool, "told_b": bool})

    return run


def _settled(links: DataFrame) -> DataFrame:
    """(id, root) of links (owner, a, b, name, told_a, told_b): those without a name first, then those by a short name.

    A short name links whoever bears it in an owner if the entities that have whole names beside it (told) are one by
    now. If they are several, it is a role ('HQ') or means several organisations, and links nothing.
    """
    roots = components(links.where("name is null").select("a", "b"))
    short = links.where("name is not null")
    if short.isEmpty():
        return roots
    ends = short.select("owner", "name", F.col("a").alias("id"), F.col("told_a").alias("told")).unionByName(short.select("owner", "name", F.col("b").alias("id"), F.col("told_b").alias("told"))).distinct()
    ends = kept(ends.join(roots, "id", "left").select("owner", "name", F.coalesce("root", "id").alias("a"), "told"), "short")
    told = F.when(F.col("told"), F.col("a"))
    clear = ends.groupBy("owner", "name").agg(F.min(told).alias("low"), F.max(told).alias("high"), F.min("a").alias("b")).where("low is null or low = high")
    joined = components(ends.join(clear, ["owner", "name"]).select("a", "b").where("a <> b").distinct())
    nodes = roots.unionByName(joined.select("id", F.col("id").alias("root"))).distinct()
    return nodes.join(joined.select(F.col("id").alias("root"), F.col("root").alias("_top")), "root", "left").select("id", F.coalesce("_top", "root").alias("root"))


def spellings(entities: DataFrame, mentions: DataFrame, types: tuple[str, ...] = ("person", "organization")) -> DataFrame:
    """(id, owner, type, forms): the newest row of each entity with all distinct spellings; each (entity, spelling) pair is made distinct before spellings are gathered."""
    rows = newest(entities.select("id", "owner_entity_id", "type", "canonical_name", "aliases", "updated_at"), "id", ["owner_entity_id", "type", "canonical_name", "aliases"], ["updated_at"])
    base = rows.select("id", F.col("owner_entity_id").alias("owner"), F.lower(F.trim("type")).alias("type"), F.array_compact(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("forms"))
    base = base.where(F.col("type").isin(*types) & F.col("owner").isNotNull())
    said = mentions.where("entity_id is not null and mention_text is not null").select(F.trim("entity_id").alias("id"), "mention_text").distinct().groupBy("id").agg(F.collect_list("mention_text").alias("said"))
    joined = base.join(said, "id", "left")
    return joined.select("id", "owner", "type", F.array_distinct(F.concat("forms", F.coalesce("said", F.array().cast("array<string>")))).alias("forms"))


def linked(entities: DataFrame, mentions: DataFrame, names: dict[str, set[str]] | None = None, least: float = 0.8, shortest: int = 4, common: int = 60) -> DataFrame:
    """(id, root): entities that some other entity of their owner and type equals, with the smallest id of their group.

    ``names``: given names and short forms, lower case without accents -> full names. ``common``: entities per
    suffix beyond which the suffix is refined by the first letter of a neighbouring token; no refined
    block is discarded, whatever its size. Defined cases: null names or
    aliases, roles ('the landlord') and names without letters link nothing; null owners or types link nothing;
    repeated rows of an id count once, the newest; empty tables give no rows; other columns are ignored.
    """
    known = full_names() if names is None else names
    base = kept(spellings(entities, mentions).where(F.size("forms") > 0), "spellings")
    tokens = base.select("id", "forms").mapInPandas(_name_tokens(known), "id string, token string, beside array<string>")
    tokens = kept(tokens.join(base.select("id", "owner", "type"), "id").select("id", F.xxhash64("owner", "type").alias("group"), "token", "beside"), "tokens")
    # whoever shares a longer suffix shares the shortest one, so longer ones are indexed only where the shortest is too common
    index = tokens.select("id", "group", "token", "beside", F.xxhash64("group", F.substring("token", -shortest, shortest)).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = kept(index.join(sizes, "key"), "sized")
    plain_keys = sized.where(F.col("n") <= common).select("id", "key")
    big = sized.where(F.col("n") > common)
    ends = F.transform(F.sequence(F.lit(shortest), F.greatest(F.length("token"), F.lit(shortest))), lambda n: F.xxhash64("group", F.expr("token").substr(-n, n)))
    longer = big.select("id", "beside", F.explode(ends).alias("key"))
    fine = longer.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    longer = longer.join(fine, "key")
    refined = longer.where(F.col("m") > common).select("id", F.explode("beside").alias("other"), "key").select("id", F.xxhash64("key", "other").alias("key"))
    blocks = plain_keys.unionByName(longer.where(F.col("m") <= common).select("id", "key")).unionByName(refined).distinct()
    pairs = blocks.select(F.col("id").alias("a"), "key").join(blocks.select(F.col("id").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    left, right = base.select(F.col("id").alias("a"), "owner", "type", F.col("forms").alias("fa")), base.select(F.col("id").alias("b"), F.col("owner").alias("_owner"), F.col("type").alias("_type"), F.col("forms").alias("fb"))
    judged = pairs.join(left, "a").join(right, "b").where("owner = _owner and type = _type").select("type", "owner", "a", "b", "fa", "fb")
    return _settled(kept(judged.mapInPandas(_judge(known, least), "owner string, a string, b string, name string, told_a boolean, told_b boolean"), "links"))


def same_pairs(groups: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b): every pair of one group, smaller id first."""
    a, b = groups.select("root", F.col("id").alias("entity_id_a")), groups.select("root", F.col("id").alias("entity_id_b"))
    return a.join(b, "root").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
