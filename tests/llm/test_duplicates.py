from datetime import datetime
from itertools import combinations

import numpy as np
import pytest

from memlode.llm import copies, near

T, U = datetime(2024, 1, 1), datetime(2024, 1, 2)
SCHEMA = "id string, entity_id string, content string, updated_at timestamp_ntz, version int, record string, _text string, grams int"


def rows(spark, items):
    return spark.createDataFrame([(i, o, t, T, 1, "clash", None, 0) for i, o, t in items], SCHEMA)


def pairs(spark, items, **options):
    keys = copies.record_keys(rows(spark, items), "id", "content", ["updated_at", "version"])
    return {tuple(r) for r in copies.copies(keys, **options).collect()}, {tuple(r) for r in copies.record_counts(keys, **options).collect()}


LOOKS = [
    ("m1", "a", "Café in the Straße, 12:30!"),
    ("m2", "b", "CAFÉ IN THE STRASSE 12 30"),
    ("m3", "a", "café  in\nthe\tstraße — 1230"),
    ("m4", "a", "Cafe in the Straße 12:30"),
    ("m5", "a", "Room: blue; Due = 7:46"),
    ("m6", "c", "due: 7:46 | ROOM = Blue."),
    ("m7", "c", "room blue due 746"),
    ("m8", "c", "due 746 room blue"),
    ("m9", "c", ""),
    ("n1", None, " ... "),
    ("n2", "c", None),
    (None, "c", "x"),
]


@pytest.mark.parametrize("hot_rows", [1, 2, 3, 100])
def test_looks_fields_and_hot_records(spark, hot_rows):
    got, counts = pairs(spark, LOOKS, hot_rows=hot_rows, salts=3)
    assert got == {("m1", "m2"), ("m1", "m3"), ("m5", "m6"), ("m5", "m7"), ("m5", "m8"), ("m9", "n1")}
    assert dict(counts) == {"m1": 3, "m4": 1, "m5": 4, "m9": 2}


def test_chains_of_field_lists(spark):
    # one letter sequence read as two lists, each of which has another order elsewhere
    got, _ = pairs(spark, [("m1", "a", "ab: c; d: e"), ("m2", "a", "a: bc; d: e"), ("m3", "a", "d: e; ab: c"), ("m4", "a", "d: e; a: bc")])
    assert got == {("m1", "m2"), ("m1", "m3"), ("m1", "m4")}


def test_newest_row_holds_and_empty_table(spark):
    df = spark.createDataFrame([("m1", "a", "old text", T, 1), ("m1", "a", "new text", U, 2), ("m2", "a", "NEW TEXT", T, 1)], "id string, entity_id string, content string, updated_at timestamp_ntz, version int")
    keys = copies.record_keys(df, "id", "content", ["updated_at", "version"])
    assert {tuple(r) for r in copies.copies(keys).collect()} == {("m1", "m2")}
    assert pairs(spark, []) == (set(), set())


def brute(items, size=3, similarity=0.5):
    import re
    import unicodedata

    def grams(t):
        w = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t).casefold())
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFC", t).casefold() if c.isalnum())
    out = set()
    for (a, o, s), (b, p, t) in combinations([x for x in items if None not in x], 2):
        x, y = grams(s), grams(t)
        if o == p and a != b and plain(s) != plain(t) and x | y and len(x & y) / len(x | y) >= similarity:
            out.add((min(a, b), max(a, b)))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    items = []
    for g in range(12):
        base = list(rng.choice(words, rng.integers(3, 40)))
        for k in range(5):
            text = list(base)
            for _ in range(rng.integers(0, 4)):
                at = int(rng.integers(0, len(text)))
                text[at : at + int(rng.integers(0, 2))] = list(rng.choice(words, rng.integers(0, 2)))
            items.append((f"m{g:02}{k}", f"o{g % 2}", " ".join(text)))
    items += [("z1", "o0", ""), ("z2", "o0", None), ("z3", None, "w1 w2 w3 w4"), (None, "o0", "w1 w2 w3"), ("z4", "o0", "w1 w2"), ("z5", "o1", "long " * 20_000), ("z6", "o1", "long " * 20_000 + "end")]
    got = [tuple(r) for r in near.near_duplicates(rows(spark, items)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(items)


def test_copies_expand_to_all_members(spark):
    text = "one two three four five six seven eight nine ten"
    items = [("m1", "a", text), ("m2", "a", text.upper()), ("m3", "a", text + " eleven"), ("m4", "b", text + " eleven")]
    assert {tuple(r) for r in near.near_duplicates(rows(spark, items)).collect()} == {("m1", "m3"), ("m2", "m3")}
    assert near.near_duplicates(rows(spark, [])).collect() == []


def test_balls_find_every_pair_within_the_radius(spark):
    rng = np.random.default_rng(5)
    grams = [int(x) for x in rng.integers(-(2**62), 2**62, 400)]
    table = [(bytes([i]), "a", bytes([i]), grams[: 300 + i]) for i in range(20)]
    df = spark.createDataFrame(table, "kind binary, owner string, record binary, grams array<bigint>")
    prints = {}
    for kind, _, _, g in table:
        ones = ((np.array(g, dtype=np.int64).astype(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
        prints[kind] = 2 * ones > len(g)
    want = {(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] != prints[b]).sum() <= 2}
    got = {(bytes(r.a), bytes(r.b)) for r in near.ball_pairs(df, radius=2).collect()}
    assert got == want and want


def test_field_lists_and_their_letters_are_one_record(spark):
    items = [("m1", "a", "name: bob ross painter; city: rome the old"), ("m2", "a", "name bob ross painter city rome the old"), ("m3", "a", "name bob ross painter city rome the old town")]
    assert {tuple(r) for r in near.near_duplicates(rows(spark, items)).collect()} == {("m1", "m3"), ("m2", "m3")}


def test_groups(spark):
    base = "one two three four five six seven eight nine ten"
    items = [("m1", "a", base), ("m2", "a", base.upper()), ("m3", "a", base + " eleven"), ("m4", "a", "zero " + base), ("m5", "a", "else altogether nothing shared"), ("m6", "b", base)]
    got = {(r.id, r.class_id, r.group_id, r.links) for r in near.near_groups(rows(spark, items)).collect()}
    assert got == {("m1", "m1", "m1", 2), ("m2", "m1", "m1", 2), ("m3", "m3", "m1", 2), ("m4", "m4", "m1", 2)}
    assert near.near_groups(rows(spark, [])).collect() == []


def test_keys_of_many_records_meet_in_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(int(k), bytes([i])) for i in range(60) for k in set(rng.integers(0, 3, 2))]
    df = spark.createDataFrame(data, "key bigint, kind binary").selectExpr("key", "kind", "length(kind) n")
    want = sorted((a, b) for k, a in data for j, b in data if j == k and a < b)
    for block in (7, 1000):
        assert sorted((bytes(r.a), bytes(r.b)) for r in near._met(df, ["n"], block).collect()) == want
