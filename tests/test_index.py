import numpy as np
import pytest

from memlode.operators import commands, index, search

SCHEMA = "id string, v array<double>, extra string"


def frame(spark, ids, x):
    return spark.createDataFrame([(i, [float(c) for c in v], None) for i, v in zip(ids, x, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    x = np.repeat(centres, 20, axis=0) + rng.normal(size=(400, 8)) * 0.1
    path = str(tmp_path_factory.mktemp("index") / "v1")
    index.build(frame(spark, [f"m{i:03}" for i in range(400)], x), "id", "v", path, cells=10)
    return path, x


def exact(x, q, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [f"m{i:03}" for i in np.argsort(-(unit @ (q / np.linalg.norm(q))), kind="stable")[:k]]


def test_search_finds_the_nearest(spark, made):
    path, x = made
    hits = [len(set(exact(x, q, 5)) & {r.id for r in index.search(spark, path, q.tolist(), 5, probes=3).collect()}) for q in x[::40]]
    assert sum(hits) >= 0.9 * 5 * len(hits)
    many = index.search_many(spark.createDataFrame([(str(i), x[i].tolist()) for i in range(0, 400, 40)] + [("bad", [1.0]), ("none", None)], "query string, vector array<double>"), path, 5, probes=10).collect()
    assert all(sorted(r.id for r in many if r.query == str(i)) == sorted(exact(x, x[i], 5)) for i in range(0, 400, 40)) and not {"bad", "none"} & {r.query for r in many}


def test_insert_replaces_and_delete_removes(spark, made, tmp_path):
    path, x = made
    new = frame(spark, ["m000", "z", "zero", "short"], [[0, 0, 0, 0, 0, 0, 0, 1.0], [0, 0, 0, 0, 0, 0, 1.0, 0], [0.0] * 8, [1.0] * 8][:4])
    index.inserted(new, "id", "v", path, str(tmp_path / "v2"))
    assert index.load(spark, str(tmp_path / "v2"))[0].count() == 402  # 400, one of them replaced, and two new; a zero vector has no direction
    assert index.search(spark, str(tmp_path / "v2"), [0, 0, 0, 0, 0, 0, 0, 1.0], 1, probes=10).first().id == "m000"
    index.deleted(spark.createDataFrame([("m000",), ("gone",)], "id string"), str(tmp_path / "v2"), str(tmp_path / "v3"))
    assert index.search(spark, str(tmp_path / "v3"), [0, 0, 0, 0, 0, 0, 0, 1.0], 1, probes=10).first().id != "m000"
    assert index.load(spark, path)[0].count() == 400
    with pytest.raises(ValueError):
        index.build(frame(spark, ["a"], [[0.0] * 8]), "id", "v", str(tmp_path / "none"))


def test_pairs_between_two_sides_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 6)), rng.normal(size=(90, 6))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = unit(x) @ unit(y).T
    side = lambda name, v: spark.createDataFrame([(f"{name}{i:02}", f"g{i % 2}", [float(c) for c in r]) for i, r in enumerate(v)] + [(f"{name}null", "g0", None), (f"{name}zero", "g0", [0.0] * 6)], "id string, g string, embedding array<double>")
    want = {(f"a{i:02}", f"b{j:02}") for i in range(60) for j in range(90) if i % 2 == j % 2 and scores[i, j] >= 0.5}
    for block in (7, 2000):
        got = [(r.a, r.b) for r in search.similarity_between(side("a", x), side("b", y), "g", 0.5, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        top = search.similarity_between(side("a", x), side("b", y), "g", -1.0, top=3, block=block).collect()
        best = {(f"a{i:02}", f"b{j:02}") for i in range(60) for j in sorted((j for j in range(90) if j % 2 == i % 2), key=lambda j: -scores[i, j])[:3]}
        assert {(r.a, r.b) for r in top} == best
    both = np.concatenate([x, x[:5]])
    pairs = [(r.a, r.b) for r in search.similarity_pairs(side("a", both), "g", 0.5, block=9).collect()]
    s = unit(both) @ unit(both).T
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(f"a{i:02}", f"a{j:02}") for i in range(65) for j in range(i + 1, 65) if i % 2 == j % 2 and s[i, j] >= 0.5}


def test_names_resolve_by_vector_within_the_owner(spark):
    names = spark.createDataFrame([("u1", "Bob", [1.0, 0.1]), ("u2", "Bob", [1.0, 0.1]), ("u1", "Zed", [-1.0, 0.0])], "owner string, name string, vector array<double>")
    entities = spark.createDataFrame([("e1", "u1", [1.0, 0.0]), ("e2", "u1", [1.0, 0.0]), ("e3", "u2", [0.0, 1.0])], "id string, owner_entity_id string, vector array<double>")
    got = commands.resolved_by_vector(names, entities).collect()
    assert [(r.owner, r.name, r.entity_id) for r in got] == [("u1", "Bob", "e1")]
