import numpy as np
import pytest

from memlode.llm import vectors

SCHEMA = "id string, v array<float>, version int, vec string, unit int"


def frame(spark, items):
    return spark.createDataFrame([(i, v, 1, "clash", 0) for i, v in items], SCHEMA)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 16))
    x = np.repeat(centres, 4, axis=0) + rng.normal(size=(600, 16)) * 0.08
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact(x, k, least):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {(f"m{i:03}", f"m{j:03}") for i in range(len(x)) for j in np.argsort(-s[i])[:k] if s[i, j] >= least}


def test_pairs_over_a_threshold(spark, clustered):
    rows = [(f"m{i:03}", [float(c) * (1 + i % 3) for c in v]) for i, v in enumerate(clustered)]
    rows += [("n1", None), ("n2", [1.0]), ("n3", [0.0] * 16), ("n4", [float("nan")] + [1.0] * 15), ("n5", [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    got = {tuple(r) for r in vectors.similar_pairs(frame(spark, rows), "id", "v", ["version"], least=0.9, k=5, dims=16).collect()}
    want = {(min(p), max(p)) for p in exact(clustered, 5, 0.9)}
    assert got <= want
    assert len(got) >= 0.99 * len(want)


def test_recall_of_the_nearest_in_blocks(spark, clustered):
    rows = frame(spark, [(f"m{i:03}", [float(c) for c in v]) for i, v in enumerate(clustered)])
    asked = spark.createDataFrame([(f"m{i:03}",) for i in range(0, 600, 10)], "id string")
    near = vectors.nearest(rows, "id", "v", ["version"], k=5, dims=16, spread=8, keep=60, block_rows=40, queries=asked).collect()
    got = {(r.id, r.other_id) for r in near}
    want = {p for p in exact(clustered, 5, -1) if int(p[0][1:]) % 10 == 0}
    assert {r.id for r in near} == {f"m{i:03}" for i in range(0, 600, 10)}
    assert len(got & want) >= 0.9 * len(want)


def test_equal_vectors_tie_by_id(spark):
    same = [1.0, 2.0] + [0.0] * 14
    rows = [(f"m{i}", same) for i in range(9)] + [("z", [0.0] * 15 + [1.0])]
    got = {}
    for r in vectors.nearest(frame(spark, rows), "id", "v", ["version"], k=3, dims=16, least=0.9).collect():
        got.setdefault(r.id, []).append((r.place, r.other_id))
    assert sorted(got["m0"]) == [(1, "m1"), (2, "m2"), (3, "m3")]
    assert sorted(got["m8"]) == [(1, "m0"), (2, "m1"), (3, "m2")]
    assert "z" not in got


def test_small_and_empty(spark):
    assert vectors.nearest(frame(spark, []), "id", "v", ["version"], dims=16).collect() == []
    assert vectors.nearest(frame(spark, [("a", [1.0] * 16)]), "id", "v", ["version"], dims=16).collect() == []


def test_anisotropic_codes_keep_high_products_better(clustered):
    plain, aware = (vectors.train(clustered.astype(np.float32), 8, threshold=t) for t in (1e-6, 0.6))
    error = lambda q: np.abs(((q.decode(q.encode(clustered.astype(np.float32))) - clustered) * clustered).sum(1)).mean()
    assert error(aware) < error(plain)


def test_dense_cluster_beyond_the_candidates_kept(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=64) + rng.normal(size=(400, 64)) * 0.15, rng.normal(size=(400, 64))])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = frame(spark, [(f"m{i:03}", [float(c) for c in v]) for i, v in enumerate(x)])
    got = {tuple(r) for r in vectors.similar_pairs(rows, "id", "v", ["version"], least=0.93, k=5, dims=64, cells=1).collect()}
    want = {(min(p), max(p)) for p in exact(x, 5, 0.93)}
    assert len(got & want) >= 0.99 * len(want) and len(want) > 400


def test_tables_add_up_to_inner_products(clustered):
    x = clustered.astype(np.float32)
    made = vectors.train(x, 8)
    codes, asked = made.encode(x), x[:20]
    packed = (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.intp)
    tables, step, offset = made.tables(asked)
    sums = sum(tables[:, c][:, packed[:, c]].astype(int) for c in range(packed.shape[1]))
    error = np.abs(sums * step[:, None] + offset[:, None] - asked @ made.decode(codes).T)
    assert tables.dtype == np.uint8 and tables.max() == 255 and (error <= step[:, None] * packed.shape[1] / 2 + 1e-6).all()


def test_cells_of_two_levels(spark, clustered, monkeypatch):
    rows = frame(spark, [(f"m{i:03}", [float(c) for c in v]) for i, v in enumerate(clustered)])
    got = {(r.id, r.other_id) for r in vectors.nearest(rows, "id", "v", ["version"], k=3, dims=16, spread=12, keep=60, sample=80, cells=40).collect()}
    want = exact(clustered, 3, -1)
    assert len(got & want) >= 0.9 * len(want)
