"""Vector links and code search against brute force."""

import numpy as np
import pytest

from shardlens.llm import code_search, vector_links

SCHEMA = "vec_id long, embedding array<float>, node int, tile int"


def clusters(seed, n=1500, d=64):
    """Points with near neighbours at many cosines, exact copies, scaled copies."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(n):
        if i % 3 and i > 10:
            base = x[rng.integers(0, i)]
            x[i] = base / np.linalg.norm(base) + rng.choice([0, 0.01, 0.02, 0.035, 0.045]) * rng.standard_normal(d)
            x[i] *= rng.choice([1, 1, 2])
    return x.astype(np.float32)


def brute_links(x, cosine=0.95):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    return near


def test_recall_and_precision(spark):
    x = clusters(1)
    near = brute_links(x)
    rows = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], SCHEMA)
    out = vector_links.links(rows.repartition(5)).toPandas().set_index("vec_id").sort_index()
    got, want = out.n_links.to_numpy(), near.sum(axis=1)
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    assert (out.kept == (out.component_id == out.index)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, None), (8, []), (9, [1.0, None]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1e-30, 0.0])]
    out = {r.vec_id: r for r in vector_links.links(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)).collect()}
    assert len(out) == len(rows)
    for i in (1, 2, 3, 11, None):
        assert out[i].n_links == 4 and out[i].component_id == 1 and out[i].kept == (i == 1)
    for i in (4, 5, 6, 7, 8, 9, 10):
        assert out[i].n_links == 0 and out[i].component_id == i and out[i].kept
    assert vector_links.links(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_cells_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "SLICE", 50)
    rng = np.random.default_rng(3)
    x = (rng.standard_normal(32) + 0.03 * rng.standard_normal((400, 32))).astype(np.float32)
    near = brute_links(x)
    out = vector_links.links(spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], SCHEMA)).toPandas()
    assert out.n_links.sum() >= 0.999 * near.sum() and out.component_id.nunique() == 1


def test_calibration():
    assert vector_links.least_collisions() >= 16
    bits, count = vector_links.cuttings(10 ** 6)
    assert bits == 12 and 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** count >= 0.998


def brute_search(x, ids, queries, k):
    bits = (x[:, :64] > 0)
    out = []
    for q in queries:
        at = ids.index(q)
        d = sorted((int((bits[at] != bits[j]).sum()), ids[j]) for j in range(len(ids)) if ids[j] != q)
        out += [(q, r + 1, i, n) for r, (n, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "near", "same", "few"])
def test_search_is_exact(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 64))
    if kind == "near":
        x = x[rng.integers(0, 20, 700)] + 0.4 * x
    if kind == "same":
        x[:600] = x[0]
    if kind == "few":
        x = x[:5]
    ids = [int(i) for i in rng.permutation(len(x))]
    rows = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in zip(ids, x)], SCHEMA)
    queries = [i for i in ids if i % 100 == 0]
    got = code_search.nearest(rows, rows.filter("vec_id % 100 = 0")).collect()
    assert sorted(tuple(r) for r in got) == brute_search(x, ids, queries, 10)


def test_search_odd_vectors(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(0, [1.0] * 64, 0, 0), (1, None, 0, 0), (2, [nan] * 64, 0, 0), (3, [], 0, 0), (None, [1.0] * 64, 0, 0), (0, [1.0] * 64, 0, 0), (100, [None] * 63 + [1.0], 0, 0)], SCHEMA)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in code_search.nearest(rows, rows.filter("vec_id % 100 = 0")).collect()}
    assert got == {(0, 1): (100, 63), (0, 2): (2, 64), (0, 3): (3, 64), (100, 1): (2, 1), (100, 2): (3, 1), (100, 3): (0, 63)}
    none = spark.createDataFrame([], SCHEMA)
    assert code_search.nearest(none, none).collect() == []


def test_codes_are_as_long_as_the_vectors(spark):
    """Vectors that differ beyond their 64th component only, and vectors of other lengths, whose missing components give 0."""
    x = np.random.default_rng(8).standard_normal((150, 130)).astype(np.float32)
    x[:, :64] = 1
    length = [130 - i % 3 * 30 for i in range(150)]
    rows = spark.createDataFrame([(i, x[i, :n].tolist(), 0, 0) for i, n in enumerate(length)], SCHEMA)
    got = code_search.nearest(rows, rows.filter("vec_id < 3"), 5).collect()
    bits = np.array([(x[i] > 0) & (np.arange(130) < n) for i, n in enumerate(length)])
    want = set()
    for q in range(3):
        best = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(150) if i != q)[:5]
        want |= {(q, rank, i, d) for rank, (d, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
