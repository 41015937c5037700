"""Mixing: posteriors, targets met, nonnegative rates, copies, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlens.llm import mixing


def shares(rows, column):
    total = rows.n_tokens.sum()
    return {d: (rows[column] * rows.n_tokens * rows[f"p_{d}"]).sum() / total for d in mixing.DOMAINS}


def test_targets_on_a_whole_table(spark):
    rows = mixing.op1_soft_mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert len(rows) == 1000 and (rows.rate >= 0).all()
    assert np.allclose(rows[[f"p_{d}" for d in mixing.DOMAINS]].sum(axis=1), 1)
    got = shares(rows, "rate")
    assert all(abs(got[d] - w) < 1e-4 for d, w in mixing.WEIGHTS.items())
    assert (np.abs(rows.copies - rows.rate) < 1).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    assert ((both.p_toxic > 0.5) == (both.toxic == 1)).mean() > 0.95


def test_rates_match_a_dense_solver(spark):
    """Clipped rates: the same totals as plain projected gradient in numpy."""
    rng = np.random.default_rng(4)
    t = rng.integers(1, 50, 300)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "__tokens long, __posterior array<double>")
    want = np.array([0.9, 0.099, 0.001])
    steps = mixing.fit_rates(rows, dict(zip(mixing.DOMAINS, want)))
    got = np.array([r[0] for r in rows.select(mixing.rate(F.col("__posterior"), steps)).collect()])
    r = np.ones(300)
    for _ in range(20000):
        r = np.maximum(0, r - p @ ((r * t) @ p / t.sum() - want))
    reached = lambda r: np.abs((r * t) @ p / t.sum() - want).max()
    assert (got >= 0).all() and (got == 0).any() and reached(got) <= reached(r) + 1e-4


def test_shares():
    present = np.array([0.9, 0.08, 0.02])
    assert np.allclose(mixing.shares({"good": 0.85, "poor": 0.15, "toxic": None}, present), [0.833, 0.147, 0.02])
    assert np.allclose(mixing.shares({"good": 3, "poor": 1}, present), [0.75, 0.25, 0])
    with pytest.raises(ValueError):
        mixing.shares({"toxic": None}, present)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (1, 0, 1), (None, 1, 1), (77, 1, 0), (2, None, 1)]])
def test_odd_tables(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", 5, "x"), (2, None, 5, "x"), (None, "", 5, "x"), (1, "word " * 40000, 5, "x")], "doc_id long, text string, __copy int, rate string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = mixing.with_rates(docs, labels, ["doc_id"]).collect()
    assert len(rows) == 4 and all(r.rate >= 0 and abs(sum(r["__posterior"]) - 1) < 1e-9 for r in rows)
    assert mixing.with_rates(docs.limit(0), labels, ["doc_id"]).collect() == []


def test_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed(spark, docs, sf)
    assert out.columns == docs.columns
    rows = mixing.with_rates(docs, spark.read.parquet(f"{sf}/labels.parquet"), ["doc_id"], mixing.PIPELINE_WEIGHTS)
    copies = {r.doc_id: r.copies for r in rows.collect()}
    counts = dict(out.groupBy("doc_id").count().collect())
    assert counts == {k: n for k, n in copies.items() if n}
