"""PU toxicity: held-out accuracy, folds, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlens.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = toxicity.op4_nnpu_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    out = rows.join(labels, "doc_id", "left").toPandas()
    assert len(out) == 10000 and out.score.between(0, 1).all()
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()
    held = out[out.held_out & out.toxic.notna()]
    hit = (held.predicted == 1) & (held.toxic == 1)
    assert hit.sum() / (held.toxic == 1).sum() > 0.9
    assert hit.sum() / (held.predicted == 1).sum() > 0.9


def test_labels_of_the_held_out_fold_change_nothing(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    l = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = l.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(d, l), toxicity.train(d, turned)
    assert a.weights == b.weights and a.bias == b.bias


def test_learns_words_only_positives_have():
    rng = np.random.default_rng(0)
    positive = [np.array([0]) if i % 2 else np.array([1, 2]) for i in range(200)]
    unlabelled = [np.array([0]) if i < 20 else np.array([1, 2]) if i < 40 else rng.choice([2, 3], 1) for i in range(400)]
    w, b = toxicity.fit_pu(positive, unlabelled, 4, 0.1)
    assert w[0] + b > 0 and w[1] + w[2] + b > 0 and w[3] + b < 0 and w[2] + b < 0 and b < 0


@pytest.mark.parametrize("label_rows", [[], [(1, 0)], [(None, 1), (99, 1), (2, None)]])
def test_odd_tables(spark, label_rows):
    d = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (2, "", "x"), (None, "word " * 50000, "x")], "doc_id long, text string, score string")
    l = spark.createDataFrame(label_rows, "doc_id long, toxic int")
    model = toxicity.train(d, l)
    got = toxicity.scored(d, model, "s").collect()
    assert len(got) == 4 and all(0 <= r.s < 0.5 for r in got)
    assert toxicity.train(d.limit(0), l).score("a") == 0.0
