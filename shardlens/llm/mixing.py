"""Mixing documents to target weights by soft membership (operator 1).

1. A softmax classifier over hashed words, fitted with numpy on labelled rows, gives every document a posterior over
   domains: ``good``, ``poor`` and ``toxic``, as the table of labels defines them.
2. Every document gets a nonnegative rate: how often it should appear. With t tokens and posterior p of each
   document, the expected tokens of domain k are the sum of rate * t * p_k, and the targets are the weights' shares of
   all tokens. The rates minimise the squared distance from the targets, starting at 1, by projected gradient steps
   ``rate <- max(0, rate - p . g)``. A step needs sums over all documents only: the expected totals, whose distance
   from the targets is the gradient, and the moments of the posteriors of documents with a positive rate, which scale
   it (damped: a step that brings the totals no nearer is taken again, shorter). The state of the descent is the list of the vectors g; each document replays it.
3. ``floor(rate + u)`` copies, with ``u`` a hash of the document in [0, 1), make the expected number of copies its rate.

The fit uses at most ``FIT_ROWS`` labelled rows (smallest hashed ids); posteriors, totals and rates cover all rows.

Defined results: null and empty texts have no tokens and the classifier's prior posterior; labels without a document
or with nulls are not used, repeated ones count once (the worst); without any label every document has the even
posterior; documents without tokens do not move the fit but get a rate; an empty table gives no rows; targets that
no rates reach are met as nearly as least squares allow.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm import rolling
from shardlens.llm.common import frugal, kept, table, text_or_empty, written

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}
#: In the pipeline toxic documents are gone before: what still looks like one keeps the share it has.
PIPELINE_WEIGHTS = {"good": 0.85, "poor": 0.15, "toxic": None}
FIT_ROWS, BUCKETS = 6000, 1 << 14
STEPS, SHRINK = 200, 1e-3
PASSES, CLOSE = 80, 1e-6


def buckets(raw: bytes) -> tuple[np.ndarray, int]:
    """Buckets of the distinct words (lower case), and the number of words."""
    units = rolling.word_units(raw.lower())
    return np.unique((units >> np.uint64(50)).astype(np.int64)), len(units)


def fit_softmax(rows: list[np.ndarray], labels: np.ndarray, classes: int) -> np.ndarray:
    """Weights (BUCKETS + 1 by classes; the last row is the bias) by full-batch Adam; rows weigh 1/sqrt(size)."""
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    column = np.concatenate(rows)
    value = np.repeat([1 / np.sqrt(max(1, len(r))) for r in rows], [len(r) for r in rows])
    want = np.eye(classes)[labels]
    w = np.zeros((BUCKETS + 1, classes))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.stack([np.bincount(row, w[column, k] * value, n) for k in range(classes)], axis=1) + w[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        e = (p / p.sum(axis=1, keepdims=True) - want) / n
        g = np.stack([np.bincount(column, e[row, k] * value, BUCKETS) for k in range(classes)], axis=1)
        g = np.vstack([g, e.sum(axis=0)])
        g[:-1] += SHRINK * w[:-1] / BUCKETS
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return w


def train(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights of the domain classifier."""
    worst = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    known = worst.filter("doc_id IS NOT NULL AND toxic IS NOT NULL AND quality IS NOT NULL").select(
        "doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1).alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("mixing")), "doc_id").limit(FIT_ROWS)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [buckets(t.as_py().encode())[0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(ids, pa.list_(pa.int32()))], ["domain", "ids"])

    sample = written(documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
                     .select("domain", "text").mapInArrow(frugal(active), "domain int, ids array<int>"), "mixing-sample")
    rows = sorted(((r["domain"], r["ids"]) for r in sample.collect()))  # bounded by the sample
    if not rows:
        return np.zeros((BUCKETS + 1, len(DOMAINS)))
    return fit_softmax([np.array(ids, np.int64) for _, ids in rows], np.array([d for d, _ in rows]), len(DOMAINS))


def with_posteriors(documents: DataFrame, weights: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` of the documents with ``__tokens`` (words) and ``__posterior`` (array over DOMAINS)."""
    schema = T.StructType([*(documents.schema[c] for c in columns), T.StructField("__tokens", T.LongType()), T.StructField("__posterior", T.ArrayType(T.DoubleType()))])
    rows = documents.select(*columns, text_or_empty().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, z = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, weights.shape[1]))
            for i, text in enumerate(batch.column("__text")):
                ids, tokens[i] = buckets(text.as_py().encode())
                z[i] = weights[ids].sum(axis=0) / np.sqrt(max(1, len(ids)))
            z += weights[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(tokens), lists], [*columns, "__tokens", "__posterior"])

    return rows.mapInArrow(frugal(run), schema)


def _dot(posterior: Column, g: Column) -> Column:
    return F.aggregate(F.zip_with(posterior, g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)


def rate(posterior: Column, steps: list[np.ndarray]) -> Column:
    """The rate after these gradient steps."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    return F.aggregate(history, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - _dot(posterior, g)))


def copies(rate: Column) -> Column:
    """Whole copies whose expected number is the rate, from a hash of the document."""
    u = F.pmod(F.xxhash64("doc_id", "__tokens", F.lit("mixing")), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + u).cast("int")


def shares(weights: Mapping[str, float | None], present: np.ndarray) -> np.ndarray:
    """Target shares: domains without a weight (None) keep the share present, the others divide the rest."""
    kept_as_is = np.array([weights.get(d, 0.0) is None for d in DOMAINS])
    share = np.array([max(0.0, weights.get(d, 0.0) or 0.0) for d in DOMAINS])
    if not share.sum() > 0:
        raise ValueError("no domain has a positive weight")
    return np.where(kept_as_is, present, share / share.sum() * (1 - present[kept_as_is].sum()))


def fit_rates(rows: DataFrame, weights: Mapping[str, float | None] = WEIGHTS) -> list[np.ndarray]:
    """Gradient steps of the rates, from compact rows (__tokens, __posterior)."""
    share, pairs = None, [(i, j) for i in range(len(DOMAINS)) for j in range(i, len(DOMAINS))]
    p = [F.col("__posterior")[k] for k in range(len(DOMAINS))]
    t = F.col("__tokens")
    steps: list[np.ndarray] = []  # accepted ones
    trial, best, damping = [], np.inf, 1e-6
    for _ in range(PASSES):
        now = rows.withColumn("__rate", rate(F.col("__posterior"), trial))
        active = F.when(F.col("__rate") > 0, t).otherwise(0)
        sums = now.agg(F.sum(t).alias("all"), *[F.sum(t * F.col("__rate") * x).alias(f"e{k}") for k, x in enumerate(p)],
                       *[F.sum(active * p[i] * p[j]).alias(f"m{i}{j}") for i, j in pairs]).first()
        if not sums["all"]:
            return []
        reached = np.array([sums[f"e{k}"] for k in range(len(DOMAINS))]) / sums["all"]
        share = shares(weights, reached) if share is None else share  # the first pass has rates of 1
        off = reached - share
        if off @ off < best * (1 - 1e-9):
            steps, best, damping, gradient = trial, off @ off, max(damping / 8, 1e-9), off
            moments = np.zeros((len(DOMAINS), len(DOMAINS)))
            for i, j in pairs:
                moments[i, j] = moments[j, i] = sums[f"m{i}{j}"] / sums["all"]
        else:  # too long a step: a shorter one from the same rates
            damping = max(8 * damping, 1e-4)
        if np.sqrt(best) <= CLOSE or damping > 1e4:
            break
        trial = [*steps, np.linalg.solve(moments + damping * np.eye(len(DOMAINS)), gradient)]
    return steps


def with_rates(documents: DataFrame, labels: DataFrame, columns: list[str], weights: Mapping[str, float | None] = WEIGHTS) -> DataFrame:
    """``columns`` of all documents with tokens, posterior, rate and copies."""
    rows = kept(with_posteriors(documents, train(documents, labels), columns))
    return rows.withColumn("rate", rate(F.col("__posterior"), fit_rates(rows, weights))).withColumn("copies", copies(F.col("rate")))


def op1_soft_mixing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    rows = with_rates(documents, table(spark, sf_dir, "labels"), ["doc_id"])
    return rows.select("doc_id", F.col("__tokens").alias("n_tokens"), *[F.col("__posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document appears as often as its copies say (not at all for 0)."""
    weights = train(docs, table(spark, sf_dir, "labels"))
    steps = fit_rates(kept(with_posteriors(docs, weights, ["doc_id"])), PIPELINE_WEIGHTS)
    rows = with_posteriors(docs, weights, docs.columns)  # a second pass over the texts, so that they need not be kept
    return (rows.withColumn("__copies", copies(rate(F.col("__posterior"), steps))).filter("__copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns))
