"""Toxicity by non-negative positive-unlabelled learning (operator 4).

Confirmed toxic rows are the positives; everything else, labelled or not, is unlabelled. A linear model over
words and word beginnings, each present, repeated or dense, is fitted with numpy on the class-prior-corrected risk

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])

with the logistic loss; while the corrected second term is negative it is held at 0 and only the first one is
followed (by the weights; the bias moves with the whole risk alone). The prior is the share of toxic rows among all labelled rows of the fit fold.

Bounds, all parameters: the fit uses at most ``POSITIVES`` and ``UNLABELLED`` rows (those whose hashed id is
smallest) and at most ``FEATURES`` features: those clearly commoner among positives (``LEAST_Z``) and, by the
prior, toxic in at least ``LEAST_SHARE`` of the rows that show them. Scoring reads every whole text. Rows whose crc32(doc_id) mod 5 is 0
are held out of the fit; only texts are inputs of a score.

Defined results: null and empty texts have no features and score the bias; without any positive or any
unlabelled row every score is 0; labels without a document, null labels and repeated labels do no harm (a
document is toxic if any label says so); rows without an id count as held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm.common import Recent, frugal, table, text_or_empty, written

FOLDS = 5
POSITIVES, UNLABELLED = 4000, 8000
FEATURES, LEAST_Z, LEAST_ROWS, LEAST_SHARE = 4096, 4.0, 4, 0.5
STEPS, RATE, SHRINK = 400, 0.1, 1e-4
BEGINNINGS = (4, 5, 6)
REPEATED, DENSE = 2, 0.006
CACHED_WORDS = 60_000
words = re.compile(r"\w+").findall


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def features(word: str) -> list[str]:
    """The word itself (marked by a trailing blank) and its beginnings."""
    return [word + " ", *(word[:n] for n in BEGINNINGS if len(word) > n)]


def levels(feature: str, count: int, n_words: int) -> list[str]:
    """What a feature that occurs ``count`` times among ``n_words`` words says: present, repeated, dense, both."""
    out = [feature]
    if count >= REPEATED:
        out.append(feature + "\t2")
    if count >= DENSE * n_words:
        out += [feature + "\td", feature + "\t2d"] if count >= REPEATED else [feature + "\td"]
    return out


def text_features(text: str) -> set[str]:
    found = words(text.lower())
    counts = Counter()
    for word, n in Counter(found).items():
        for f in features(word):
            counts[f] += n
    return {x for f, n in counts.items() for x in levels(f, n, len(found))}


class Model:
    """Weights of features; a score is the sigmoid of the bias plus the weights a text shows."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known = {f.partition("\t")[0] for f in weights}
        self.seen = Recent(lambda word: tuple(f for f in features(word) if f in self.known), CACHED_WORDS)

    def score(self, text: str) -> float:
        seen, counts, found = self.seen, {}, words(text.lower())
        for word, n in Counter(found).items():
            for f in seen[word]:
                counts[f] = counts.get(f, 0) + n
        shown = sorted(x for f, n in counts.items() for x in levels(f, n, len(found)))
        z = self.bias + math.fsum(self.weights.get(x, 0.0) for x in shown)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative PU risk. Rows are arrays of feature numbers."""
    rows = [*positive, *unlabelled]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    is_p = np.arange(len(rows)) < len(positive)
    n_p, n_u = len(positive), len(unlabelled)
    w = np.zeros(n_features + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        f = np.bincount(row, w[column], len(rows)) + w[-1]
        up = 1 / (1 + np.exp(-np.clip(f, -60, 60)))  # derivative of l(-f); that of l(f) is up - 1
        loss = np.logaddexp(0, f)
        corrected = loss[~is_p].mean() - prior * loss[is_p].mean()
        slope = np.where(is_p, prior * (up - 1) / n_p, 0.0)
        negative = np.where(is_p, -prior * up / n_p, up / n_u)
        slope = slope + negative if corrected >= 0 else slope
        g = np.append(np.bincount(column, slope[row], n_features), slope.sum() if corrected >= 0 else 0.0)
        g[:-1] += SHRINK * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the fold that is not held out."""
    fit = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = fit.agg(F.count("toxic").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    if not known["p"]:
        return Model({}, -math.inf)
    rank = F.xxhash64("doc_id", F.lit("toxicity"))
    toxic = fit.filter("toxic = 1").orderBy(rank, "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    pool = documents.select("doc_id").filter(~held_out(F.col("doc_id")))
    anyone = pool.orderBy(rank, "doc_id").limit(UNLABELLED).distinct().select("doc_id", F.lit(False).alias("positive"))
    chosen = toxic.unionByName(anyone)  # at most POSITIVES + UNLABELLED ids
    sample = written(documents.select("doc_id", text_or_empty().alias("text"))
                     .join(F.broadcast(chosen), "doc_id").select("positive", "text"), "toxicity-sample")
    sizes = dict(sample.groupBy("positive").count().collect())
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Model({}, -math.inf)
    prior = known["p"] / known["n"]

    p, u = F.col("p") / n_p, F.col("u") / n_u
    spread = F.sqrt(F.greatest(u * (1 - u), F.lit(1 / n_u)) * (1 / n_p + 1 / n_u))
    counts = (sample.mapInArrow(frugal(_count_features), "feature string, p long, u long")
              .groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
              .withColumn("z", (p - u) / spread).filter(f"z >= {LEAST_Z} AND p >= {LEAST_ROWS}").filter(prior * p >= LEAST_SHARE * u))
    names = [r["feature"] for r in counts.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]
    if not names:
        return Model({}, math.log(prior / (1 - prior)) if prior < 1 else math.inf)
    number = {f: i for i, f in enumerate(names)}

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [sorted(number[f] for f in text_features(t.as_py()) if f in number) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array(ids, pa.list_(pa.int32()))], ["positive", "ids"])

    shown = sample.mapInArrow(frugal(active), "positive boolean, ids array<int>").collect()  # bounded by the sample
    shown.sort(key=lambda r: (not r["positive"], r["ids"]))
    rows = {k: [np.array(r["ids"], np.int64) for r in shown if r["positive"] == k] for k in (True, False)}
    weights, bias = fit_pu(rows[True], rows[False], len(names), prior)
    return Model({f: float(w) for f, w in zip(names, weights)}, bias)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p, u = Counter(), Counter()
        for positive, text in zip(b.column("positive").to_pylist(), b.column("text")):
            (p if positive else u).update(text_features(text.as_py()))
        names = list(p.keys() | u.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[f] for f in names], pa.int64()),
                                          pa.array([u[f] for f in names], pa.int64())], ["feature", "p", "u"])


def scored(documents: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``documents`` with the scores, from 0 to 1, of their whole texts; a column of that name is replaced."""
    documents = documents.drop(score) if score != "text" else documents
    weights, bias = model.weights, model.bias
    schema = T.StructType([*documents.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, bias)
        for b in batches:
            found = [own.score(t or "") for t in b.column("text").cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, score])

    return documents.mapInArrow(frugal(run), schema)


def op4_nnpu_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels)
    rows = scored(documents.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return (rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def without_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go, the rest stay as they are."""
    model = train(docs, table(spark, sf_dir, "labels"))
    name = "__score"
    while name in docs.columns:
        name += "_"
    return scored(docs, model, name).filter(F.col(name) < 0.5).drop(name)
