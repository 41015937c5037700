"""Quality rules by robust multivariate outliers (operator 12).

Each text becomes a handful of counts. Two plain rules come first: too few words, or too many of them in repeated
five-word windows. The rest is judged by how far its vector

    log of characters a word, sqrt of symbols a word, asin sqrt of repeated lines, asin sqrt of repeated words

(each share with ``EXTRA`` clean words or lines added, so that short texts do not stand out by chance) lies from the others
of its language and source: the Mahalanobis distance to the minimum-covariance-determinant estimate, the mean and covariance of the
``SHARE`` of rows that lie closest together. A row is rejected beyond the chi-square quantile ``SURE``.

The estimate is found by concentration steps over all rows, none sampled: distances to the present estimate are binned,
the bins that hold the closest ``SHARE`` of a group are summed into the next estimate. There are two starts, both
deterministic (medians with absolute deviations, spatial signs); after ``TRIED`` steps the one with the smaller
determinant goes on while it falls (by ``EASE`` of its logarithm at least). Vectors are whole numbers in units of ``1 / SCALE``, so sums are exact and do not
depend on the order of the rows. Sums and histograms are aggregated in Spark, map-side first, so a hot source costs no
more than any other; numpy only inverts the small matrix of each group. ``FLOOR`` is added to each spread: most groups have
texts without any symbol.

Rows of sources with fewer than ``LEAST`` judged rows are judged together with the other such sources of their language,
those of languages still short of that together; if there are fewer even then, only the two plain rules hold.

Defined results: null and empty texts have no words and fail; null language and null source are values of their own;
every row is judged by itself, so repeated rows and ids are kept or rejected alike; ties at the edge bin are all in; an empty table gives no
rows; only doc_id, text, lang and source are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardlens.llm.common import frugal, kept, table, written

LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
EXTRA, USUAL_CHARS = 10, 5
EXTRA_LINES = 5
FLOOR = (0.05, 0.05, 0.1, 0.1)
P = len(FLOOR)
SHARE, SURE, LEAST = 0.75, 1 - 1e-6, 50
SCALE, SIGN_SCALE, BINS = 4096, 1024, 32
TRIED, MOST_STEPS, EASE = 2, 25, 1e-3
# White space, the symbols that are counted, and the bytes that continue a character.
SPACE, SYMBOLS, CONTINUING = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(0x80, 0xC0))

FACTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


# ------------------------------------------------------------------ facts of a text

def text_facts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """(words, characters in words, symbols, repeated lines, words in repeated windows, lines with a word)."""
    words = text.split()
    lines, seen, repeated = 0, set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            repeated += line in seen
            seen.add(line)
    return (len(words), len(text.translate(None, SPACE + CONTINUING)), len(text) - len(text.translate(None, SYMBOLS)),
            repeated, repeated_words(words), lines)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words met at least twice. Windows are compared exactly."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    code = ids
    for k in range(1, WINDOW):  # the number of each window of k + 1 words
        code = np.unique(code[:-1] * n + ids[k:], return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    at = np.zeros(n + 1, np.int64)
    np.add.at(at, np.flatnonzero(twice), 1)
    np.add.at(at, np.flatnonzero(twice) + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(at)[:n]))


def facts(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_facts(t.as_py() or b"") for t in batch.column(3)], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in found.T)], FACTS.replace(",", "").split()[::2])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                            F.col("source").cast("string").alias("source"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(frugal(run), FACTS)


def vector() -> list[Column]:
    words, lines = F.col("n_words") + EXTRA, F.col("n_lines") + EXTRA_LINES
    parts = [F.log((F.col("word_chars") + EXTRA * USUAL_CHARS) / words), F.sqrt(F.col("n_symbols") / words),
             F.asin(F.sqrt(F.col("n_dup_lines") / lines)), F.asin(F.sqrt(F.col("n_repeat_words") / words))]
    return [F.round(part * SCALE).cast("long").alias(f"z{i}") for i, part in enumerate(parts)]


# ------------------------------------------------------------------ the estimate

def _chi(x: float, p: int) -> float:
    """Chi-square distribution function; p is even."""
    term, total = 1.0, 1.0
    for i in range(1, p // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(share: float, p: int = P) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi(middle, p) < share else (low, middle)
    return high


#: The closest share of a normal cloud spreads less than the whole: its covariance is enlarged by this.
WIDEN = SHARE / _chi(quantile(SHARE), P + 2)


def invert(mean: np.ndarray, spread: np.ndarray) -> tuple[list[float], list[float], float]:
    """Mean, upper triangle of the inverse, log determinant, after ``FLOOR`` is added."""
    whole = spread + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(whole)
    return mean.tolist(), [float((inverse[i, j] + inverse[j, i]) / 2) for i, j in PAIRS], float(np.linalg.slogdet(whole)[1])


STATE = "key string, start int, n long, mean array<double>, inverse array<double>, size double"


def distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of (z0, z1, …) in units of the estimate."""
    off = [F.col(f"z{i}") / SCALE - F.col(mean)[i] for i in range(P)]
    terms = [F.col(inverse)[k] * off[i] * off[j] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _middle(values: np.ndarray, times: np.ndarray) -> float:
    """The lower median of a histogram."""
    order = np.argsort(values, kind="stable")
    return values[order][np.searchsorted(2 * np.cumsum(times[order]), times.sum())]


def _middles(histogram: pd.DataFrame) -> pd.DataFrame:
    """Medians and median absolute deviations of one group, from the histograms of its components."""
    row = {"key": histogram["key"].iloc[0]}
    for i, part in histogram.groupby("i"):
        values, times = part["value"].to_numpy(), part["n"].to_numpy()
        row[f"m{i}"] = int(_middle(values, times))
        row[f"s{i}"] = int(_middle(np.abs(values - row[f"m{i}"]), times))
    return pd.DataFrame([row])


def starts(rows: DataFrame) -> DataFrame:
    """Two estimates to start from: medians with absolute deviations; medians with the covariance of spatial signs."""
    each = rows.select("key", F.posexplode(F.array(*[f"z{i}" for i in range(P)])).alias("i", "value"))
    histogram = each.groupBy("key", "i", "value").agg(F.count(F.lit(1)).alias("n"))  # whole numbers in a fixed range
    schema = "key string, " + ", ".join(f"{c}{i} long" for i in range(P) for c in "ms")
    middles = kept(histogram.groupBy("key").applyInPandas(lambda h: _middles(h)[[f.strip().split(" ")[0] for f in schema.split(",")]], schema))
    centred = rows.join(middles, "key").select("key", *[(F.col(f"z{i}") - F.col(f"m{i}")).alias(f"o{i}") for i in range(P)])
    length = F.sqrt(sum((F.col(f"o{i}").cast("double") * F.col(f"o{i}") for i in range(P)), F.lit(0.0)))
    sign = [F.when(length > 0, F.round(F.col(f"o{i}") / length * SIGN_SCALE)).otherwise(0).cast("long") for i in range(P)]
    signs = (centred.select("key", *[s.alias(f"u{i}") for i, s in enumerate(sign)]).groupBy("key")
             .agg(F.array(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i, j in PAIRS]).alias("signs")))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                mean = np.array([getattr(r, f"m{i}") for i in range(P)]) / SCALE
                wide = np.square(np.array([getattr(r, f"s{i}") for i in range(P)]) * 1.4826 / SCALE)
                shape = np.zeros((P, P))
                for (i, j), s in zip(PAIRS, r.signs):
                    shape[i, j] = shape[j, i] = s
                shape *= wide.sum() / max(np.trace(shape), 1)
                out += [(r.key, 0, 0, *invert(mean, np.diag(wide))), (r.key, 1, 0, *invert(mean, shape))]
            yield pd.DataFrame(out, columns=["key", "start", "n", "mean", "inverse", "size"])

    return middles.join(signs, "key").mapInPandas(first, STATE)


def _closest(bins: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of one group: the sums of the closest bins that hold ``SHARE`` of its rows."""
    bins = bins.sort_values("bin")
    upto = bins["n"].cumsum().to_numpy()
    edge = int(np.searchsorted(upto, math.ceil(SHARE * upto[-1])))
    n = int(upto[edge])
    sums = [int(bins[f"a{k}"].iloc[:edge + 1].sum()) for k in range(P + len(PAIRS))]
    mean = np.array(sums[:P], np.float64) / n / SCALE
    spread = np.zeros((P, P))
    for (i, j), s in zip(PAIRS, sums[P:]):
        spread[i, j] = spread[j, i] = s / n / SCALE ** 2 - mean[i] * mean[j]
    return pd.DataFrame([(bins["key"].iloc[0], bins["start"].iloc[0], n, *invert(mean, spread))], columns=["key", "start", "n", "mean", "inverse", "size"])


def concentrated(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The estimates from the rows closest to the present ones. Rows are summed by bins of their distance, map-side
    first; a group has a few hundred bins, whatever its rows."""
    bins = F.floor(F.log(distance() + 1e-12) * BINS)
    placed = rows.join(state.select("key", "start", "mean", "inverse"), "key").select("key", "start", *[f"z{i}" for i in range(P)], bins.alias("bin"))
    sums = [F.sum(f"z{i}") for i in range(P)] + [F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in PAIRS]
    summed = placed.groupBy("key", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"a{k}") for k, s in enumerate(sums)])
    return summed.groupBy("key", "start").applyInPandas(lambda b: _closest(b), STATE)


def estimates(rows: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant estimate of each ``key`` of ``rows`` (key, z0, z1, …)."""
    state = kept(starts(rows))
    for _ in range(TRIED):
        state = kept(concentrated(rows, state))
    best = F.row_number().over(W.partitionBy("key").orderBy("size", "start"))
    state = kept(state.withColumn("__i", best).filter("__i = 1").drop("__i"))
    going = state
    for _ in range(MOST_STEPS):  # a group goes on while its determinant falls
        before = state.select("key", F.col("size").alias("old"))
        going = kept(concentrated(rows, going).join(before, "key").filter(F.col("size") < F.col("old") - EASE).drop("old"))
        if going.isEmpty():
            break
        state = kept(state.join(going, "key", "left_anti").unionByName(going))
    return state


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``key`` of the group they are judged in; null if there are too few."""
    judged = rows.filter(~F.col("base_failed"))
    sizes = judged.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    name = lambda *columns: F.to_json(F.struct(*columns))
    sizes = sizes.withColumn("own", F.when(F.col("n") >= LEAST, name("lang", "source")))
    sizes = sizes.withColumn("together", F.sum(F.when(F.col("own").isNull(), F.col("n"))).over(W.partitionBy("lang")))
    sizes = kept(sizes.withColumn("own", F.coalesce("own", F.when(F.col("together") >= LEAST, name("lang")))))
    rest = sizes.filter("own IS NULL").agg(F.sum("n")).first()[0] or 0
    sizes = sizes.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"),
                         F.coalesce("own", F.lit("rest" if rest >= LEAST else None)).alias("key"))
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")) & ~F.col("base_failed")
    return rows.join(sizes, same, "left").drop("__lang", "__source")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, distance, kept) a row."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = facts(documents).select("*", failed.alias("base_failed"), *vector())
    rows = written(_keyed(written(rows, "quality-facts")), "quality-vectors")
    found = estimates(rows.filter("key IS NOT NULL").select("key", *[f"z{i}" for i in range(P)]))
    out = rows.join(found.select("key", "mean", "inverse"), "key", "left").withColumn("distance", distance() / WIDEN)
    inside = F.coalesce(F.col("distance") <= quantile(SURE), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed",
                      F.when(F.col("key").isNotNull(), F.col("distance")).alias("distance"), (~F.col("base_failed") & inside).alias("kept"))


def op12_mcd_outliers(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
