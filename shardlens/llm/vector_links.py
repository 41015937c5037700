"""Near-duplicate vectors by collision-counting projections (operator 9).

Vectors are brought to length 1 in double precision. Two with cosine c are sqrt(2 - 2c) apart, so their values on
a random direction differ by a normal amount of known size. On each of ``PROJECTIONS`` sorted one-dimensional
projections every vector opens a window around its own value; a pair is verified, by its exact cosine, when it
shares at least as many windows as all but ``MISSED`` of the pairs at the threshold do.

Counting is done in tiles. A tile is a cell cut by the signs of a few more projections; there are as many such
cuttings as all but ``MISSED_CELLS`` of the pairs at the threshold need to fall into one cell together at least once,
and a pair is counted only in the first where it does. The number of signs follows the number of vectors, so cells
stay about ``CELL`` large. Larger cells (hot ones) are cut into slices, and pairs of slices become tiles of their
own: nothing is capped. Equal vectors are one with a weight. Link counts are summed and components joined; no pair
of vectors leaves its tile except along a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite values link with nothing (n_links 0,
own component); vectors of different lengths do not link; repeated rows are equal vectors; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlens.llm.common import frugal, kept, table
from shardlens.llm.components import components

COSINE = 0.95
PROJECTIONS, WINDOW = 32, 1.5  # half a window, in standard deviations of a pair at the threshold
MISSED, MISSED_CELLS = 1e-4, 1e-3
CELL, SLICE, BLOCK = 256, 4096, 512
SEED = 9


def directions(dimension: int, count: int, seed: int) -> np.ndarray:
    """Random unit directions (columns); a function of its arguments alone."""
    a = np.random.default_rng([seed, dimension, count]).standard_normal((dimension, count))
    return a / np.linalg.norm(a, axis=0)


def least_collisions(projections: int = PROJECTIONS, window: float = WINDOW, missed: float = MISSED) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - ``missed``."""
    p = math.erf(window / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p ** count * (1 - p) ** (projections - count)
        if below > missed:
            return count
    return projections


def cuttings(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """Signs in a cell's key, and number of cuttings."""
    bits = max(0, math.ceil(math.log2(max(1, vectors) / CELL)))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(MISSED_CELLS) / math.log(1 - together))


def unit(vectors) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def collisions(queries: np.ndarray, values: np.ndarray, half: float) -> np.ndarray:
    """For each query row and each row of ``values`` (both: one column per projection) the windows they share."""
    counts = np.zeros((len(queries), len(values)), np.int16)
    lines = np.arange(len(queries))
    for p in range(values.shape[1]):
        order = np.argsort(values[:, p], kind="stable")
        line = values[order, p]
        step = np.zeros((len(queries), len(values) + 1), np.int8)
        np.add.at(step, (lines, np.searchsorted(line, queries[:, p] - half, "left")), 1)
        np.add.at(step, (lines, np.searchsorted(line, queries[:, p] + half, "right")), -1)
        counts[:, order] += np.cumsum(step[:, :-1], axis=1, dtype=np.int16)
    return counts


def tile_links(x: np.ndarray, keys: np.ndarray, cutting: int, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (row numbers) between ``left`` and ``right`` rows that no earlier cutting puts together.
    The same rows on both sides: each pair once."""
    d = x.shape[1]
    half = WINDOW * math.sqrt((2 - 2 * cosine) / d)
    values, enough, same = x @ directions(d, PROJECTIONS, SEED), least_collisions(), left is right
    a, b = [], []
    for at in range(0, len(left), BLOCK):
        rows = left[at:at + BLOCK]
        others = right[at:] if same else right
        i, j = np.nonzero(collisions(values[rows], values[others], half) >= enough)
        i, j = rows[i], others[j]
        if same:
            i, j = i[i < j], j[i < j]
        first = ~(keys[i, :cutting] == keys[j, :cutting]).any(axis=1)
        i, j = i[first], j[first]
        near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        a.append(i[near])
        b.append(j[near])
    return np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that join two trees."""
    up = list(range(n))
    use = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            use.append(k)
    return np.array(use, np.int64)


def _tiles(cosine: float):
    """Rows (tile, node, weight, slice, low, high, cutting, keys, embedding) sorted by tile, to rows (node, links, other):
    ``links`` from this tile, and ``other`` for the pairs of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def result(t: pa.Table) -> pa.RecordBatch:
            one = t.combine_chunks().to_batches()[0]
            node, weight, part = (one.column(c).to_numpy() for c in ("node", "weight", "slice"))
            low, high, cutting = (one.column(c)[0].as_py() for c in ("low", "high", "cutting"))
            keys = _matrix(one.column("keys"))
            rows = np.arange(len(node))
            left = rows if low == high else rows[part == low]
            right = left if low == high else rows[part == high]
            a, b = tile_links(unit(_matrix(one.column("embedding"))), keys, cutting, left, right, cosine)
            links = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
            some = np.flatnonzero(links)
            use = _forest(len(node), a, b)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], node[a[use]]])),
                                               pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(use), np.int64)])),
                                               pa.array([None] * len(some) + node[b[use]].tolist(), pa.int64())], ["node", "links", "other"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            tile = held.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield result(held.slice(a, b - a))
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield result(held)

    return run


def _with_keys(bits: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            keys = np.zeros((batch.num_rows, count), np.int64)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x = unit(_matrix(batch.column("embedding").take(pa.array(rows))))
                signs = (x @ directions(d, max(1, bits * count), SEED + 1) > 0)[:, :bits * count].reshape(len(rows), count, bits)
                keys[rows] = (signs * (1 << np.arange(bits))).sum(axis=2) + (d << 32)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, count, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), batch.column("embedding"), lists], ["node", "weight", "embedding", "keys"])

    return run


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    n_tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sound = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                       & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, F.col("embedding")).alias("embedding"))
    rows = rows.withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    ids = rows.select("vec_id", "node")
    weights = ids.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"))
    classes = kept(rows.filter("node IS NOT NULL").groupBy("node").agg(F.any_value("embedding").alias("embedding"), F.count("*").alias("weight")))
    bits, count = cuttings(classes.count())
    kind = classes.schema["embedding"].dataType.simpleString()
    cells = (classes.select("node", "weight", "embedding").mapInArrow(frugal(_with_keys(bits, count)), f"node long, weight long, embedding {kind}, keys array<long>")
             .select("*", F.posexplode("keys").alias("cutting", "key")))
    sizes = (classes.select("node", "weight", "embedding").mapInArrow(frugal(_with_keys(bits, count)), f"node long, weight long, embedding {kind}, keys array<long>")
             .select(F.posexplode("keys").alias("cutting", "key")).groupBy("cutting", "key").count().filter(f"count > {SLICE}")
             .select("cutting", "key", F.ceil(F.col("count") / SLICE).cast("int").alias("slices")))
    cells = cells.join(sizes, ["cutting", "key"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    cells = cells.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("slices")).cast("int"))
    cells = cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    low, high = F.least("slice", "with"), F.greatest("slice", "with")
    cells = cells.select(F.xxhash64("cutting", "key", low, high).alias("tile"), "node", "weight", "slice", low.alias("low"), high.alias("high"), "cutting", "keys", "embedding")
    found = kept(cells.repartition(n_tasks, "tile").sortWithinPartitions("tile", "node").mapInArrow(frugal(_tiles(cosine)), "node long, links long, other long"))

    n_links = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other IS NOT NULL"), "node", "other")
    nodes = (weights.join(n_links, "node", "left").join(roots, "node", "left")
             .select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    named = ids.join(nodes, "node", "left")
    least = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    return (named.join(least, "root", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def op9_collision_counting(spark, sf_dir):
    return links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::double[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS c FROM link GROUP BY a)
SELECT vec_id, coalesce(c, 0)::bigint AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
