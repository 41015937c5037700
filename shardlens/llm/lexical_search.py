"""Ranked lexical search by NRA, sorted reads without random access (operator 13).

Every query is ranked against every document. A document's score for a query is the sum over the query's terms
(repeats included) of ``w * ((1000000000 * tf) div (1000 * tf + 12 * m))``; ``w`` falls with the documents that hold the
term, ``m`` grows with the document's length against the mean. All but ``w``'s logarithm is 64-bit integer.

Three passes: texts become one compact row a document (length, numbers and counts of the query terms it holds); two
small aggregates over those rows give N, L and the df of the query terms; then each task cuts its rows into shards of
``SHARD`` documents, sorts the postings of a shard by impact and runs NRA on it. A query reads its lists from the top,
in steps that double. What it has read of a document is the lower end of that document's score interval; the upper end
adds, for each list it was not yet met in, the impact that list has come down to. Reading ends when no document
outside the best k can reach them, not even by a tie, and the intervals of the best k are closed. The k-th score of
earlier shards of the task is a floor that later shards must reach, so most of their lists are not read far.

A task gives k rows a query at most; a window over those gives the ranks. Queries go to the tasks in blocks of
``BLOCK`` queries and at most ``BLOCK_TERMS`` different terms, so what is broadcast has a bound whatever the number of queries.

Defined results: null and empty texts have no terms and are never returned; a query without terms, or whose terms no
document holds, has no rows; every row of the documents is a document of its own (repeated ids tie; null ids come
last); queries that repeat an id are each ranked under it; an empty table on either side gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardlens.llm.common import frugal, table, written

K = 20
SHARD = 4096
FIRST_READ = 64
BLOCK, BLOCK_TERMS = 1000, 200_000
# Bytes that stand in no term are blanks, A-Z are lower-cased, all others stay.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COMPACT = "doc_id long, n long, terms array<int>, times array<int>"
FOUND = "query int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def compact(documents: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """One row a document with a term: its length and the query terms it holds, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, terms, times = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                own = [(number[t], c) for t, c in Counter(found).items() if t in number]
                ids.append(doc_id)
                lengths.append(len(found))
                terms.append([t for t, _ in own])
                times.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(times, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "times"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(frugal(run), COMPACT)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, ids: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
    """The k best (document, score) among ``n_docs`` by sorted reads of ``lists`` (documents, impacts falling), of those
    that score ``floor`` or more (and above 0). Ties go to the smaller id."""
    lower = np.zeros(n_docs, np.int64)
    unseen = np.ones((len(lists), n_docs), bool)
    read = np.zeros(len(lists), np.int64)
    down_to = np.array([impact[0] for _, impact in lists], np.int64)
    step = FIRST_READ
    while True:
        upper = lower + down_to @ unseen  # what is unread of a list is no more than what was read last
        able = np.flatnonzero((upper >= max(floor, 1)) & (upper > 0))
        if len(able) == 0:
            return []
        order = able[np.lexsort((ids[able], -lower[able]))]
        best, rest = order[:k], order[k:]
        closed = (upper[best] == lower[best]).all()
        if closed and (len(rest) == 0 or _settled(best, rest, lower, upper, ids)):
            return [(int(d), int(lower[d])) for d in best if lower[d] >= max(floor, 1)]
        for i, (docs, impact) in enumerate(lists):
            at = read[i]
            if at < len(docs):
                to = min(len(docs), at + step)
                here = docs[at:to]
                lower[here] += impact[at:to]
                unseen[i, here] = False
                read[i], down_to[i] = to, impact[to - 1] if to < len(docs) else 0
        step *= 2


def _settled(best: np.ndarray, rest: np.ndarray, lower: np.ndarray, upper: np.ndarray, ids: np.ndarray) -> bool:
    """Whether no document of ``rest`` can come before the last of ``best``."""
    last = best[-1]
    top = int(upper[rest].max())
    if top != lower[last]:
        return top < lower[last]
    tied = rest[upper[rest] == top]
    return bool(((ids[tied] > ids[last]) | (lower[tied] == top)).all())  # closed ties are in order of their ids already


def search_rows(queries: list[dict[int, int]], weight: dict[int, int], n_all: int, l_all: int, k: int):
    """For ``mapInArrow``: rows of :data:`COMPACT` in, the best k of each query in this task out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int | None]]] = [[] for _ in queries]
        for batch in batches:
            _shard(batch, best)
        rows = [(q, doc, score) for q, found in enumerate(best) for score, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["query", "doc_id", "score"])

    def _shard(batch: pa.RecordBatch, best: list) -> None:
        n_docs, null = batch.num_rows, np.iinfo(np.int64).max
        known = batch.column(0)
        ids = np.asarray(known.fill_null(null))
        m = 100 - 25 + (25 * np.asarray(batch.column(1)) * n_all) // l_all
        doc = np.repeat(np.arange(n_docs), np.diff(np.asarray(batch.column(2).offsets)))
        term = np.asarray(batch.column(2).flatten())
        tf = np.asarray(batch.column(3).flatten()).astype(np.int64)
        part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        order = np.lexsort((-part, term))
        term, doc, part = term[order], doc[order], part[order]
        cuts = np.flatnonzero(np.diff(term)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(term)]
        where = {int(term[s]): (s, e) for s, e in zip(starts, ends) if e > s}
        for q, wanted in enumerate(queries):
            lists = []
            for t, times in wanted.items():
                if t in where and weight[t] > 0:
                    s, e = where[t]
                    lists.append((doc[s:e], part[s:e] * (weight[t] * times)))
            if not lists:
                continue
            floor = best[q][-1][0] if len(best[q]) == k else 1
            if sum(int(i[0]) for _, i in lists) < floor:
                continue
            found = [(score, int(ids[d]) if ids[d] != null else None) for d, score in nra(lists, n_docs, ids, k, floor)]
            best[q] = sorted(best[q] + found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]

    return frugal(run, SHARD)


def weights(df: dict[int, int], n_all: int, terms: range) -> dict[int, int]:
    return {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df.get(t, 0) + 1))) for t in terms}


def _blocks(items: DataFrame) -> Iterator[list]:
    """The queries in blocks of bounded size; one partition of them at a time is on the driver."""
    block, terms = [], set()
    for row in items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).toLocalIterator():
        counts = Counter(terms_of(row["text"]))
        if block and (len(block) >= BLOCK or len(terms) + len(counts) > BLOCK_TERMS):
            yield block
            block, terms = [], set()
        if counts:
            block.append((row["item_id"], counts))
            terms |= counts.keys()
    if block:
        yield block


def ranked(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``documents`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    spark = documents.sparkSession
    item_type = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for block in _blocks(items):
        number: dict[bytes, int] = {}
        queries = [{number.setdefault(t, len(number)): c for t, c in counts.items()} for _, counts in block]
        docs = written(compact(documents, number), "lexical-terms")
        totals = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not totals["n"]:
            continue
        df = {r["t"]: r["df"] for r in docs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}  # BLOCK_TERMS at most
        weight = weights(df, totals["n"], range(len(number)))
        found = docs.mapInArrow(search_rows(queries, weight, totals["n"], totals["l"], k), FOUND)
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"query int, item_id {item_type}")
        part = (found.withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(names), "query")
                .select("item_id", "rank", "doc_id", "score"))
        out = out.unionByName(part)
    return out


def op13_nra_search(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_TERMS} AS terms FROM documents),
docs AS (SELECT doc_id, row, len(terms)::bigint AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::bigint AS n_all, sum(n)::bigint AS l_all FROM docs),
tf AS (SELECT row, term, count(*)::bigint AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::bigint AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*)::bigint AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT item_id, term, times, floor(1000 * ln((2 * n_all + 2)::double / (2 * df + 1)::double))::bigint AS w FROM q JOIN df USING (term), total),
s AS (SELECT item_id, doc_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * n_all) // l_all)))))::bigint AS score
      FROM w JOIN tf USING (term) JOIN docs USING (row), total GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::integer AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""
