"""Substring deduplication with a run-length index (operator 8).

A byte goes if a string of ``LONG`` bytes that covers it also starts in a document with a smaller id. Contexts of
shared anchors (:mod:`shardlens.llm.passages`) are worked on in bounded batches:

* equal contexts are one; all but the document with the smallest id match it whole;
* of different contexts that may match, a Burrows-Wheeler transform is built and kept run by run.
  Sampled with the run ends, and with the ends of classes of suffixes that agree on ``LONG`` bytes, is the
  smallest document of the class;
* each context is streamed backwards through the runs. The matching statistics at a byte, i.e. whether ``LONG``
  bytes from it on occur in a smaller document, are read off the sample at the place reached.

Defined results: a null text has no bytes; texts under ``LONG`` bytes keep all; documents without an id come
after all others and, like rows with the same id, take nothing from each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm import rolling
from shardlens.llm.common import frugal, give_back, table
from shardlens.llm.passages import Rule, marked, mask_of, runs, unpacked

LONG, GRAM = 50, 16
RULE = Rule(words=False, window=LONG, gram=GRAM, within=False)
WIDTH = 2 * LONG - GRAM  # bytes of a context at most


class RunLengthIndex:
    """Run-length BWT of strings (rows of ``codes``, padded by 0; byte + 1 otherwise), one document each."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, documents: np.ndarray, long: int = LONG):
        n, width = codes.shape
        symbols, dense = np.unique(codes, return_inverse=True)  # 0 is there: rows end by it
        codes = dense.reshape(n, width)
        base = len(symbols)
        per_word = min(long, int(62 / np.log2(base + 1)))
        key = np.zeros((n, width), np.int64)
        for d in range(per_word):
            key = key * base + _ahead(codes, d)
        ranks = [(per_word, _dense(key))]
        while (step := ranks[-1][0]) < width:
            last = ranks[-1][1]
            ranks.append((2 * step, _dense(last * (last.max() + 2) + _ahead(last + 1, step))))
        inside = np.arange(width) <= sizes[:, None]
        flat = np.flatnonzero(inside)
        order = flat[np.argsort(ranks[-1][1].ravel()[flat], kind="stable")]  # equal suffixes by string number
        row, column = order // width, order % width

        self.size, self.base, self.symbols = len(order), base, symbols
        last = np.where(column > 0, codes.ravel()[order - 1], 0)
        begins = np.concatenate([[True], last[1:] != last[:-1]])
        change = np.flatnonzero(begins)
        self.run_of = np.cumsum(begins, dtype=np.int32) - 1  # rank over the bits that mark run starts
        self.run_start, self.run_symbol = change, last[change]
        length = np.diff(np.append(change, self.size))
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        self.run_key = self.run_symbol[by_symbol] * len(change) + by_symbol
        self.run_nth = np.empty(len(change), np.int64)
        self.run_nth[by_symbol] = np.arange(len(change))
        self.before = np.concatenate([[0], np.cumsum(length[by_symbol])])
        self.first = np.searchsorted(codes.ravel()[order], np.arange(base))  # suffixes with a smaller first symbol
        self.symbol_runs = np.searchsorted(self.run_symbol[by_symbol], np.arange(base))

        step, near = max((r for r in ranks if r[0] <= long), key=lambda r: r[0])
        same = np.ones(self.size - 1, bool)
        for d in range(0, long, step):
            shifted = _ahead(near, min(d, long - step)).ravel()[order]
            same &= shifted[1:] == shifted[:-1]
        whole = sizes[row] - column >= long
        same &= whole[1:] & whole[:-1]
        classes = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(documents[row], classes)
        begins[classes] = True  # samples stand where a run or a class begins
        self.sample_of = np.cumsum(begins, dtype=np.int32) - 1
        self.sample = least[np.searchsorted(classes, np.flatnonzero(begins), "right") - 1]

    def back(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Backward step: where the suffixes that start with ``symbol`` and go on as those at ``place`` begin."""
        run = self.run_of[place]
        same = self.run_symbol[run] == symbol
        nth = self.run_nth[run]
        other = ~same
        nth[other] = np.searchsorted(self.run_key, symbol[other] * len(self.run_start) + run[other])
        rank = self.before[nth] - self.before[self.symbol_runs[symbol]]
        rank += np.where(same, place - self.run_start[run], 0)
        return self.first[symbol] + rank

    def repeats(self, codes: np.ndarray, sizes: np.ndarray, documents: np.ndarray, long: int = LONG) -> np.ndarray:
        """For each string of the index and each of its places: whether ``long`` units from there on occur in a
        string of a smaller document."""
        codes = np.searchsorted(self.symbols, codes)
        out = np.zeros(codes.shape, bool)
        rows, place = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for k in range(codes.shape[1] - 1):
            on = sizes > k
            rows, place, sizes, documents = rows[on], place[on], sizes[on], documents[on]
            if not len(rows):
                break
            column = sizes - 1 - k
            place = self.back(place, codes[rows, column])
            if k + 1 >= long:
                out[rows, column] = self.sample[self.sample_of[place]] < documents
        return out


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """Columns moved left, 0 coming in."""
    if by == 0:
        return x
    out = np.zeros_like(x)
    if by < x.shape[1]:
        out[:, :-by] = x[:, by:]
    return out


def _dense(key: np.ndarray) -> np.ndarray:
    values, rank = np.unique(key.ravel(), return_inverse=True)
    return rank.reshape(key.shape).astype(np.int64, copy=False)


def match(contexts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and starts and ends in their contexts, of what a smaller document has too."""
    doc = contexts.column("__doc").to_numpy()
    column = contexts.column("context").combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data, size = np.frombuffer(column.buffers()[2], np.uint8), np.diff(offsets)
    codes = np.zeros((len(column), WIDTH + 1), np.uint16)
    rows = np.repeat(np.arange(len(column)), size)
    codes[rows, np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], size)] = data[offsets[0]:offsets[-1]].astype(np.uint16) + 1

    _, one, own = np.unique(codes.view(f"V{codes.itemsize * codes.shape[1]}").ravel(), return_index=True, return_inverse=True)
    first = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(first, own, doc)
    start = np.zeros(len(doc), np.int64)
    end = np.where((doc > first[own]) & (size >= LONG), size, 0)

    # A context none of whose windows has the hash of a window of another context matches none: not indexed.
    distinct = codes[one]
    h = rolling.grams(distinct.ravel().astype(np.uint64), LONG)
    h = np.append(h, np.zeros(LONG - 1, np.uint64)).reshape(distinct.shape)
    whole = np.arange(distinct.shape[1]) + LONG <= size[one][:, None]
    _, number, n = np.unique(h[whole], return_inverse=True, return_counts=True)
    index = np.unique(np.nonzero(whole)[0][n[number] > 1])
    if len(index):
        strings, sizes, documents = codes[one[index]], size[one[index]], first[index]
        hit = RunLengthIndex(strings, sizes, documents).repeats(strings, sizes, documents)
        some = hit.any(axis=1)
        low, high = hit.argmax(axis=1), hit.shape[1] - 1 - hit[:, ::-1].argmax(axis=1)
        slot = np.full(len(one), -1)
        slot[index] = np.arange(len(index))
        mine = slot[own]
        use = (end == 0) & (mine >= 0)
        use[use] = some[mine[use]]
        start[use], end[use] = low[mine[use]], high[mine[use]] + LONG
    rows = np.flatnonzero(end > start)
    return rows, start[rows], end[rows]


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with ``kept`` (remaining bytes; null for a null text) in place of ``text``, ``n_bytes`` and
    ``spans`` (removed runs as start, end)."""
    documents = documents.drop("kept", "n_bytes", "spans")
    rest = [f for f in documents.schema.fields if f.name != "text"]
    names = [f.name for f in rest]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*rest, T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span))])
    rows = marked(documents, RULE, match)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, spans = [], [], []
            for raw, z, doc, first, found in zip(unpacked(batch.column("__z")), batch.column("__z").is_null().to_pylist(),
                                                 *(batch.column(c).to_pylist() for c in ("__doc", "__first")), batch.column("__spans")):
                mask = mask_of(len(raw), found.values)
                if doc > first and len(raw) >= LONG:  # a copy of a document with a smaller id
                    mask[:] = True
                kept.append(None if z else np.frombuffer(raw, np.uint8)[~mask].tobytes())
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in runs(mask)))])
            own = [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()),
                   pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], [*names, "kept", "n_bytes", "spans"])

    return rows.mapInArrow(frugal(run), schema)


def op8_run_length_dedup(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(documents).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                                            F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def without_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose what a document with a smaller id has too; a document left without text goes.
    A cut inside a character takes the whole character."""

    @F.pandas_udf("string")
    def readable(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for raw in batches:
                yield raw.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")
        finally:
            give_back()

    kept = remove_repeats(docs).filter("size(spans) = 0 OR octet_length(kept) > 0")
    kept = kept.withColumn("text", readable("kept"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
