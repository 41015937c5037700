"""Repeated passages found by Aho-Corasick automata (operator 5).

A word goes if a window of ``LONG`` consecutive words that covers it also starts anywhere else, in another
document or further on in the same one. Contexts of shared anchors (:mod:`shardlens.llm.passages`) meet by anchor,
which makes the shards:

* recurring passages are confirmed: windows of a shard's contexts that start at two places or more, and the
  longest runs of such windows in each context;
* the shard's passages are compiled into one automaton over word numbers;
* all its contexts are streamed through the automaton, and what the passages cover is marked.

A text that several documents share recurs whole. Defined results: a null text has no words; documents under
``LONG`` words keep all; repeated rows are documents of their own (so they repeat each other); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm import rolling
from shardlens.llm.common import frugal, table
from shardlens.llm.passages import Rule, marked, mask_of, runs, times_more, unpacked

LONG, GRAM = 35, 12
RULE = Rule(words=True, window=LONG, gram=GRAM, within=True)


def recurring(contexts: list[bytes], rows: np.ndarray) -> list[np.ndarray]:
    """Per distinct context, which of its windows start at two places or more; ``rows``: places of each context.
    (The windows of two rows are never the same place: every window of a text is in one context.)"""
    windows = [rolling.grams(rolling.word_units(c), LONG) for c in contexts]
    n = [len(w) for w in windows]
    _, number = np.unique(np.concatenate(windows), return_inverse=True)
    places = np.bincount(number, np.repeat(rows, n))
    return np.split(places[number] > 1, np.cumsum(n)[:-1])


def locate(contexts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and starts and ends in their contexts, of the words that recurring passages cover."""
    import ahocorasick

    times = 1 + times_more(contexts.column("more").combine_chunks())
    numbers: dict[bytes, int] = {}
    own = np.array([numbers.setdefault(c, len(numbers)) for c in contexts.column("context").to_pylist()], np.int64)
    distinct = list(numbers)

    words: dict[bytes, int] = {}
    sequences = [tuple(words.setdefault(w, len(words)) for w in c.split()) for c in distinct]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for sequence, again in zip(sequences, recurring(distinct, np.bincount(own, times).astype(np.int64))):
        for a, b in zip(*(x.tolist() for x in runs(again))):
            automaton.add_word(sequence[a:b + LONG - 1], b + LONG - 1 - a)
    start, end = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    if len(automaton):
        automaton.make_automaton()
        for i, sequence in enumerate(sequences):
            found = [(last + 1 - size, last + 1) for last, size in automaton.iter(sequence)]
            if found:  # a context is shorter than two windows, so these overlap
                start[i], end[i] = min(found)[0], max(stop for _, stop in found)
    rows = np.flatnonzero(end[own] > 0)
    return rows, start[own[rows]], end[own[rows]]


def remove_passages(documents: DataFrame) -> DataFrame:
    """``documents`` with ``kept`` (remaining words joined by one space; null for a null text) in place of ``text``,
    ``n_words`` and ``n_removed``."""
    documents = documents.drop("kept", "n_words", "n_removed")
    rest = [f for f in documents.schema.fields if f.name != "text"]
    names = [f.name for f in rest]
    schema = T.StructType([*rest, T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    rows = marked(documents, RULE, locate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed = [], [], []
            for raw, z, copies, spans in zip(unpacked(batch.column("__z")), batch.column("__z").is_null().to_pylist(),
                                             batch.column("__copies").to_pylist(), batch.column("__spans")):
                words = raw.split()
                mask = mask_of(len(words), spans.values)
                if copies > 1 and len(words) >= LONG:
                    mask[:] = True
                kept.append(None if z else b" ".join(words[i] for i in np.flatnonzero(~mask)).decode())
                sizes.append(len(words))
                removed.append(int(mask.sum()))
            own = [pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], [*names, "kept", "n_words", "n_removed"])

    return rows.mapInArrow(frugal(run), schema)


def op5_phrase_automata(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_passages(documents).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
