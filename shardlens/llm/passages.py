"""Where texts repeat each other: the Spark side shared by operators 5 and 8.

1. The windows of every text are grouped by content (:mod:`shardlens.llm.rolling`): the anchor of a window is the
   smallest gram hash in it. Only the hashes are shuffled.
2. A window function per anchor keeps those that more than one text shows (or one text twice, where that counts).
3. Those go back to their texts by text key; each text sends the *contexts* of its shared anchors: the units of the
   windows in that group. Equal texts send theirs once. An anchor of over ``CONTEXTS`` contexts is grouped one level
   finer: each of its windows goes by its own hash, without content, and what a task finds repeated is settled there.
4. Contexts meet by anchor, sorted, and are worked on in bounded batches that end between anchors. Windows of hot
   anchors meet by hash, sorted by id; they stream past the first row of their group.
5. Marked spans go back to the texts. Both joins use one and the same shuffle of the texts, which travel compressed.

Only what has a shared anchor is moved with content, so the volume follows the repeated part of the corpus.
Texts are keyed by a 64-bit hash; anchors have 48 bits, and a chance match only makes a context travel in vain. Windows
of hot anchors are equal if their anchor and 63 bits of their hash are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm import rolling
from shardlens.llm.common import frugal, text_or_empty

LAST = (1 << 63) - 1  # documents without an id come after all others
#: Contexts worked on at once; a batch ends at the next change of anchor. An anchor that has more is hot.
CONTEXTS = 10_000
WINDOWS = 500_000  # of hot anchors, looked at together in a task


@dataclass(frozen=True)
class Rule:
    """What counts as a repeat: ``window`` consecutive units, found by anchors of ``gram`` units."""

    words: bool
    window: int
    gram: int
    within: bool  # whether a repeat inside one text counts

    def units(self, raw: bytes) -> np.ndarray:
        return rolling.word_units(raw) if self.words else rolling.byte_units(raw)


def keyed(documents: DataFrame) -> DataFrame:
    """Documents with a key of their text, an order of their ids, and the text compressed (``__z``, null if it was)."""
    rest = [c for c in documents.columns if c != "text"]
    rows = documents.select(*rest, F.col("text").cast("string").alias("text"), F.xxhash64(text_or_empty()).alias("__key"),
                            F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__doc"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("__z", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [None if (t := x.as_py()) is None else pack(t.encode()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(packed, pa.binary())], names)

    return rows.mapInArrow(frugal(run), schema)


class Unmet:
    """Whether a key is new to the task. What it remembers is bounded, so a copy may pass again; what follows merges those."""

    MOST = 200_000

    def __init__(self):
        self.met: set[int] = set()

    def __call__(self, key: int) -> bool:
        if key in self.met:
            return False
        if len(self.met) >= self.MOST:
            self.met.clear()
        self.met.add(key)
        return True


def unpacked(column: pa.Array) -> Iterator[bytes]:
    """The texts of a compressed column; null is empty."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return (b"" if (z := x.as_py()) is None else unpack(z) for x in column)


def unkeyed(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of :func:`keyed` as rows of ``documents`` again."""
    schema, names = documents.schema, documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column("__z").is_null().to_pylist()
            texts = pa.array([None if n else raw.decode() for n, raw in zip(null, unpacked(batch.column("__z")))], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in names], names)

    return rows.mapInArrow(frugal(run), schema)


def _anchor_rows(rule: Rule):
    """Anchors of a text with the number of their contexts; a copy that the task has met sends none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unmet = Unmet()
        for batch in batches:
            keys = batch.column("__key").to_numpy(zero_copy_only=False)
            hashes, again, owners, times = [], [], [], []
            for key, text in zip(keys, batch.column("text")):
                if not unmet(int(key)):
                    continue
                units = rule.units(text.as_py().encode())
                every = np.sort(rolling.anchors(units, rule.gram, rule.window)[2])
                h = rolling.distinct(every)
                hashes.append(h)
                owners.append(np.full(len(h), key))
                times.append(np.diff(np.append(np.searchsorted(every, h), len(every))).astype(np.int32))
                if rule.within:
                    again.append(rolling.repeated(units, rule.gram, h))
            if not hashes:
                continue
            columns = [pa.array(np.concatenate(x)) for x in (hashes, owners, times)]
            if rule.within:
                columns.append(pa.array(np.concatenate(again)))
            yield pa.RecordBatch.from_arrays(columns, ["hash", "__key", "times", "again"][:len(columns)])

    return run


def shared_anchors(documents: DataFrame, rule: Rule) -> DataFrame:
    """Per text key the hashes of its anchors that repeat, and which of them are hot."""
    rows = (documents.select(F.xxhash64(text_or_empty()).alias("__key"), text_or_empty().alias("text"))
            .mapInArrow(frugal(_anchor_rows(rule)), "hash long, __key long, times int" + ", again boolean" * rule.within))
    same = W.partitionBy("hash")
    repeats = (F.min("__key").over(same) != F.max("__key").over(same))
    if rule.within:
        repeats = repeats | F.col("again")
    return (rows.withColumn("repeats", repeats).withColumn("hot", F.sum("times").over(same) > CONTEXTS).filter("repeats")
            .groupBy("__key").agg(F.collect_set("hash").alias("hashes"), F.collect_set(F.expr("CASE WHEN hot THEN hash END")).alias("hot")))


COLUMNS = "hash long, __key long, __doc long, at int, more array<int>, window long, context binary"
TOP = np.uint64(1 << 63)  # set in what windows of hot anchors meet by, not in anchors


def _hot_rows(rule: Rule, key, doc, place, anchor, window) -> pa.RecordBatch:
    """Windows (in the order of texts and places) of hot anchors as rows without content: those that a task's batch
    shows to be repeated as spans, ``window`` being their negative length; and what other batches must know of, by
    the hash of the window, ``window`` being its anchor."""
    order = np.lexsort((doc, anchor, window))
    begins = np.ones(len(order), bool)
    begins[1:] = (window[order][1:] != window[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    group = np.cumsum(begins) - 1
    sure, asked = np.zeros(len(order), bool), np.zeros(len(order), bool)
    if rule.within:
        sure[order] = np.bincount(group)[group] > 1
        asked[order] = begins
    else:
        least = doc[order][begins][group]
        sure[order] = doc[order] > least
        asked = ~sure
    at = np.flatnonzero(sure)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (key[at][1:] != key[at][:-1]) | (np.diff(place[at]) != 1)
    first, last = at[new], at[np.append(new[1:], True)[:len(at)]]
    span = -(place[last] + rule.window - place[first])
    met = np.concatenate([key[first].view(np.uint64), window[asked]]) | TOP
    both = lambda x: np.concatenate([x[first], x[asked]])
    n = len(met)
    return pa.RecordBatch.from_arrays(
        [pa.array(met.view(np.int64)), pa.array(both(key)), pa.array(both(doc)), pa.array(both(place).astype(np.int32)), pa.nulls(n, pa.list_(pa.int32())),
         pa.array(np.concatenate([span, anchor[asked]])), pa.nulls(n, pa.binary())], ["hash", "__key", "__doc", "at", "more", "window", "context"])


def _known(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the hashes are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _context_rows(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unmet = Unmet()  # of rows with one text and one id
        for batch in batches:
            known, hot = batch.column("hashes"), batch.column("hot")
            ends, flat = known.offsets.to_numpy(), known.values.to_numpy()
            hot_ends, hot_flat = hot.offsets.to_numpy(), hot.values.to_numpy()
            windows: list[tuple[np.ndarray, ...]] = []
            waiting = 0
            for i, raw in enumerate(unpacked(batch.column("__z"))):
                if not unmet(batch.column("__key")[i].as_py()):
                    continue
                units = rule.units(raw)
                at, n, h = rolling.anchors(units, rule.gram, rule.window)
                use = _known(h, np.sort(flat[ends[i]:ends[i + 1]]))
                many = _known(h, np.sort(hot_flat[hot_ends[i]:hot_ends[i + 1]]))
                if many.any():
                    size = n[many]
                    place = np.repeat(at[many] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    own = [np.full(len(place), batch.column(c)[i].as_py()) for c in ("__key", "__doc")]
                    windows.append((*own, place, np.repeat(h[many], size), rolling.grams(units, rule.window)[place] | TOP))
                    waiting += len(place)
                    if waiting >= WINDOWS:
                        yield _hot_rows(rule, *map(np.concatenate, zip(*windows)))
                        windows, waiting = [], 0
                use &= ~many
                at, stop, h = at[use], (at + n)[use] + rule.window - 1, h[use]
                more = pa.nulls(len(h), pa.list_(pa.int32()))
                if rule.words:
                    words = raw.split()
                    parts = [b" ".join(words[a:b]) for a, b in zip(at.tolist(), stop.tolist())]
                else:
                    parts = [raw[a:b] for a, b in zip(at.tolist(), stop.tolist())]
                if len(rolling.distinct(h)) < len(h):  # repetitive text sends the same context once, with its places
                    once: dict[tuple[int, bytes], list[int]] = {}
                    for own, part, place in zip(h.tolist(), parts, at.tolist()):
                        once.setdefault((own, part), []).append(place)
                    h, parts, at = np.array([k[0] for k in once]), [k[1] for k in once], np.array([x[0] for x in once.values()])
                    more = pa.array([x[1:] or None for x in once.values()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(np.full(len(h), batch.column("__key")[i].as_py())),
                     pa.array(np.full(len(h), batch.column("__doc")[i].as_py())), pa.array(at.astype(np.int32)), more, pa.nulls(len(h), pa.int64()), pa.array(parts, pa.binary())],
                    ["hash", "__key", "__doc", "at", "more", "window", "context"])
            if windows:
                yield _hot_rows(rule, *map(np.concatenate, zip(*windows)))

    return run


def _spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(start << 32 | end)], ["__key", "span"])


def _by_anchor(rule: Rule, work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Batches of whole anchors from rows sorted by hash, given to ``work``; it returns the numbers of the rows it
    marks, and where in their contexts the marks start and end. Windows of hot anchors are settled as they pass."""

    def settled(rows: np.ndarray) -> np.ndarray:
        """Which of the windows (hash, window, __doc, ...; sorted) start elsewhere too."""
        begins = np.ones(rows.shape[1], bool)
        begins[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        group = np.cumsum(begins) - 1
        return np.bincount(group)[group] > 1 if rule.within else rows[2] > rows[2, begins][group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def result(table: pa.Table) -> pa.RecordBatch:
            row, start, end = work(table)
            more = table.column("more").combine_chunks().take(pa.array(row))
            other = np.repeat(np.arange(len(row)), times_more(more))
            place = np.concatenate([table.column("at").to_numpy()[row], more.flatten().to_numpy(zero_copy_only=False)]).astype(np.int64)
            row, start, end = (np.concatenate([x, x[other]]) for x in (row, start, end))
            return _spans(table.column("__key").to_numpy()[row], place + start, place + end)

        first = np.zeros((5, 0), np.int64)  # row of the last group of windows
        for batch in batches:
            hot = batch.filter(batch.column("window").is_valid())
            if hot.num_rows:
                batch = batch.filter(batch.column("window").is_null())
                known = np.array([hot.column(c).to_numpy() for c in ("hash", "window", "__doc", "__key", "at")], np.int64)
                sure = known[:, known[1] < 0]
                yield _spans(sure[3], sure[4], sure[4] - sure[1])
                asked = np.concatenate([first, known[:, known[1] >= 0]], axis=1)
                if asked.shape[1]:
                    marks = asked[:, settled(asked)]
                    yield _spans(marks[3], marks[4], marks[4] + rule.window)
                    first = asked[:, (asked[:2] == asked[:2, -1:]).all(axis=0).argmax()][:, None]
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= CONTEXTS:
                table = pa.Table.from_batches(held)
                h = table.column("hash").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
                if cut:
                    yield result(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows -= cut
        if rows:
            yield result(pa.Table.from_batches(held))

    return run


def marked(documents: DataFrame, rule: Rule, work) -> DataFrame:
    """``documents`` without ``text`` but with ``__z`` (the text compressed), ``__doc``, ``__first`` (smallest id of
    the text), ``__copies`` (rows with the text) and ``__spans`` (start << 32 | end of the spans that ``work``
    marked in it, null if none)."""
    texts = keyed(documents)  # both joins below take all its columns, so that its shuffle is one
    text_key = F.xxhash64(text_or_empty()).alias("__key")
    info = (documents.select(text_key, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__doc")).groupBy("__key")
            .agg(F.min("__doc").alias("__first"), F.count(F.lit(1)).alias("__copies")))
    wanted = shared_anchors(documents, rule).join(info.hint("shuffle_hash"), "__key")
    # (The filter is not an equality, which would become a join key and give this join a shuffle of its own.)
    contexts = (texts.join(wanted.hint("shuffle_hash"), "__key").filter("NOT (__doc > __first)")
                .mapInArrow(frugal(_context_rows(rule)), COLUMNS))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = (contexts.repartition(n, "hash").sortWithinPartitions("hash", "window", "__doc")
             .mapInArrow(frugal(_by_anchor(rule, work), CONTEXTS), "__key long, span long"))
    found = spans.groupBy("__key").agg(F.collect_list("span").alias("__spans"))
    both = info.join(found, "__key", "left")
    return texts.join(both.hint("shuffle_hash"), "__key")


def times_more(more: pa.Array) -> np.ndarray:
    """Lengths of lists, null as 0."""
    return more.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def mask_of(n: int, spans) -> np.ndarray:
    """Which of ``n`` units the spans cover."""
    edges = np.zeros(n + 1, np.int32)
    if spans is not None and len(spans):
        spans = np.asarray(spans, np.int64)
        np.add.at(edges, spans >> 32, 1)
        np.add.at(edges, np.minimum(spans & 0xFFFFFFFF, n), -1)
    return np.cumsum(edges[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]
