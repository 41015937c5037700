"""Phrase collocations by level-wise mining and tries dealt by hash (operator 11).

A phrase is a word sequence inside one piece of a text, counted per language. Mining is Apriori's: a phrase can only be
frequent if its parts are.

1. *Bounds.* Level by level (1 and 2 words in one pass, then 3) every task hashes the phrases of its texts whose parts may both be
   frequent, and Spark sums the hashes. A sum bounds the count of each phrase with that hash from above. The hashes
   that reach the least count become a bitmap of at most ``2 ** BITS`` bits, the filter of the next level and of step 2.
2. *Tries of the texts.* In a third and last pass a task counts the phrases that pass the bitmaps of their level, their parts
   too, in a trie of its own texts (``HELD`` words at a time): a node is its parent and one more word, so only equal phrases meet.
   Chance hits make them more than needed, never fewer. The phrases and their times are dealt by hash into shards.
3. *Tries of the shards.* A task gathers what all texts have of its shard, about ``PHRASES`` different phrases or fewer: what is known
   goes down the shard's double array (``base``, ``check``) over the words' numbers, three bytes each, and is added where it ends;
   the rest is put into it. ``TOGETHER`` bytes of paths are worked on at a time. Only these counts say what is frequent and enter the scores.

The texts are read three times, whatever their size, and no trie passes through the driver or is sent to all tasks.

A language is the first symbol of its phrases; its own node counts all words (n). Texts are cut into words without
Python strings: bytes are classed through a table, words are their buffer and offsets, equal words one number.

Score of a cut: ``floor(1000000 * a * a / (l * r))`` in exact decimals; the lowest cut counts, ties to the shorter first part.

Defined results: null and empty texts have no words; a null language is ``und``, together with rows that say so; repeated
rows count each time; empty tables give no rows; only lang and text are read, so other columns may have any name. A language without
candidates has no rows. Very long texts are cut into words one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardlens.llm.common import frugal, kept, table, written

LEVELS, AT_ONCE = 3, [(1, 2), (3, 3)]  # levels whose bounds are found in one pass: most pairs consist of frequent words anyway
LEAST, FIRST, COVERED = 10, 2000, 50
UNKNOWN = "und"
HASH = 40  # bits of a phrase's hash, below its level's number
BITS, BITS_EACH = 27, 128  # a bitmap has 128 bits for each frequent hash, and 2 ** 27 (16 MB) at most
PHRASES, TOGETHER = 1 << 17, 48 << 20  # phrases a shard, bytes of the paths that a shard's trie takes at a time
TASKS = 8  # a shard's share of the tasks that read the texts, at most
CHUNK, HELD = 2 << 20, 1 << 20  # bytes of texts cut at a time, words counted in one trie or hashes summed at a time
ROWS = 1 << 17  # of a batch
DIGITS, DIGIT = 3, 8  # a word's number is three digits of eight bits in the trie
# Bytes that end a piece, bytes that end a word; A-Z are lower-cased.
ENDS_PIECE, ENDS_WORD = b".,;:!?\n\x0b\x0c\r", b" \t"
CLASS = bytes(1 if b in ENDS_WORD else 2 if b in ENDS_PIECE else 0 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LONG_WORD = 128


# ------------------------------------------------------------------ words of a chunk of texts

class Words:
    """The words of some texts: their bytes, their piece, their text's language."""

    def __init__(self, texts: pa.LargeBinaryArray, languages: pa.StringArray):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1].copy() if len(texts) else np.zeros(1, np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        data = texts.buffers()[2].slice(first, last - first).to_pybytes() if last > first else b""
        offsets -= first
        kind = np.frombuffer(data.translate(CLASS), np.uint8)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = kind == 0
        before = np.zeros(len(data) + 1, bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (edge | ~before))
        self.lengths = np.flatnonzero(before & (edge | ~word)) - self.starts
        text = np.searchsorted(offsets, self.starts, side="right") - 1
        edge[:-1] |= kind == 2
        self.piece = np.cumsum(edge, dtype=np.int32 if len(data) < 1 << 31 else np.int64)[self.starts]
        self.data = data.translate(LOWER) + bytes(8)
        self._known = self._hashes = None
        tongues = languages.dictionary_encode()
        self.language, self.languages = np.asarray(tongues.indices).astype(np.int64)[text], tongues.dictionary.to_pylist()

    def __len__(self) -> int:
        return len(self.starts)

    def together(self, words: int) -> np.ndarray:
        """For each position, whether a phrase of so many words starts there."""
        out = np.zeros(len(self), bool)
        if len(self) >= words:
            out[: len(self) - words + 1] = self.piece[words - 1:] == self.piece[: len(self) - words + 1]
        return out

    def bytes_of(self, at: np.ndarray) -> pa.LargeBinaryArray:
        """The words at these positions."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        place = np.arange(int(ends[-1]) if len(at) else 0) + np.repeat(self.starts[at] - (ends - lengths), lengths)
        packed = np.frombuffer(self.data, np.uint8)[place]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(packed)])

    def known(self) -> pa.DictionaryArray:
        """All words, each as its number among the different ones."""
        if self._known is None:
            self._known = self.bytes_of(np.arange(len(self))).dictionary_encode()
        return self._known

    def hashes(self) -> np.ndarray:
        """A hash of each word, eight bytes at a time; of long ones, by the library."""
        if self._hashes is not None:
            return self._hashes
        blocks = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        out = self.lengths.astype(np.uint64)
        for k in range(0, LONG_WORD, 8):
            at = np.flatnonzero(self.lengths > k)
            if len(at) == 0:
                break
            left = np.minimum(self.lengths[at] - k, 8).astype(np.uint64)
            block = blocks[self.starts[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
            out[at] = _mixed(out[at], block)
        for i in np.flatnonzero(self.lengths > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i]:self.starts[i] + self.lengths[i]])
        self._hashes = out
        return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Rows (lang, text) as words, about ``CHUNK`` bytes of whole texts at a time."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK - size, side="right")))
            part = batch.slice(at, to - at)
            held.append(part)
            size += int(ends[to - 1] - (ends[at - 1] if at else 0))
            at = to
            if size >= CHUNK:
                yield _words(held)
                held, size = [], 0
    if held:
        yield _words(held)


def _words(parts: list[pa.RecordBatch]) -> Words:
    whole = pa.Table.from_batches(parts).combine_chunks()
    texts, languages = whole.column(1).chunk(0) if whole.num_rows else pa.array([], pa.large_binary()), whole.column(0)
    languages = languages.chunk(0) if whole.num_rows else pa.array([], pa.string())
    return Words(pc.cast(texts, pa.large_binary()), pc.cast(languages, pa.string()))


def texts_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


# ------------------------------------------------------------------ bounds

def _mixed(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    out = (state ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def tongues_hashed(languages: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode(), seed=1) for w in languages], np.uint64)


class Bitmap:
    """Hashes that may be frequent: a bit for each value of their leading ``width`` bits."""

    def __init__(self, width: int, bits: np.ndarray):
        self.width, self.bits = width, bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(HASH - self.width)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def frequent(words: Words, bitmaps: list[Bitmap], levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Level by level: where phrases start that pass the bitmaps there are, their parts too, and their hashes."""
    symbol = words.hashes()
    state = tongues_hashed(words.languages)[words.language] if len(words) else np.zeros(0, np.uint64)
    able = np.ones(len(words), bool)
    for k in range(1, levels + 1):
        ahead = np.zeros(len(words), np.uint64)
        ahead[: max(0, len(words) - k + 1)] = symbol[k - 1:]
        state = _mixed(state, ahead)
        if k > 1:
            able = able & np.r_[able[1:], False] & words.together(k) if len(words) else able
        if k <= len(bitmaps):
            able = able & bitmaps[k - 1].holds(state >> np.uint64(64 - HASH))
        starts = np.flatnonzero(able)
        yield starts, state[starts] >> np.uint64(64 - HASH)


def bounds(texts: DataFrame, bitmaps: list[Bitmap], levels: int) -> DataFrame:
    """(level, hash): the hashes of levels ``len(bitmaps) + 1`` to ``levels`` whose occurrences reach ``LEAST``."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)  # 2 ** BITS bits a level at most

    def summed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(found), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(found[i:i + ROWS]), pa.array(times[i:i + ROWS], pa.int64())], ["key", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for words in chunks(batches):
            for k, (_, hashes) in enumerate(frequent(words, shared.value, levels), 1):
                if k > len(shared.value):
                    held.append(hashes.astype(np.int64) | k << HASH)
            if sum(map(len, held)) >= HELD:
                yield from summed(held)
                held = []
        if held:
            yield from summed(held)

    often = texts.mapInArrow(frugal(run), "key long, times long").groupBy("key").agg(F.sum("times").alias("times")).filter(F.col("times") >= LEAST)
    return often.select(F.shiftright("key", HASH).alias("level"), F.col("key").bitwiseAND(F.lit((1 << HASH) - 1)).alias("hash"))


def bitmap_of(hashes: DataFrame) -> Bitmap:
    width = min(BITS, max(16, (hashes.count() * BITS_EACH).bit_length()))
    place = F.shiftright("hash", HASH - width) + 1  # buckets count from place 1
    parts = (hashes.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")))
    bits = np.zeros(1 << (width - 3), np.uint8)
    for r in parts.toLocalIterator():  # 4 KB a bucket, 2 ** BITS bits in all
        at = (r["bucket"] - 1) * 4096
        piece = np.frombuffer(r["bits"], np.uint8)
        bits[at:at + len(piece)] |= piece[: len(bits) - at]
    return Bitmap(width, bits)


# ------------------------------------------------------------------ tries of the texts

class TextTrie:
    """Phrases that pass the bitmaps, counted over some texts."""

    def __init__(self):
        self.languages: dict[str, int] = {}
        self.words: dict[bytes, int] = {}
        self.hashes: list[np.ndarray] = []  # of words, in the order of their numbers
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # for each position: language, word, words of the longest phrase there
        self.size = 0

    def add(self, words: Words, bitmaps: list[Bitmap]) -> None:
        depth = np.zeros(len(words), np.int8)
        for k, (starts, _) in enumerate(frequent(words, bitmaps, LEVELS), 1):
            depth[starts] = k
        known = words.known()
        indices = np.asarray(known.indices)
        hashes = np.empty(len(known.dictionary), np.uint64)
        hashes[indices] = words.hashes()
        before = len(self.words)
        own = np.array([self.words.setdefault(w, len(self.words)) for w in known.dictionary.to_pylist()], np.int32)
        fresh = own >= before  # these are numbered in the order of the dictionary
        self.hashes.append(hashes[fresh])
        tongue = np.array([self.languages.setdefault(w, len(self.languages)) for w in words.languages], np.int32)
        self.held.append((tongue[words.language], own[indices], depth))
        self.size += len(words)

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For no word, one, two, …: paths (rows of the language and words, -1 behind their end), times and hashes of the phrases.

        A node is its parent's number and a word's, so equal phrases have one node and others have others.
        """
        tongue, symbol, depth = (np.concatenate(c) for c in zip(*self.held))
        symbols = np.concatenate(self.hashes)
        paths = np.full((len(self.languages), LEVELS + 1), -1, np.int32)
        paths[:, 0] = np.arange(len(paths))
        state = tongues_hashed(list(self.languages))
        yield paths, np.bincount(tongue, minlength=len(paths)), state
        at, node = np.arange(len(symbol)), tongue.astype(np.int64)
        for k in range(1, LEVELS + 1):
            going = depth[at] >= k
            at = at[going]
            nodes, node, times = np.unique(node[going] << 32 | symbol[at + k - 1], return_inverse=True, return_counts=True)
            parent, own = nodes >> 32, nodes & 0xFFFFFFFF
            paths, state = paths[parent], _mixed(state[parent], symbols[own])
            paths[:, k] = own
            yield paths, times, state

    def dealt(self, shards: int) -> Iterator[pa.RecordBatch]:
        """One row a shard: the phrases that its hashes deal to it, with the words they need."""
        if not self.size:
            return
        paths, times, state = (np.concatenate(c) for c in zip(*self.levels()))
        paths, times, state = paths[times > 0], times[times > 0], state[times > 0]
        shard = (state % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        paths, times = paths[order], times[order]
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        words, number = pa.array(list(self.words), pa.large_binary()), np.full(len(self.words) + 1, -1, np.int32)
        for s in np.flatnonzero(np.diff(edges)):
            part = paths[edges[s]:edges[s + 1]]
            used = np.unique(part[:, 1:])
            used = used[used >= 0]
            number[used] = np.arange(len(used))  # the last place stays -1, for no word
            columns = [part[:, 0], *(number[part[:, k]] for k in range(1, LEVELS + 1)), times[edges[s]:edges[s + 1]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([list(self.languages)], pa.list_(pa.string())),
                 pa.array([_packed_columns([words.take(pa.array(used))])], pa.binary()), pa.array([_packed_columns([pa.array(c) for c in columns])], pa.binary()),
                 pa.array([len(part)], pa.int32())], SHARE.names)


SHARE = pa.schema([("shard", pa.int32()), ("languages", pa.list_(pa.string())), ("words", pa.binary()), ("phrases", pa.binary()), ("size", pa.int32())])


def _packed_columns(columns: list[pa.Array]) -> bytes:
    parts = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])
    with pa.ipc.new_stream(parts, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return parts.getvalue().to_pybytes()


def _columns(packed: bytes) -> list[pa.Array]:
    return next(iter(pa.ipc.open_stream(packed))).columns


def text_tries(texts: DataFrame, bitmaps: list[Bitmap], shards: int) -> DataFrame:
    """(shard, languages, words, phrases, size): of the tries of all tasks, what each shard gets."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TextTrie()
        for words in chunks(batches):
            trie.add(words, shared.value)
            if trie.size >= HELD:
                yield from trie.dealt(shards)
                trie = TextTrie()
        yield from trie.dealt(shards)

    return texts.mapInArrow(frugal(run), "shard int, languages array<string>, words binary, phrases binary, size int")


# ------------------------------------------------------------------ tries of the shards

class DoubleArray:
    """A trie over digits: state s goes by digit d to ``base[s] + d`` if that place has ``check`` s. State 0 is the root."""

    def __init__(self, base: np.ndarray, check: np.ndarray):
        self.base, self.check = base, check

    def step(self, states: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """Next states; -1 has none and stays."""
        to = self.base[states] + digits
        return np.where((states >= 0) & (self.check[to] == states), to, -1)

    @classmethod
    def of(cls, paths: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
        """The trie of ``paths`` (rows of digits, -1 behind their end), and the state each ends in."""
        n, depth = paths.shape
        order = np.lexsort(_sort_keys(paths)[::-1]) if n else np.zeros(0, np.int64)
        ordered = paths[order]
        # node[i, j]: number of the trie node that the first j digits of row i lead to; the root is 0
        node, parents, digits, total = np.zeros(n, np.int64), [], [], 1
        fresh = np.r_[True, np.zeros(n - 1, bool)] if n else np.zeros(0, bool)
        for j in range(depth):
            has = ordered[:, j] >= 0
            fresh = fresh | np.r_[True, ordered[1:, j] != ordered[:-1, j]] if n else fresh
            new = fresh & has
            number = total + np.cumsum(new) - 1
            parents.append(node[new])
            digits.append(ordered[new, j])
            node = np.where(has, number, node)
            total += int(new.sum())
        parent, digit = np.concatenate([[-1], *parents]).astype(np.int64), np.concatenate([[0], *digits]).astype(np.int64)
        place, base = _packed(parent, digit, total)
        out_base, out_check = np.zeros(base[1], np.int32), np.full(base[1], -2, np.int32)
        out_base[place] = base[0]
        out_check[place[1:]] = place[parent[1:]]
        ends = np.empty(n, np.int64)
        ends[order] = place[node]
        return cls(out_base, out_check), ends


def _sort_keys(paths: np.ndarray) -> list[np.ndarray]:
    """Columns that order rows of digits as these do, several digits in each."""
    width, each = DIGIT + 1, 63 // (DIGIT + 1)
    keys = []
    for j in range(0, paths.shape[1], each):
        key = np.zeros(len(paths), np.int64)
        for digits in paths[:, j:j + each].T:
            key = key << width | (digits.astype(np.int64) + 1)
        keys.append(key)
    return keys


def _packed(parent: np.ndarray, digit: np.ndarray, total: int) -> tuple[np.ndarray, tuple[np.ndarray, int]]:
    """Places for all nodes of a trie: the children of a node stand at its base plus their digits, none twice.

    Nodes with many children get a stretch of their own; the others, larger ones first, are thrown at random until they
    fit, all at once: in each round those that meet nothing stay.
    """
    span = 1 << DIGIT
    children = np.argsort(parent[1:], kind="stable") + 1  # by parent
    count = np.bincount(parent[1:], minlength=total)
    first = np.r_[0, np.cumsum(count)[:-1]]
    place, base = np.zeros(total, np.int64), np.zeros(total, np.int64)
    wide = np.flatnonzero(count > span // 8)
    size = 1 + span * (len(wide) + 2) + 2 * total
    rows = np.repeat(np.arange(len(wide)), count[wide])
    base[wide] = 1 + span * np.arange(len(wide))
    taken = np.zeros(size, bool)
    taken[0] = True
    if len(wide):
        own = children[np.repeat(first[wide], count[wide]) + _within(count[wide])]
        place[own] = base[wide][rows] + digit[own]
        taken[place[own]] = True
    rng = np.random.default_rng(0)
    holder = np.empty(len(taken), np.int32)
    for most, least in ((span // 8, 9), (8, 4), (3, 2), (1, 1)):
        waiting = np.flatnonzero((count <= most) & (count >= least))
        tries = 0
        while len(waiting):
            own = children[np.repeat(first[waiting], count[waiting]) + _within(count[waiting])]
            whose = np.repeat(np.arange(len(waiting)), count[waiting])
            thrown = rng.integers(1, len(taken) - span, len(waiting))
            at = thrown[whose] + digit[own]
            meets = taken[at]
            holder[at] = whose
            meets |= holder[at] != whose
            free = np.ones(len(waiting), bool)
            free[whose[meets]] = False
            base[waiting[free]] = thrown[free]
            place[own[free[whose]]] = at[free[whose]]
            taken[at[free[whose]]] = True
            waiting = waiting[~free]
            tries += 1
            if tries % 30 == 0:  # too full
                taken = np.r_[taken, np.zeros(len(taken) // 4 + span, bool)]
                holder = np.empty(len(taken), np.int32)
    return place, (base, len(taken) + span)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, … for each group of the given sizes, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def digits_of(numbers: np.ndarray) -> list[np.ndarray]:
    return [(numbers >> (DIGIT * i)) & ((1 << DIGIT) - 1) for i in reversed(range(DIGITS))]


class Trie:
    """Phrases of one shard as rows of digits, and their times; ``entry`` has the row that ends in a state, or -1."""

    def __init__(self):
        self.paths, self.times = np.zeros((0, DIGITS * (LEVELS + 1)), np.int16), np.zeros(0, np.int64)
        self.array, _ = DoubleArray.of(self.paths)
        self.entry = np.full(len(self.array.base), -1, np.int64)

    def walk(self, paths: np.ndarray) -> np.ndarray:
        """The row of each path, or -1."""
        states = np.zeros(len(paths), np.int64)
        for digits in paths.T:
            states = np.where(digits < 0, states, self.array.step(states, np.maximum(digits, 0)))
        return np.where(states >= 0, self.entry[states], -1)

    def add(self, paths: np.ndarray, times: np.ndarray) -> None:
        """Known phrases are counted where they end; with the others the trie is built anew."""
        at = self.walk(paths) if len(self.paths) else np.full(len(paths), -1, np.int64)
        met = at >= 0
        np.add.at(self.times, at[met], times[met])
        if met.all():
            return
        paths, times = np.concatenate([self.paths, paths[~met]]), np.concatenate([self.times, times[~met]])
        self.array, ends = DoubleArray.of(paths)
        row, sums = np.full(len(self.array.base), -1, np.int64), np.zeros(len(self.array.base), np.int64)
        row[ends] = np.arange(len(ends))
        np.add.at(sums, ends, times)
        states = np.flatnonzero(row >= 0)
        self.paths, self.times = paths[row[states]], sums[states]
        self.entry = row
        self.entry[states] = np.arange(len(states))


def passes(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Parts of a shard, by (number, bytes), counted together: no more than ``TOGETHER`` bytes, or one."""
    groups, room = [], 0
    for number, size in sizes:
        if size > room:
            groups.append([])
            room = TOGETHER
        groups[-1].append(number)
        room -= size
    return groups


def shard_counts(batch: pa.Table) -> pa.Table:
    """(lang, words, phrase, n) of a shard: the languages, and the phrases that its trie counts ``LEAST`` times."""
    languages: dict[str, int] = {}
    words: dict[bytes, int] = {}
    trie = Trie()
    wide = DIGITS * (LEVELS + 1) * 16  # a path, its keys and its nodes while the trie is built
    for group in passes([(i, n * wide) for i, n in enumerate(batch.column("size").to_pylist())]):
        paths, times = [], []
        for i in group:
            row = batch.slice(i, 1)
            tongue = np.array([languages.setdefault(w, len(languages)) for w in row.column("languages")[0].as_py()], np.int64)
            own = np.array([words.setdefault(w, len(words)) for w in _columns(row.column("words")[0].as_py())[0].to_pylist()] + [-1], np.int64)
            lang, *numbers, n = (np.asarray(c) for c in _columns(row.column("phrases")[0].as_py()))
            columns = digits_of(tongue[lang])
            for number in numbers:
                columns += [np.where(number < 0, -1, d) for d in digits_of(own[number])]
            paths.append(np.stack(columns, axis=1).astype(np.int16))
            times.append(n)
        trie.add(np.concatenate(paths), np.concatenate(times))
    often = (trie.times >= LEAST) | (trie.paths[:, DIGITS] < 0)
    paths, times = trie.paths[often].astype(np.int64), trie.times[often]
    lang, *numbers = (sum(paths[:, DIGITS * k + i] << DIGIT * (DIGITS - 1 - i) for i in range(DIGITS)) for k in range(LEVELS + 1))
    texts = pc.cast(pa.array(list(words), pa.large_binary()), pa.large_string())
    parts = [texts.take(pa.array(number, mask=number < 0)) for number in numbers]
    parts[0] = pc.fill_null(parts[0], "")  # no word
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()), null_handling="skip")
    level = sum((number >= 0).astype(np.int32) for number in numbers)
    return pa.Table.from_arrays([pa.array(list(languages), pa.string()).take(pa.array(lang)), pa.array(level, pa.int32()), pc.cast(phrase, pa.string()), pa.array(times, pa.int64())],
                                ["lang", "words", "phrase", "n"])


def candidates(texts: DataFrame, bitmaps: list[Bitmap]) -> DataFrame:
    """(lang, words, phrase, n): every phrase that the tries count ``LEAST`` times, and each language as the phrase of no words."""
    shards = max(1, sum(int(np.bitwise_count(b.bits).sum()) for b in bitmaps) // PHRASES,
                 texts.rdd.getNumPartitions() // TASKS)  # many texts with few different phrases are many shares
    dealt = text_tries(texts, bitmaps, shards).repartitionById(shards, F.col("shard"))  # by hash some tasks would get several
    return dealt.groupBy("shard").applyInArrow(shard_counts, "lang string, words int, phrase string, n long")


# ------------------------------------------------------------------ scores

def collocations(documents: DataFrame, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` best phrases of each language of ``documents`` (lang, text)."""
    spark = documents.sparkSession
    texts = texts_of(documents)
    bitmaps: list[Bitmap] = []
    for first_level, last in AT_ONCE:
        passed = kept(bounds(texts, bitmaps, last))
        bitmaps += [bitmap_of(passed.filter(F.col("level") == k)) for k in range(first_level, last + 1)]
    if not bitmaps[0].bits.any():
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    known = written(candidates(texts, bitmaps), "phrase-counts")
    total = known.filter("words = 0").select("lang", F.col("n").alias("all"))
    often = known.filter((F.col("words") > 0) & (F.col("n") >= LEAST))
    phrases = often.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), " ").alias("head"), F.array_join(F.slice(parts, k + 1, F.col("words") - k), " ").alias("rest")))
    cut = phrases.select("*", F.explode(cuts).alias("cut")).select("lang", "words", "phrase", "a", "cut.*")
    head, rest = (often.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)) for side, name in (("head", "l"), ("rest", "r")))
    cut = cut.join(head, ["lang", "head"]).join(rest, ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    share = cut.withColumn("up", (exact("a") * exact("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("down", exact("l") * exact("r"))
    share = share.withColumn("score", F.expr("up div down"))
    lowest = (share.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"), F.first("a").alias("a"), F.first("words").alias("words")))
    inner = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda i: F.array_join(F.slice(parts, i, F.lit(2)), " "))
    longer = (phrases.filter("words = 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    left = lowest.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("a")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = left.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn("rank", rank).filter(F.col("rank") <= first)
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all").alias("n"), "score")


def op11_trie_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


_PIECES = r"""string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"""
ORACLE_SQL = f"""
WITH p AS (SELECT lang, row_number() OVER () AS id, piece FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest({_PIECES}) AS piece FROM documents)),
w AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT lang, id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p)),
g AS (SELECT lang, w, w || ' ' || lead(w) OVER o AS ww, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS www FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, words, phrase, count(*)::bigint AS n FROM (SELECT lang, 1 AS words, w AS phrase FROM g UNION ALL SELECT lang, 2, ww FROM g UNION ALL SELECT lang, 3, www FROM g)
      WHERE phrase IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, sum(n)::bigint AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= {LEAST}),
cut AS (SELECT lang, phrase, words, a, unnest(range(1, words)) AS k, w FROM c),
heads AS MATERIALIZED (SELECT cut.*, f.n AS l FROM cut JOIN f ON f.lang = cut.lang AND f.phrase = array_to_string(cut.w[1:k], ' ')),
scored AS (SELECT h.*, f.n AS r, ((1000000 * a::hugeint * a) // (l::hugeint * f.n))::bigint AS score
           FROM heads h JOIN f ON f.lang = h.lang AND f.phrase = array_to_string(h.w[k + 1:], ' ')),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(w[i:i + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE words = 3)) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer g USING (lang, phrase) WHERE g.a IS NULL OR 100 * g.a < {COVERED} * low.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::integer AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r.r, total.n, score FROM r JOIN total USING (lang) WHERE rank <= {FIRST}
"""
