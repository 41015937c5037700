"""Exact n-gram Jaccard join (operator 10).

A document's set holds the hashes of its distinct 5-word shingles (of the whole sequence if it has fewer words).
Two documents link when ``100 * |A and B| >= 75 * |A or B|``. Sets are kept sorted by one global order: shingles
that a fixed-size count over all documents shows to be common come last, the rest by hash. Linked sets of sizes m
and n then share one of the first ``n - ceil(3n/4) + 1`` shingles of each (their prefixes), so a tile is what has
one prefix shingle in common, sorted by size; only sizes within 3/4 of each other are compared.

* A pair of a tile within the size band counts one shared prefix shingle, unless the prefix that ends first has too
  many shingles that no other text has. It is a candidate if it shares so many of that prefix that the rest, which
  can't be shared, still allows a link.
* Candidates are bounded from above by hashed bitmaps, |A and B| <= |A| - bits of A that B lacks, and what passes is
  settled by exact intersection of the sorted arrays. In tiles of more than ``SMALL_TILE`` rows each row brings a bitmap,
  so that the many pairs of a large tile that can't link are never sent.
* A first pass tries for each text of a tile only the nearest and the farthest candidate in size, and the first by an
  order that all tiles share; that joins groups of near copies without all their pairs. The second pass tries every candidate pair between different components. No
  tile is cut short, so no link that matters to the components is lost.

Texts are keyed by a 64-bit hash, so equal texts are one; shingle hashes have 64 bits. Components come from links
between texts, by rounds of joins. Defined results: null, empty and blank texts have an empty set and link with
nothing, not even their copies; repeated rows and ties link as equal texts; rows without an id belong to their
component but never name it; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardlens.llm import rolling
from shardlens.llm.common import frugal, kept, table, text_or_empty
from shardlens.llm.components import components
from shardlens.llm.passages import LAST, Unmet, keyed, unkeyed, unpacked

WORDS = 5
#: Links need FEWEST/100 of the union; other thresholds are asked for by parameter of the functions.
FEWEST = 75
SKETCH_BITS = 18  # of the count of shingles by the top bits of their hash: a fixed size


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    units = rolling.word_units(raw.lower())
    if not len(units):
        return np.zeros(0, np.uint64)
    if len(units) < WORDS:
        return rolling.mix(rolling.grams(units, len(units)) + np.uint64(len(units)))
    return rolling.distinct(rolling.grams(units, WORDS))


def prefix_length(n: int) -> int:
    return n - -(-FEWEST * n // 100) + 1


def ordered(sorted_hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The global order: shingles of common buckets last."""
    late = common[(sorted_hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return np.concatenate([sorted_hashes[~late], sorted_hashes[late]])


def order_of_last(prefix: np.ndarray, common: np.ndarray) -> int:
    """Where in the global order a prefix ends, as a number."""
    late = bool(common[int(prefix[-1] >> np.uint64(64 - SKETCH_BITS))])
    return int(prefix[-1] >> np.uint64(2)) | late << 62


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashed bitmap of ``bits`` (a power of two of at least 64) as words."""
    set_bits = np.zeros(bits, np.uint8)
    set_bits[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(set_bits, bitorder="little").view(np.uint64)


def bitmap_bits(n: int) -> int:
    return max(64, 1 << (n - 1).bit_length())


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (last axis: words) cut to ``bits``; the low bits of a hash choose the bit, so halves are joined."""
    while words.shape[-1] * 64 > bits:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def most_shared(a: np.ndarray, n_a: int, b: np.ndarray, n_b) -> np.ndarray:
    """Upper bounds of the overlap of a set with others (rows of ``b``), from bitmaps of one length."""
    a_only = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    b_only = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - a_only, n_b - b_only)


def links(shared, n_a, n_b):
    return 100 * shared >= FEWEST * (n_a + n_b - shared)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Exact size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set size; per task one count of shingles by bucket, in 64 rows."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    names = ["doc_id", "__key", "n", "counts"]
    for batch in batches:
        sizes = []
        for text in batch.column("text"):
            s = shingles(text.as_py().encode())
            np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            sizes.append(len(s))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__key"), pa.array(sizes, pa.int64()),
                                          pa.nulls(batch.num_rows, pa.binary())], names)
    parts = [pa.nulls(64, pa.int64()), pa.nulls(64, pa.int64()), pa.array(np.arange(64)), pa.array([c.tobytes() for c in counts.reshape(64, -1)], pa.binary())]
    yield pa.RecordBatch.from_arrays(parts, names)


def _common_buckets(sets: DataFrame) -> np.ndarray:
    """Buckets that hold more shingles than chance explains, as flags. The count has a fixed size."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, c in zip(batch.column("n").to_pylist(), batch.column("counts").to_pylist()):
                sums[n] = sums.get(n, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["n", "counts"])

    parts = sets.filter("counts IS NOT NULL").select("n", "counts").repartition(16, "n").mapInArrow(total, "n long, counts binary").collect()
    counts = np.zeros((64, (1 << SKETCH_BITS) // 64), np.int64)
    for r in parts:
        counts[r["n"]] += np.frombuffer(bytes(r["counts"]), np.int64)
    mean = counts.mean()
    return counts.ravel() > mean + 10 * np.sqrt(mean) + 10


def _tokens(common: np.ndarray):
    """Prefix shingles with their text key; a copy that the task has met sends none."""
    packed = np.packbits(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, unmet = np.unpackbits(packed).astype(bool), Unmet()
        for batch in batches:
            tokens, owners = [], []
            for key, text in zip(batch.column("__key").to_numpy(), batch.column("text")):
                if not unmet(int(key)):
                    continue
                s = shingles(text.as_py().encode())
                if len(s):
                    tokens.append(ordered(s, late)[:prefix_length(len(s))] >> np.uint64(16))
                    owners.append(np.full(len(tokens[-1]), key))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners))], ["token", "__key"])

    return run


def _signs(common: np.ndarray):
    """Per text (__key, __z, tokens) its set size, how many prefix shingles no other text has, where its prefix ends, and
    a bitmap for large tiles."""
    packed = np.packbits(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(packed).astype(bool)
        for batch in batches:
            sets = [shingles(raw) for raw in unpacked(batch.column("__z"))]
            n = [len(s) for s in sets]
            alone = np.array([prefix_length(x) for x in n]) - batch.column("tokens").value_lengths().to_numpy()
            ends = [order_of_last(ordered(s, late)[:prefix_length(len(s))], late) for s in sets]
            sketches = [bitmap(s, SKETCH).tobytes() if big else None for s, big in zip(sets, batch.column("large").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(n, pa.int64()), pa.array(alone, pa.int64()), pa.array(ends, pa.int64()),
                                              pa.array(sketches, pa.binary()), batch.column("tokens")], ["__key", "n", "alone", "ends", "sketch", "tokens"])

    return run


def least_overlap(n, m):
    """The smallest overlap with which sets of these sizes link."""
    return -(-FEWEST * (n + m) // (100 + FEWEST))


def _needed(n: int, alone: int, ends: int, m: int, theirs: int, their_ends: int) -> int:
    """How many prefix shingles two texts must share to link, by the one whose prefix ends first: all its other
    prefix shingles are its own. 0 if sizes or shingles that no other text has rule the link out."""
    if 100 * min(n, m) < FEWEST * max(n, m):
        return 0
    if ends == their_ends:
        return 1
    size, only = (n, alone) if ends < their_ends else (m, theirs)
    least = least_overlap(n, m)
    return max(1, least - size + prefix_length(size)) if size - only >= least else 0


SMALL_TILE = 32  # rows of a tile compared one by one; larger ones go through arrays
LARGE = 1 << 62  # added to the token of a larger tile
SKETCH, COMPARED = 1024, 1 << 14  # bits of the bitmaps in large tiles, bitmaps compared at once


class _Band:
    """Rows of one large tile (root, __key, n, alone, ends) and their bitmaps, in growing arrays sorted by n."""

    def __init__(self):
        self.used, self.rows, self.sketches = 0, np.zeros((5, SMALL_TILE), np.int64), np.zeros((SMALL_TILE, SKETCH // 64), np.uint64)

    def add(self, row: list, sketch: np.ndarray) -> None:
        if self.used == self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
            self.sketches = np.concatenate([self.sketches, np.zeros_like(self.sketches)])
        self.rows[:, self.used], self.sketches[self.used] = row, sketch
        self.used += 1

    def partners(self, row: list, sketch: np.ndarray) -> list[tuple[int, int]]:
        """(key, shared prefix shingles needed) of earlier, smaller texts of other components that may link."""
        root, _, n, alone, ends = row
        first = int(np.searchsorted(100 * self.rows[2, :self.used], FEWEST * n))
        roots, keys, m, theirs, their_ends = self.rows[:, first:self.used]
        least = least_overlap(n, m)
        own = ends < their_ends
        size, only = np.where(own, n, m), np.where(own, alone, theirs)
        need = np.where(ends == their_ends, 1, np.maximum(1, least - size + (size - -(-FEWEST * size // 100) + 1)))
        hit = np.flatnonzero((roots != root) & ((ends == their_ends) | (size - only >= least)))
        near = [part[links(most_shared(sketch, n, self.sketches[first + part], m[part]), n, m[part])]
                for part in (hit[at:at + COMPARED] for at in range(0, len(hit), COMPARED))]
        hit = np.concatenate([hit[:0], *near])
        return list(zip(keys[hit].tolist(), need[hit].tolist()))


def _rank(hit: tuple[int, int]) -> int:
    """An order of texts that is the same in all tiles and has nothing to do with their sizes."""
    return hit[0] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def _band_pairs(every: bool):
    """Pairs (a, b, need) of texts that may link, from rows (token, root, __key, n, alone, ends, sketch) sorted by token
    and size: every pair of a tile, or for each text only the nearest, the farthest in size and the first by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, tile, band = None, [], None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for t, sketch, *row in zip(*(batch.column(c).to_pylist() for c in ("token", "sketch", "root", "__key", "n", "alone", "ends"))):
                if t != token:
                    token, tile, band = t, [], _Band() if t >= LARGE else None
                if band is not None:
                    bits = np.frombuffer(sketch, np.uint64)
                    hit = band.partners(row, bits)
                    band.add(row, bits)
                else:
                    hit = [(x[1], need) for x in tile if x[0] != row[0] and (need := _needed(*row[2:], *x[2:]))]
                    tile.append(row)
                if not every and len(hit) > 2:
                    hit = {hit[0], hit[-1], min(hit, key=_rank)}
                out += [(min(row[1], k), max(row[1], k), need) for k, need in hit]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["a", "b", "need"])

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, __z, others) the pairs whose sets link: bitmaps bound the overlap, then arrays settle it."""
    for batch in batches:
        keep = []
        for x, y in zip(map(shingles, unpacked(batch.column("__z"))), map(shingles, unpacked(batch.column("others")))):
            size = min(bitmap_bits(len(x)), bitmap_bits(len(y)))
            most = most_shared(bitmap(x, size), len(x), bitmap(y, size), len(y))
            keep.append(bool(links(most, len(x), len(y)) and links(overlap(x, y), len(x), len(y))))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def with_components(documents: DataFrame) -> DataFrame:
    """(doc_id, __key, n_shingles, root, component_id) of every row; root is the component of the text key."""
    n_tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = text_or_empty()
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("__key"), text.alias("text"))
    sets = kept(plain.mapInArrow(frugal(_sets), "doc_id long, __key long, n long, counts binary"))
    rows = sets.filter("counts IS NULL").select("doc_id", "__key", "n")
    tile = W.partitionBy("token")

    # Prefix shingles that more than one text has, with the texts that have them: all that can link. The texts are
    # kept in buckets of their key, so that the joins below do not shuffle them again. Copies are one: of those in
    # several tasks the sets of tokens are merged, and of the rows with the smallest id (or none) one is taken.
    common = _common_buckets(sets)
    prefix = plain.select("__key", "text").mapInArrow(frugal(_tokens(common)), "token long, __key long")
    large = F.when(F.count("*").over(tile) > SMALL_TILE, F.lit(LARGE)).otherwise(F.lit(0))
    shared = (prefix.withColumn("many", F.min("__key").over(tile) != F.max("__key").over(tile)).withColumn("large", large).filter("many")
              .groupBy("__key").agg(F.collect_set(F.col("token") + F.col("large")).alias("tokens")))
    first = (rows.groupBy("__key", F.coalesce("doc_id", F.lit(LAST)).alias("__doc")).agg(F.count("*").alias("n"))
             .groupBy("__key").agg(F.min(F.struct("__doc", "n")).alias("least"))
             .select("__key", F.col("least.__doc").alias("__first"), (F.col("least.n") > 1).alias("__tied")))
    wanted = shared.join(first.hint("shuffle_hash"), "__key")
    bucketed = f"jaccard_texts_{uuid.uuid4().hex[:12]}"
    found = keyed(documents.select("doc_id", "text")).join(wanted.hint("shuffle_hash"), "__key").filter("NOT (__doc > __first)")
    one = found.filter("__tied").select("__key", "__z", "tokens").dropDuplicates(["__key"])
    (found.filter("NOT __tied").select("__key", "__z", "tokens").unionByName(one).write.bucketBy(n_tasks, "__key").format("parquet").saveAsTable(bucketed))
    texts = documents.sparkSession.table(bucketed)
    signs = kept(texts.withColumn("large", F.array_max("tokens") >= LARGE)
                 .mapInArrow(frugal(_signs(common)), "__key long, n long, alone long, ends long, sketch binary, tokens array<long>"))

    def candidates(roots: DataFrame, every: bool) -> DataFrame:
        rows = (signs.join(roots, "__key", "left").select(F.coalesce("root", "__key").alias("root"), "__key", "n", "alone", "ends", "sketch", F.explode("tokens").alias("token"))
                .withColumn("sketch", F.when(F.col("token") >= LARGE, F.col("sketch")))
                .repartition(n_tasks, "token").sortWithinPartitions("token", "n", "__key"))
        # A pair comes once from every tile the two share: their shared prefix shingles are counted. (Where only some
        # pairs of a tile are tried, half as many will do.)
        return (rows.mapInArrow(frugal(_band_pairs(every)), "a long, b long, need long")
                .groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need"))
                .filter("shared >= need" if every else "2 * shared >= need").select("a", "b"))

    def linked(pairs: DataFrame) -> DataFrame:
        return (pairs.join(texts.select(F.col("__key").alias("b"), F.col("__z").alias("others")), "b")
                .join(texts.select(F.col("__key").alias("a"), "__z"), "a")
                .select("a", "b", "__z", "others").mapInArrow(frugal(_linked), "a long, b long"))

    nobody = signs.select("__key", F.col("__key").alias("root")).limit(0)
    tried = kept(candidates(nobody, every=False))
    near = kept(linked(tried))
    roots = components(near).select(F.col("node").alias("__key"), "root")
    rest = kept(linked(candidates(roots, every=True).join(tried, ["a", "b"], "left_anti")))
    # The links of the second pass join components, so only those are looked at again.
    end = lambda c: roots.select(F.col("__key").alias(c), F.col("root").alias(f"root_{c}"))
    joined = (rest.join(end("a"), "a", "left").join(end("b"), "b", "left")
              .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct())
    above = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
    lone = above.select(F.col("root").alias("__key"), "root").join(roots.select("__key"), "__key", "left_anti")
    roots = roots.unionByName(lone).join(above, "root", "left").select("__key", F.coalesce("top", "root").alias("root"))
    documents.sparkSession.sql(f"DROP TABLE {bucketed}")

    named = rows.join(roots, "__key", "left").withColumn("root", F.coalesce("root", "__key"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    return (named.join(least, "root")
            .select("doc_id", "__key", F.col("n").alias("n_shingles"), "root",
                    F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")))


def op10_size_banded_jaccard(spark, sf_dir):
    return with_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest id stays (no id is the largest; of equal rows one);
    documents with an empty set all stay."""
    order = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("__doc"), F.col("__key"))
    rows = with_components(docs).select(F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"), order.alias("row"))
    best = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("row").alias("row"))
    stay = best.select("row").union(rows.filter("root IS NULL").select("row").distinct()).select("row.*")
    stay = stay.join(rows.filter("root IS NOT NULL").select("row.*").groupBy("__doc", "__key").agg((F.count("*") > 1).alias("__twice")), ["__doc", "__key"], "left")
    found = keyed(docs).join(stay.hint("shuffle_hash"), ["__key", "__doc"])
    one = found.filter("coalesce(__twice, false)").dropDuplicates(["__key", "__doc"])
    return unkeyed(found.filter("NOT coalesce(__twice, false)").unionByName(one).drop("__twice"), docs)
