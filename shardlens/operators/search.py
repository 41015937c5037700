"""Case-insensitive literal substring search.

The query is normalised once on the driver (``lower().strip()``) and matched
with ``contains`` against a lower-cased haystack built from the row's columns.
No regex, no ``LIKE`` (so ``%`` and ``_`` are literal), no UDF.

Reference semantics kept behind flags (both off by default): ``match_names`` puts
column names in the all-column haystack, ``match_nulls`` lets a null value match
the word ``none``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import value_text
from ..sources.dataset import Dataset, clamp_page
from ..sources.readers import KEYS_COL
from .paging import Pager, number_rows

ALL_COLUMNS = "__all__"
#: Positions in a bitmap (fixed by Spark's bitmap functions), bitmaps counted together, positions listed in a condition.
BITS_A_BUCKET, STRETCH, LISTED = 1 << 15, 1 << 15, 1000
BUCKET_ROWS = 1 << 20  # a capped search first counts a sixteenth of so many rows


def normalise_query(query: str) -> str:
    """``query.lower().strip()`` — plain Python, the query is one driver-side value."""
    return query.lower().strip()


def row_search_text(ds: Dataset, match_names: bool = False, match_nulls: bool = False) -> Column:
    """``key value key value …`` over all columns, lower-cased.

    For JSON sources the row's own keys are walked in the order that row wrote
    them; a key the row lacks contributes nothing, a present null contributes
    ``None`` (with ``match_nulls``).
    """
    schema = {f.name: f.dataType for f in ds.schema.fields}
    null_text = "None" if match_nulls else None
    if ds.has_presence:
        # (position of the key in this row, key, text) per column, sorted by position;
        # absent keys (position 0) dropped. Texts are built outside any lambda.
        items = F.array(*[F.struct(F.array_position(F.col(KEYS_COL), F.lit(name)).alias("p"), F.lit(name).alias("k"),
                                   value_text(F.col(f"`{name}`"), schema[name], null_text).alias("t"))
                          for name in ds.columns])
        present = F.filter(F.array_sort(items), lambda x: x["p"] > 0)
        words = F.transform(present, lambda x: F.concat_ws(" ", x["k"], x["t"]) if match_names else x["t"])
        return F.lower(F.array_join(words, " "))
    chunks = []
    for name in ds.columns:
        if match_names:
            chunks.append(F.lit(name))
        chunks.append(value_text(F.col(f"`{name}`"), schema[name], null_text))
    return F.lower(F.concat_ws(" ", *chunks)) if chunks else F.lit("")


def column_haystack(ds: Dataset, column: str, match_nulls: bool = False) -> Column:
    """Text of one column (lists/dicts rendered), lower-cased; null when the row has
    no such column (F2)."""
    schema = {f.name: f.dataType for f in ds.schema.fields}
    if column not in schema:
        return F.lit(None).cast("string")
    val = F.lower(value_text(F.col(f"`{column}`"), schema[column], "None" if match_nulls else None))
    if ds.has_presence:
        val = F.when(F.array_contains(F.col(KEYS_COL), F.lit(column)), val)
    return val


def match_condition(ds: Dataset, query: str, column: str = ALL_COLUMNS, match_names: bool = False,
                    match_nulls: bool = False) -> Column:
    q = normalise_query(query)
    if not q:
        return F.lit(True)  # empty query keeps every row
    hay = row_search_text(ds, match_names, match_nulls) if column == ALL_COLUMNS else column_haystack(ds, column, match_nulls)
    return F.coalesce(F.contains(hay, F.lit(q)), F.lit(False))


def search(ds: Dataset, query: str, column: str = ALL_COLUMNS, max_results: int | None = None,
           match_names: bool = False, match_nulls: bool = False) -> DataFrame:
    """Matching rows with their ``__row_no`` (F1, F2); with ``max_results`` only the
    first matches in row order, numbered in ``__match_no`` (F3).

    The cap is exact and distributed, and the search ends early: rows are counted from the first on, in ranges that
    double, until enough match. Only the files of the ranges passed are read, and no top-k of whole rows is merged
    in one task.
    """
    cond = match_condition(ds, query, column, match_names, match_nulls)
    if max_results is None:
        return ds.positioned().where(cond)
    found, done, step, total = 0, 0, max(1024, BUCKET_ROWS // 16), ds.count()
    while found < max_results and done < total:
        found += ds.rows_between(done + 1, done + step).where(cond).count()
        done, step = done + step, 2 * step
    hits = ds.rows_between(1, min(done, total)).where(cond)
    return number_rows(hits, "__row_no", "__match_no").where(F.col("__match_no") <= max_results)


def search_stats(ds: Dataset, query: str, column: str = ALL_COLUMNS, match_names: bool = False,
                 match_nulls: bool = False) -> DataFrame:
    """One row ``matches, scanned`` (F10) in one pass."""
    cond = match_condition(ds, query, column, match_names, match_nulls)
    return ds.data().agg(F.count_if(cond).cast("long").alias("matches"), F.count(F.lit(1)).cast("long").alias("scanned"))


def search_page(ds: Dataset, query: str, page_index: int, page_size: int = 100, column: str = ALL_COLUMNS,
                max_results: int | None = None, match_names: bool = False, match_nulls: bool = False) -> DataFrame:
    """One page of search results, numbered 1.. in row order (L6); with
    ``max_results`` the page is taken from the first ``max_results`` matches."""
    cond = match_condition(ds, query, column, match_names, match_nulls)

    def bounds(total: int) -> tuple[int, int]:
        total = total if max_results is None else min(total, max_results)
        first = clamp_page(page_index, page_size, total) * page_size + 1
        return first, min(first + page_size - 1, total)

    return _numbered_matches(ds, cond, bounds)


def match_bitmaps(ds: Dataset, cond: Column) -> DataFrame:
    """(bucket, bits, n): the positions of the matches as bitmaps, 4 KB for each 2^15 positions that hold any; kept."""
    from ..session import work_dir

    work_dir(ds.spark)
    row = F.col("__row_no")
    marks = ds.positioned().where(cond).groupBy(F.bitmap_bucket_number(row).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("bits"))
    return marks.select("bucket", "bits", F.bitmap_count("bits").alias("n")).checkpoint(eager=True)


def _numbered_matches(ds: Dataset, cond: Column, bounds) -> DataFrame:
    """Matches number ``first..last`` (``bounds(total matches)``) with ``__match_no``.

    The condition is evaluated once, in one scan that leaves bitmaps of the matching positions. Counts of the bitmaps,
    first of stretches of ``STRETCH`` buckets, then of the buckets of the wanted stretches, lead to the page's buckets;
    their bitmaps give its exact positions, and only those rows are fetched.
    """
    marks = match_bitmaps(ds, cond)
    stretch = F.floor(F.col("bucket") / STRETCH).cast("long")
    long_counts = marks.groupBy(stretch.alias("stretch")).agg(F.sum("n").alias("n")).orderBy("stretch").collect()  # one row for 2^30 positions
    first, last = bounds(sum(int(r["n"]) for r in long_counts))
    nothing = ds.positioned().where(F.lit(False)).withColumn("__match_no", F.lit(None).cast("long"))
    wanted, before = _overlapping([(r["stretch"], r["n"]) for r in long_counts], first, last)
    if not wanted or last < first:
        return nothing
    counts = marks.where(stretch.isin(wanted)).select("bucket", "n").orderBy("bucket").collect()
    wanted, more = _overlapping([(r["bucket"], r["n"]) for r in counts], first - before, last - before)
    positions = []
    for r in marks.where(F.col("bucket").isin(wanted)).orderBy("bucket").select("bucket", "bits").collect():  # at most one a match of the page
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        positions += ((r["bucket"] - 1) * BITS_A_BUCKET + 1 + np.flatnonzero(bits)).tolist()
    skip = first - before - more - 1
    positions = positions[skip:skip + last - first + 1]
    numbers = ds.spark.createDataFrame([(p, first + i) for i, p in enumerate(positions)], "__row_no long, __match_no long")
    rows = ds.rows_between(positions[0], positions[-1], positions if len(positions) <= LISTED else None)
    return rows.join(F.broadcast(numbers), "__row_no").select(*rows.columns, "__match_no")


def _overlapping(counts: list[tuple[int, int]], first: int, last: int) -> tuple[list[int], int]:
    """The entries that matches number ``first..last`` lie in, and how many matches come before them."""
    out, before, skipped = [], 0, 0
    for name, n in counts:
        if before < last and before + n >= first:
            out.append(name)
        elif not out:
            skipped += n
        before += n
    return out, skipped


class SearchResults:
    """Search hits numbered once and kept for paging.

    The first use runs the search over the whole dataset, numbers the hits in row
    order (bucketed, see ``number_rows``) and writes them with ``checkpoint()`` to the
    session's checkpoint folder. Every page after that reads only the written
    hits, not the dataset.
    """

    def __init__(self, ds: Dataset, query: str, column: str = ALL_COLUMNS, max_results: int | None = None,
                 match_names: bool = False, match_nulls: bool = False):
        self.ds, self.query = ds, normalise_query(query)
        self._args = (query, column, max_results, match_names, match_nulls)
        self._hits: DataFrame | None = None
        self._count: int | None = None

    @property
    def hits(self) -> DataFrame:
        if self._hits is None:
            from ..session import work_dir

            hits = search(self.ds, *self._args)
            numbered = hits if "__match_no" in hits.columns else number_rows(hits, "__row_no", "__match_no")
            work_dir(self.ds.spark)
            self._hits = numbered.checkpoint(eager=True)
        return self._hits

    def count(self) -> int:
        if self._count is None:
            self._count = self.hits.count()
        return self._count

    def pager(self, page_size: int = 100) -> Pager:
        return Pager(self.count(), page_size)

    def page(self, page_index: int, page_size: int = 100) -> DataFrame:
        first, last = Pager(self.count(), page_size, page_index).bounds
        return self.hits.where(F.col("__match_no").between(first, last))
