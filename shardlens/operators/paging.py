"""Row numbers, pages, browse and inspect projections.

Global positions come from the dataset's range table (one row per file), never
from a window over all rows. Numbering a *filtered* set (search results) uses
fixed-width buckets of the position: counts per bucket are a small frame, and the
one window that ranks rows is partitioned by bucket, so no task ever holds more
than one bucket of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import FLAG_ALIASES, MODEL_ALIASES, TEXT_ALIASES_BROWSER, TOKEN_ALIASES
from ..functions.render import preview_source, py_repr, py_str, render
from ..functions.text import collapse_ws, cut, py_strip
from ..sources import files as FS
from ..sources.dataset import Dataset, clamp_page
from ..sources.readers import KEYS_COL
from ..sources.sinks import row_json
from .profile import token_count
from .resolve import resolve_apply

BROWSE_PREVIEW = 260
INSPECT_PREVIEW = 600
TOKEN_HEAD = 80
# Fixed value: page sizes the viewer offers (default 100).
PAGE_SIZES = [25, 50, 100, 250, 500]
# Rows of a bucket when hits are numbered: whole rows, sorted by one task, so few enough for all tasks to have some.
BUCKET_ROWS = 1 << 14


def short_text(c: Column, dt: T.DataType, limit: int) -> Column:
    """Preview text (P3): JSON for lists/dicts, ``str`` otherwise, whitespace runs
    collapsed, stripped, cut to ``limit`` characters with an ellipsis."""
    return cut(py_strip(collapse_ws(preview_source(c, dt))), limit)


def _flag(c: Column, dt: T.DataType) -> Column:
    """True for boolean true or a text equal to ``true`` ignoring case (P5)."""
    if isinstance(dt, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return F.coalesce(F.lower(py_str(c, dt)) == "true", F.lit(False))


def browse_projection(ds: Dataset, frame: DataFrame) -> DataFrame:
    """``row_no, model, preview, n_tokens, flagged, shard`` (P6) for positioned rows."""
    model = resolve_apply(ds, MODEL_ALIASES, lambda c, dt: F.coalesce(py_str(c, dt), F.lit("")), F.lit(""))
    preview = resolve_apply(ds, TEXT_ALIASES_BROWSER, lambda c, dt: short_text(c, dt, BROWSE_PREVIEW), F.lit(""))
    ntok = resolve_apply(ds, TOKEN_ALIASES, token_count, F.lit(None).cast("long"))
    flag = resolve_apply(ds, FLAG_ALIASES, _flag, F.lit(False))
    return frame.select(
        F.col("__row_no").cast("long").alias("row_no"),
        model.alias("model"),
        preview.alias("preview"),
        ntok.alias("n_tokens"),
        flag.alias("flagged"),
        F.col("__shard").alias("shard"),
    )


def browse(ds: Dataset, page_index: int = 0, page_size: int = 100) -> DataFrame:
    """One browser page: clamps the index, reads only the overlapping shards."""
    return browse_projection(ds, ds.page(page_index, page_size))


def head_sample(ds: Dataset, n: int) -> DataFrame:
    """The first ``n`` rows in source order (L4)."""
    return ds.rows_between(1, n)


def number_rows(frame: DataFrame, order_col: str, out_col: str, page_index: int | None = None,
                page_size: int | None = None) -> DataFrame:
    """Number the rows of ``frame`` 1.. by ``order_col`` (distinct, increasing);
    optionally keep one page of the numbering.

    Offsets per bucket of ``order_col`` come from a small aggregate; ranks inside
    a bucket come from a window partitioned by bucket.
    """
    bucket = F.floor((F.col(order_col) - 1) / F.lit(BUCKET_ROWS)).cast("long")
    counts = frame.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.withColumn("__off", F.sum("__n").over(w) - F.col("__n"))
    body = frame.withColumn("__bucket", bucket)
    if page_index is not None:
        # One small job: the per-bucket offsets (one row per BUCKET_ROWS positions).
        table = offsets.collect()
        total = sum(int(r["__n"]) for r in table)
        first = clamp_page(page_index, page_size, total) * page_size + 1
        last = first + page_size - 1
        keep = [(int(r["__bucket"]), int(r["__off"])) for r in table
                if r["__off"] < last and r["__off"] + r["__n"] >= first]
        body = body.where(F.col("__bucket").isin([b for b, _ in keep]))
        small = frame.sparkSession.createDataFrame(keep, "__bucket long, __off long")
    else:
        small = offsets.select("__bucket", "__off")
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(order_col))
    out = body.join(small, "__bucket").withColumn(out_col, (F.col("__off") + rank).cast("long"))
    if page_index is not None:
        out = out.where(F.col(out_col).between(first, last))
    return out.drop("__bucket", "__off")


def inspect_fields(ds: Dataset, row_no: int) -> DataFrame:
    """``(ordinal, field, value)`` for one row: every field with a 600-character
    preview, in the row's own key order (P7)."""
    schema = {f.name: f.dataType for f in ds.schema.fields}
    row = ds.rows_between(row_no, row_no)
    if not ds.has_presence:
        items = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("field"),
                          short_text(F.col(f"`{c}`"), schema[c], INSPECT_PREVIEW).alias("value"))
                 for i, c in enumerate(ds.columns)]
        return row.select(F.explode(F.array(*items)).alias("f")).select("f.*")
    keyed = row.select("*", F.posexplode(KEYS_COL).alias("__pos", "__key"))
    value = None
    for c in ds.columns:
        branch = short_text(F.col(f"`{c}`"), schema[c], INSPECT_PREVIEW)
        value = F.when(F.col("__key") == c, branch) if value is None else value.when(F.col("__key") == c, branch)
    return keyed.select((F.col("__pos") + 1).cast("int").alias("ordinal"), F.col("__key").alias("field"),
                        value.alias("value"))


def inspect_record(ds: Dataset, row_no: int) -> DataFrame:
    """One row: ``row_no, display, token_count, token_head, token_min, token_max``.

    ``display`` is the rendered text, or the whole row as indented JSON when the
    row has no text field.
    """
    row = ds.rows_between(row_no, row_no)
    whole = row_json(row, ds.columns, ds, indent=2)
    display = resolve_apply(ds, TEXT_ALIASES_BROWSER,
                            lambda c, dt: F.when(c.isNull(), whole).otherwise(render(c, dt)), whole)
    return row.select(F.col("__row_no").alias("row_no"), display.alias("display"), *token_projection(ds))


def token_projection(ds: Dataset) -> list[Column]:
    """``token_count, token_head, token_min, token_max`` of a row (P4): null unless its token field is a list."""
    def tok(fn):
        return resolve_apply(ds, TOKEN_ALIASES, lambda c, dt: fn(c, dt) if isinstance(dt, T.ArrayType) else F.lit(None),
                             F.lit(None))

    return [
        tok(lambda c, dt: F.size(c).cast("long")).cast("long").alias("token_count"),
        tok(lambda c, dt: py_repr(F.slice(c, 1, TOKEN_HEAD), dt)).cast("string").alias("token_head"),
        tok(lambda c, dt: F.array_min(c)).cast("long").alias("token_min"),
        tok(lambda c, dt: F.array_max(c)).cast("long").alias("token_max"),
    ]


def shard_ranges(ds: Dataset) -> DataFrame:
    """``shard_no, shard, path, start, rows`` per file in path order."""
    per_file = ds.ranges().groupBy("__path", "shard_no").agg(F.sum("rows").cast("long").alias("rows"),
                                                              F.min("start").cast("long").alias("start"))
    return per_file.select(
        F.col("shard_no").cast("long").alias("shard_no"),
        FS.file_name(F.col("__path")).alias("shard"),
        F.col("__path").alias("path"), "start", "rows",
    )


def row_to_shard(ds: Dataset) -> DataFrame:
    """Every row's position and the number of the shard holding it (W2, W3); the shard
    number rides along with the range table in the position join."""
    return ds.positioned().withColumnRenamed("__shard_no", "shard_no").drop("__path")


class Pager:
    """Page navigation over ``total`` rows (L3): first, previous, next, last and jump
    all resolve to a clamped 0-based page index; ``rows`` reads that page."""

    def __init__(self, total: int, page_size: int = 100, index: int = 0):
        if page_size <= 0:
            raise ValueError("page_size must be positive")
        self.total, self.page_size = total, page_size
        self.index = clamp_page(index, page_size, total)

    @property
    def pages(self) -> int:
        return max(1, (self.total + self.page_size - 1) // self.page_size)

    def go(self, index: int) -> int:
        self.index = clamp_page(index, self.page_size, self.total)
        return self.index

    def first(self) -> int:
        return self.go(0)

    def previous(self) -> int:
        return self.go(self.index - 1)

    def next(self) -> int:
        return self.go(self.index + 1)

    def last(self) -> int:
        return self.go(self.pages - 1)

    def jump(self, page_number: int) -> int:
        """Jump to a 1-based page number, as typed by a user."""
        return self.go(page_number - 1)

    @property
    def bounds(self) -> tuple[int, int]:
        """1-based first and last position of the current page."""
        first = self.index * self.page_size + 1
        return first, first + self.page_size - 1
