"""The logical dataset: one source (file or folder) opened as one DataFrame.

``open_dataset`` decides how to read a path (S1), and the returned ``Dataset``
carries the lazy data frame, the file manifest and the positional row numbering
that paging, search results and shard labels are defined by.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mixed import mixed_types, ragged, with_raw
from ..session import scratch_path, work_dir
from . import files as FS
from .readers import (EXTRA_COLS, HIDDEN, KEYS_COL, OPEN_KEYS, RAW_COL, json_columns, jsonl_lines, parquet_counts, parquet_reader, open_keys, parse_jsonl,
                      read_csv, read_json_document, read_jsonl, read_parquet, typed_columns)

class DatasetError(RuntimeError):
    pass


@dataclass
class Dataset:
    spark: SparkSession
    source: str
    kind: str  # parquet | jsonl | json | csv
    base: DataFrame  # user columns + hidden position columns (+ __keys for JSON)
    columns: list[str]
    listing: DataFrame  # path, name, bytes, modified — every file of the dataset
    _ranges: DataFrame | None = field(default=None, repr=False)
    _count: int | None = field(default=None, repr=False)
    _file_stats: tuple[int, int] | None = field(default=None, repr=False)
    _schema: object = field(default=None, repr=False)
    # The plain scan without position columns (Parquet): full scans read only data columns.
    plain: DataFrame | None = field(default=None, repr=False)
    # Rows per file from footers (Parquet).
    counts: DataFrame | None = field(default=None, repr=False)
    # Re-reads the source keeping only files that satisfy a condition on ``__path``, applied
    # before row ids are given (JSONL: lines not parsed yet).
    reread: object = field(default=None, repr=False)
    # Turns re-read rows into user columns, carrying the named columns.
    finish: object = field(default=None, repr=False)

    # ------------------------------------------------------------------ basics
    @property
    def df(self) -> DataFrame:
        """The data as a plain DataFrame (user columns only)."""
        src = self.plain if self.plain is not None else self.base
        return src.select(*[F.col(f"`{c}`") for c in self.columns])

    def data(self) -> DataFrame:
        """User columns plus the per-row key list of JSON sources, for full scans."""
        if not self.has_presence:
            return self.df
        return self.base.select(*[F.col(f"`{c}`") for c in self.columns], F.col(KEYS_COL), F.col(RAW_COL))

    @property
    def schema(self):
        """Schema of the user columns (resolved once)."""
        if self._schema is None:
            fields = self.df.schema.fields
            if self.has_presence:
                mixed = mixed_types(self.df)
                fields = [T.StructField(f.name, with_raw(mixed.get(f.name, ragged(f.dataType)), F.try_element_at(F.col(RAW_COL), F.lit(f.name))), f.nullable)
                          for f in fields]
            self._schema = T.StructType(list(fields))
        return self._schema

    @property
    def has_presence(self) -> bool:
        return KEYS_COL in self.base.columns

    def file_stats(self) -> tuple[int, int]:
        """(number of files, total bytes) from the listing, one small job."""
        if self._file_stats is None:
            r = self.listing.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
            self._file_stats = (int(r["n"]), int(r["b"]))
        return self._file_stats

    def count(self) -> int:
        """Total rows (S9), from the range table (for Parquet: footers only)."""
        if self._count is None:
            self._count = int(self.ranges().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
        return self._count

    def schema_report(self) -> DataFrame:
        """(ordinal, column, type, nullable) per column."""
        schema = self.schema
        rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema.fields)]
        return self.spark.createDataFrame(rows, "ordinal int, column string, type string, nullable boolean")

    # ------------------------------------------------------------------ positions
    def ranges(self) -> DataFrame:
        """One row per scan unit: ``__path, __block, rows, base, start, shard_no, file_start``.

        ``start`` is the number of rows before the unit in path order, ``file_start`` before its file. The frame is
        as small as the number of files (splits for text sources) and is written to
        the checkpoint folder once, so later jobs do not recount.
        """
        if self._ranges is None:
            work_dir(self.spark)  # makes sure a checkpoint folder is set
            if self.counts is not None:
                zero = F.lit(0).cast("long")
                units = self.counts.select("__path", zero.alias("__block"), "rows", zero.alias("base"))
            else:
                units = (self.base.select(*HIDDEN).groupBy("__path", "__block")
                         .agg(F.count("*").alias("rows"), F.min("__local").alias("base")))
            units = units.checkpoint(eager=True)
            starts = _running(units.groupBy("__path").agg(F.sum("rows").alias("file_rows")))
            self._ranges = _block_starts(units, starts).checkpoint(eager=True)
        return self._ranges

    def _number(self, frame: DataFrame, ranges: DataFrame) -> DataFrame:
        """``frame`` with ``__row_no`` and ``__shard_no``. A row whose unit is not in ``ranges`` fails the job: it is
        never dropped. How the two are joined is left to Spark."""
        small = ranges.select("__path", "__block", "start", "base", "shard_no")
        lost = F.raise_error(F.concat(F.lit("rows of an unknown scan unit (was the source changed?): "), F.col("__path")))
        row_no = F.when(F.col("start").isNull(), lost.cast("long")).otherwise(F.col("start") + F.col("__local") - F.col("base") + 1)
        return (frame.join(small, ["__path", "__block"], "left").withColumn("__row_no", row_no)
                .withColumn("__shard_no", F.col("shard_no")).drop("start", "base", "shard_no"))

    def shard_label(self) -> Column:
        """Shard name shown for a row: the file name when a Parquet dataset has
        several files, else blank (W2)."""
        n_files, _ = self.file_stats()
        if self.kind != "parquet" or n_files <= 1:
            return F.lit("")
        return FS.file_name(F.col("__path"))

    def positioned(self) -> DataFrame:
        """User columns plus ``__row_no`` (1-based position) and ``__shard`` (W2, W3): one join with the range
        table, at any size."""
        return self._output(self._number(self.base, self.ranges()))

    def _output(self, numbered: DataFrame) -> DataFrame:
        extra = [F.col(c) for c in EXTRA_COLS if c in self.base.columns]
        return numbered.select(*[F.col(f"`{c}`") for c in self.columns], *extra, "__row_no",
                               self.shard_label().alias("__shard"), "__path", "__shard_no")

    def rows_between(self, first: int, last: int, only: list[int] | None = None) -> DataFrame:
        """Rows ``first..last`` (1-based, inclusive) in source order (L2); with ``only``, of those the ones at these positions.

        Only the files whose row range overlaps the request are read. One small job on the range table finds the scan
        units that do. A page touches a few (``FEW`` at most is looked for): they go into the scan as plain conditions, so
        that nothing is joined. If there are more, the files between the first and the last are joined with the range
        table; the rows are the same.
        """
        ranges = self.ranges()
        wanted = ranges.where((F.col("start") < F.lit(last)) & (F.col("start") + F.col("rows") >= F.lit(first)))
        if only is not None:
            wanted = wanted.where(F.exists(F.lit(only).cast("array<long>"), lambda p: (p > F.col("start")) & (p <= F.col("start") + F.col("rows"))))
        units = wanted.limit(FEW + 1).collect()
        if not units:
            return self.positioned().limit(0)
        between = F.col("__row_no").between(first, last)
        if only is not None:
            between = between & F.array_contains(F.lit(only).cast("array<long>"), F.col("__row_no"))
        few = len(units) <= FEW
        if few:
            here = F.col("__path").isin(sorted({u["__path"] for u in units}))
        else:
            order = FS.path_order(F.col("__path"))
            edge = wanted.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
            low, high = (F.array(*[F.lit(part) for part in edge[k]]) for k in ("low", "high"))
            here = (order >= low) & (order <= high)
        if self.reread is None:
            base = self.base.where(here)
            numbered = _literally(base, units) if few else self._number(base, ranges.where(here))
            return self._output(numbered.where(between))
        # Text files have no row numbers of their own, and how Spark splits them depends on which files are read: the
        # splits of exactly this scan are counted (lines only), and JSON is parsed after the wanted lines are picked.
        scan = self.reread(here)
        counted = scan.select(*HIDDEN).groupBy("__path", "__block").agg(F.count("*").alias("rows"), F.min("__local").alias("base"))
        found = _of_this_scan(counted.limit(SPLITS + 1).collect(), units, first, last) if few else None
        if found is not None:
            picked = _literally(scan, found)
        else:
            starts = ranges.where(here).groupBy("__path").agg(F.min("file_start").alias("file_start"), F.min("shard_no").alias("shard_no"))
            picked = self._number(scan, _block_starts(counted, starts))
        return self._output(self.finish(picked.where(between), ("__row_no", "__shard_no")))

    def page(self, page_index: int, page_size: int = 100) -> DataFrame:
        """Page ``page_index`` (0-based, clamped like the viewer) of ``page_size`` rows."""
        total = self.count()
        first = clamp_page(page_index, page_size, total) * page_size + 1
        return self.rows_between(first, first + page_size - 1)


#: Scan units of a request that are looked for at most, and splits of their files, to go into the scan as plain conditions.
FEW, SPLITS = 64, 1000


def _literally(frame: DataFrame, units: list) -> DataFrame:
    """The rows of ``frame`` that lie in these few scan units, with ``__row_no`` and ``__shard_no``."""
    row_no, shard_no, inside = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(False)
    for u in units:
        own = (F.col("__path") == F.lit(u["__path"])) & (F.col("__block") == F.lit(u["__block"]))
        row_no = F.when(own, F.col("__local") + F.lit(u["start"] - u["base"] + 1)).otherwise(row_no)
        shard_no = F.when(own, F.lit(u["shard_no"])).otherwise(shard_no)
        inside = inside | own
    return frame.where(inside).withColumn("__row_no", row_no.cast("long")).withColumn("__shard_no", shard_no.cast("long"))


def _of_this_scan(counted: list, units: list, first: int, last: int) -> list | None:
    """The splits of a scan of the files of ``units`` that overlap the request, with their starts; None if they are too many."""
    if len(counted) > SPLITS:
        return None
    out = []
    for path, (start, shard_no) in {u["__path"]: (u["file_start"], u["shard_no"]) for u in units}.items():
        for r in sorted((r for r in counted if r["__path"] == path), key=lambda r: r["__block"]):
            if start < last and start + r["rows"] >= first:
                out.append({"__path": path, "__block": r["__block"], "start": start, "base": r["base"], "shard_no": shard_no})
            start += r["rows"]
    return out if len(out) <= FEW else None


def _running(files: DataFrame) -> DataFrame:
    """``__path, file_start, shard_no``: rows before each file and its number, in path order.

    Files are cut into ranges of paths; running sums inside a range, plus one row per range for what comes before
    it. No window spans all files.
    """
    order = FS.path_order(F.col("__path"))
    cut = files.repartitionByRange(order).withColumn("__part", F.spark_partition_id()).checkpoint(eager=True)
    parts = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = (cut.groupBy("__part").agg(F.sum("file_rows").alias("r"), F.count(F.lit(1)).alias("n"))
              .select("__part", F.coalesce(F.sum("r").over(parts), F.lit(0)).alias("__rows"),
                      F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("__files")))
    inside = Window.partitionBy("__part").orderBy(order)
    running = F.sum("file_rows").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("file_rows")
    numbered = cut.withColumn("__sum", running).withColumn("__nth", F.row_number().over(inside))
    return numbered.join(before, "__part").select(
        "__path", (F.col("__rows") + F.col("__sum")).cast("long").alias("file_start"),
        (F.col("__files") + F.col("__nth")).cast("long").alias("shard_no"))


def _block_starts(units: DataFrame, starts: DataFrame) -> DataFrame:
    """``units`` (scan units with their rows) with ``start`` and ``shard_no``; a window holds one file's splits."""
    blocks = Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum("rows").over(blocks) - F.col("rows")
    return (units.withColumn("__before", running).join(starts, "__path")
            .select("__path", "__block", "rows", "base", (F.col("file_start") + F.col("__before")).cast("long").alias("start"), "shard_no", "file_start"))


def clamp_page(page_index: int, page_size: int, total: int) -> int:
    """Page index kept inside ``[0, pages-1]`` with ``pages = max(1, ceil(total/size))`` (L3)."""
    pages = max(1, (total + page_size - 1) // page_size)
    return max(0, min(page_index, pages - 1))


def page_count(total: int, page_size: int) -> int:
    return max(1, (total + page_size - 1) // page_size)


# ---------------------------------------------------------------------- opening

def open_dataset(spark: SparkSession, source: str, strict: bool = True, kind: str | None = None,
                 check_schema: bool = False) -> Dataset:
    """See ``_open``; with ``check_schema`` a Parquet dataset whose shards disagree on a
    column's type (or lack a column) is refused before any data is read (A9)."""
    ds = _open(spark, source, strict, kind)
    if check_schema and ds.kind == "parquet":
        from ..operators.schema import schema_drift

        bad = schema_drift(spark, source).where(~F.col("consistent")).limit(20).collect()
        if bad:
            detail = "; ".join(f"{r['column']}: {r['types']} in {r['files']} files" for r in bad)
            raise DatasetError(f"Shards disagree on their schema: {detail}")
    return ds


def _open(spark: SparkSession, source: str, strict: bool = True, kind: str | None = None) -> Dataset:
    """Open a file or folder as one dataset.

    A folder with any ``*.parquet`` below it is read as those Parquet shards and
    nothing else; otherwise it must hold exactly one ``.json``/``.jsonl``/``.csv``
    file (``strict=False`` reads all files of one such kind together).

    ``kind`` skips discovery and reads ``source`` (file or folder) as that kind —
    e.g. ``"jsonl"`` for a folder Spark's JSON writer produced (its part files end
    in ``.json`` but hold one object per line).
    """
    if kind is not None:
        where = FS.path_kind(source)
        if where == "missing":
            raise DatasetError(FS.ERR_MISSING.format(source=source))
        if kind == "parquet":
            return _open_parquet(spark, source, FS.list_files(spark, source, "*.parquet"), is_dir=where != "file")
        _refuse_hidden(spark, source, FS.DATA_ENDINGS)
        return _open_small(spark, source, kind, FS.list_files(spark, source))
    kind_of_path = FS.path_kind(source)
    if kind_of_path == "missing":
        raise DatasetError(FS.ERR_MISSING.format(source=source))
    if kind_of_path == "unknown":
        kind_of_path = "dir" if not FS.suffix(source) else "file"

    if kind_of_path == "dir":
        parquet = FS.list_files(spark, source, "*.parquet")
        if parquet.limit(1).count() > 0:
            return _open_parquet(spark, source, parquet, is_dir=True)
        _refuse_hidden(spark, source, FS.DATA_ENDINGS)
        listing = FS.list_files(spark, source)
        data = listing.where(F.lower(F.col("name")).rlike(r"\.(json|jsonl|csv)$"))
        parts = listing.where(F.col("name").rlike(r"^part-.*\.(json|txt)$")).select("path", "name").limit(1).collect()
        if parts and data.where(~F.col("name").startswith("part-")).isEmpty():
            # What Spark's writers (and ``export``) leave: JSON Lines, or the parts of one JSON array.
            array = parts[0]["name"].endswith(".txt") and _is_array_part(spark, source)
            return _open_small(spark, source, "json" if array else "jsonl", listing, glob="part-*")
        found = data.select("path", "name").limit(2).collect()
        if not found:
            raise DatasetError(FS.ERR_NO_FILES)
        if len(found) > 1:
            if strict:
                raise DatasetError(FS.ERR_MANY_FILES)
            # All files of one kind: the distinct suffixes (at most three) decide it.
            kinds = [r["k"] for r in data.select(
                F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("k")).distinct().collect()]
            if len(kinds) > 1:
                raise DatasetError(FS.ERR_MANY_FILES)
            return _open_small(spark, source, kinds[0], data, glob=FS.any_case(kinds[0]))
        return _open_small(spark, found[0]["path"], FS.suffix(found[0]["name"]), data)

    _refuse_hidden(spark, source, FS.DATA_ENDINGS)
    sfx = FS.suffix(source)
    if sfx == "parquet":
        return _open_parquet(spark, source, FS.list_files(spark, source), is_dir=False)
    if sfx in FS.SMALL_SUFFIXES:
        return _open_small(spark, source, sfx, FS.list_files(spark, source))
    raise DatasetError(FS.ERR_UNSUPPORTED)


def _is_array_part(spark: SparkSession, folder: str) -> bool:
    """Whether some line of the folder opens an exported array (a line of JSON Lines never is a lone bracket)."""
    return not spark.read.text(folder).where(F.col("value") == "[").limit(1).isEmpty()


def _open_parquet(spark: SparkSession, source: str, listing: DataFrame, is_dir: bool, own: bool = False) -> Dataset:
    base = read_parquet(spark, source, is_dir)
    columns = [c for c in base.columns if c not in HIDDEN]
    _check_case_duplicates(spark, columns)
    if is_dir and not own:
        _refuse_hidden(spark, source, (".parquet",))
    return Dataset(spark, source, "parquet", base, columns, listing, plain=parquet_reader(spark, source, is_dir),
                   counts=parquet_counts(spark, source, is_dir))


def _refuse_hidden(spark: SparkSession, source: str, endings: tuple[str, ...]) -> None:
    """Spark leaves out files named ``_x`` or ``.x``; a dataset that has such data files is refused, not cut short."""
    if hidden := FS.hidden_files(spark, source, endings):
        raise DatasetError(f"these files would be left out because of their names; rename or move them: {', '.join(hidden)}")


def _open_small(spark: SparkSession, source: str, kind: str, listing: DataFrame, glob: str | None = None) -> Dataset:
    if kind == "csv":
        try:
            base, columns = read_csv(spark, source, glob)
        except ValueError as other:
            raise DatasetError(str(other)) from other
        _check_case_duplicates(spark, columns)
        return Dataset(spark, source, kind, base, columns, listing)
    if kind == "jsonl":
        base, checked = read_jsonl(spark, source, glob), read_jsonl(spark, source, glob, strict=True)
    else:
        base, checked = read_json_document(spark, source, glob)
    profile = json_columns(checked)
    if profile is None:
        columns, shaped = [OPEN_KEYS], open_keys
    else:
        columns = [name for name, _ in profile]
        _check_case_duplicates(spark, columns)

        def shaped(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
            return typed_columns(rows, profile, keep)

    ds = Dataset(spark, source, kind, shaped(base), columns, listing)
    if kind == "jsonl":
        ds.reread = lambda files: jsonl_lines(spark, source, files, glob)
        ds.finish = lambda lines, keep: shaped(parse_jsonl(lines, keep), keep)
    return ds


def _check_case_duplicates(spark: SparkSession, columns: list[str]) -> None:
    if str(spark.conf.get("spark.sql.caseSensitive", "false")).lower() == "true":
        return
    seen: dict[str, str] = {}
    for c in columns:
        if c.lower() in seen:
            raise DatasetError(
                f"Columns {seen[c.lower()]!r} and {c!r} differ only by case; "
                "set spark.sql.caseSensitive=true to read this dataset.")
        seen[c.lower()] = c


def from_frame(spark: SparkSession, frame: DataFrame, source: str = "<dataframe>") -> Dataset:
    """Wrap a DataFrame Spark derived elsewhere.

    Its rows have no place of their own (a shuffle may order or cut them differently in each job), so it is written
    once to the checkpoint folder and read from there: a sorted frame keeps its order, and positions are stable.
    """
    void = [F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() == "void" else F.col(f"`{f.name}`") for f in frame.schema.fields]
    path = scratch_path(spark, "frame")
    frame.select(*void).write.parquet(path)
    ds = _open_parquet(spark, path, spark.createDataFrame([], "path string, name string, bytes long, modified timestamp"), is_dir=True, own=True)
    ds.source, ds.kind = source, "dataframe"
    return ds
