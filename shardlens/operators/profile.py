"""Dataset profiling: quality scan, analytics report and their parts.

Plan shape (the reason for the code below):

* One projection computes per-row facts (rendered text length, token count, a
  16-byte digest of the stripped text, flags). It runs inside whole-stage codegen.
* Duplicates are counted by grouping on the digest, never on the text, with
  map-side partial aggregation, so a text repeated in a third of all rows still
  costs one partial row per task.
* Medians are exact and distributed: lengths are grouped into a histogram
  (value → count, as small as the number of distinct lengths) and the middle is
  found with a running sum over that histogram.
* The analytics report reads the data once: ``GROUPING SETS`` over (length),
  (tokens), (digest), (role) after a ``posexplode_outer`` of the role markers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import TOKEN_ALIASES, text_aliases, token_column
from ..functions.render import render
from ..functions.text import has_no_markers, py_strip, role_markers
from ..sources.dataset import Dataset
from .resolve import resolve_apply

DEFAULT_SEQ_LEN = 1024


def token_count(c: Column, dt: T.DataType) -> Column:
    """Length of the token field when it is a list, else null."""
    if isinstance(dt, T.ArrayType):
        return F.when(c.isNotNull(), F.size(c).cast("long"))
    if isinstance(dt, T.VariantType):
        is_list = F.schema_of_variant(c).startswith("ARRAY")
        return F.when(is_list, F.size(F.variant_get(c, "$", "array<variant>")).cast("long"))
    return F.lit(None).cast("long")


def source_frame(ds: Dataset, sample_rows: int | None = None) -> DataFrame:
    """The rows a report looks at: everything, or the first ``sample_rows`` in order."""
    if sample_rows is not None:
        return ds.rows_between(1, sample_rows)
    return ds.data()


def facts(ds: Dataset, aliases: str | Sequence[str] = "report", sample_rows: int | None = None,
          frame: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Per-row facts: ``has_text, s, tlen, ntok, dupkey, empty_text, no_markers``,
    after the ``keep`` columns of ``frame`` (e.g. an id and ``__row_no``)."""
    names = text_aliases(aliases)
    frame = source_frame(ds, sample_rows) if frame is None else frame
    has_text = resolve_apply(ds, names, lambda c, dt: c.isNotNull(), F.lit(False))
    s = resolve_apply(ds, names, lambda c, dt: render(c, dt), F.lit(""))
    ntok = resolve_apply(ds, TOKEN_ALIASES, token_count, F.lit(None).cast("long"))
    kept = [F.col(f"`{c}`") for c in keep]
    step = frame.select(*kept, has_text.alias("has_text"), s.alias("s"), ntok.alias("ntok"))
    # The stripped key and the upper-cased text are projected once each and reused:
    # Catalyst keeps a non-trivial expression referenced several times in its own
    # projection instead of copying it into every use.
    step = step.select("*", py_strip(F.col("s")).alias("__key"), F.upper(F.col("s")).alias("__up"))
    key = F.col("__key")
    return step.select(
        *kept, "has_text", "s", "ntok",
        F.length("s").cast("long").alias("tlen"),
        # SHA-256 of the stripped text: the duplicate key that is shuffled.
        F.when(key != "", F.unhex(F.sha2(key, 256))).alias("dupkey"),
        (key == "").alias("empty_text"),
        has_no_markers(F.col("s"), F.col("__up")).alias("no_markers"),
    )


# ---------------------------------------------------------------------- quality scan

def quality_scan(ds: Dataset, seq_len: int = DEFAULT_SEQ_LEN, aliases: str | Sequence[str] = "report",
                 sample_rows: int | None = None) -> DataFrame:
    """One row: ``rows_checked, empty_text, empty_token_lists, duplicate_texts,
    no_markers, exact_length`` (A7). One scan, one shuffle keyed by the digest."""
    f = facts(ds, aliases, sample_rows)
    per_key = f.groupBy("dupkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("empty_text").alias("e"),
        F.count_if(F.col("ntok") == 0).alias("t0"),
        F.count_if("no_markers").alias("nm"),
        F.count_if(F.col("ntok") == seq_len).alias("x"),
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_checked"),
        F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("empty_text"),
        F.coalesce(F.sum("t0"), F.lit(0)).cast("long").alias("empty_token_lists"),
        F.coalesce(F.sum(F.when(F.col("dupkey").isNotNull(), F.col("n") - 1)), F.lit(0)).cast("long")
        .alias("duplicate_texts"),
        F.coalesce(F.sum("nm"), F.lit(0)).cast("long").alias("no_markers"),
        F.coalesce(F.sum("x"), F.lit(0)).cast("long").alias("exact_length"),
    )


def quality_report(ds: Dataset, seq_len: int = DEFAULT_SEQ_LEN, aliases: str | Sequence[str] = "report",
                   sample_rows: int | None = None) -> DataFrame:
    """The quality scan plus ``schema_consistent`` and ``source_modified``.

    Consistency is a real check for Parquet folders: the footer job of
    ``schema.schema_drift`` (one type per column, every column in every shard).
    Other sources have one discovered schema by construction. Nothing here writes
    to the source, so ``source_modified`` is false.
    """
    from .schema import schema_drift

    consistent = True
    if ds.kind == "parquet":
        consistent = schema_drift(ds.spark, ds.source).where(~F.col("consistent")).isEmpty()
    scan = quality_scan(ds, seq_len, aliases, sample_rows)
    return scan.select("*", F.lit(consistent).alias("schema_consistent"), F.lit(False).alias("source_modified"))


def duplicate_texts(ds: Dataset, aliases: str | Sequence[str] = "report", sample_rows: int | None = None) -> DataFrame:
    """One row ``dup_count``: rows whose stripped non-blank text appeared before (A5)."""
    f = facts(ds, aliases, sample_rows).where(F.col("has_text"))
    per_key = f.where(F.col("dupkey").isNotNull()).groupBy("dupkey").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("dup_count"))


# ---------------------------------------------------------------------- histograms

def histogram_stats(hist: DataFrame, measure: str = "m", value: str = "v", count: str = "n",
                    exact_value: int | None = None) -> DataFrame:
    """Per measure: ``rows, total, min, max, median`` from a (value, count) histogram.

    The histogram has one row per distinct value, so the running sum that finds the
    middle runs over a frame as small as the number of distinct lengths.
    """
    w_cum = Window.partitionBy(measure).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_all = Window.partitionBy(measure)
    h = hist.select(measure, F.col(value).alias("v"), F.col(count).alias("n"))
    h = h.withColumn("cum", F.sum("n").over(w_cum)).withColumn("tot", F.sum("n").over(w_all))
    lo_idx = F.floor((F.col("tot") + 1) / 2)
    hi_idx = F.floor(F.col("tot") / 2) + 1
    before = F.col("cum") - F.col("n")
    return h.groupBy(measure).agg(
        F.max("tot").cast("long").alias("rows"),
        F.sum(F.col("v") * F.col("n")).cast("long").alias("total"),
        F.min("v").cast("long").alias("min"),
        F.max("v").cast("long").alias("max"),
        ((F.max(F.when((before < lo_idx) & (lo_idx <= F.col("cum")), F.col("v")))
          + F.max(F.when((before < hi_idx) & (hi_idx <= F.col("cum")), F.col("v")))) / 2.0).alias("median"),
        F.coalesce(F.sum(F.when(F.col("v") == F.lit(exact_value), F.col("n"))), F.lit(0)).cast("long").alias("exact"),
    )


def _stats_columns(prefix: str, st: DataFrame, exact: bool = False) -> DataFrame:
    extra = [F.col("exact").alias("exact_length")] if exact else []
    return st.select(
        F.col("rows").alias(f"{prefix}_rows"),
        (F.col("total") / F.col("rows")).alias(f"{prefix}_avg"),
        F.col("median").cast("double").alias(f"{prefix}_median"),
        F.col("min").alias(f"{prefix}_min"),
        F.col("max").alias(f"{prefix}_max"),
        *extra,
    )


def text_stats(ds: Dataset, aliases: str | Sequence[str] = "report", sample_rows: int | None = None) -> DataFrame:
    """One row of text length statistics over rows whose text field is not null (A4)."""
    f = facts(ds, aliases, sample_rows).where(F.col("has_text"))
    hist = f.groupBy(F.lit("text").alias("m"), F.col("tlen").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return _stats_columns("text", histogram_stats(hist))


def token_stats(ds: Dataset, seq_len: int = DEFAULT_SEQ_LEN, sample_rows: int | None = None) -> DataFrame:
    """One row of token count statistics over rows whose token field is a list (A2, A3)."""
    f = facts(ds, "report", sample_rows).where(F.col("ntok").isNotNull())
    hist = f.groupBy(F.lit("tok").alias("m"), F.col("ntok").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    st = histogram_stats(hist, exact_value=seq_len)
    return _stats_columns("token", st, exact=True)


def role_counts(ds: Dataset, aliases: str | Sequence[str] = "report", sample_rows: int | None = None) -> DataFrame:
    """``(role, n)`` for role markers at line starts, most frequent first."""
    f = facts(ds, aliases, sample_rows).where(F.col("has_text"))
    roles = f.select(F.explode(role_markers(F.col("s"))).alias("role"))
    return roles.groupBy("role").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("role"))


# ---------------------------------------------------------------------- analytics report

_GID = {"all": 15, "text": 7, "tok": 11, "dup": 13, "role": 14}


def analytics_report(ds: Dataset, seq_len: int = DEFAULT_SEQ_LEN, aliases: str | Sequence[str] = "report",
                     sample_rows: int | None = None, with_files: bool = True) -> DataFrame:
    """One row: the analytics report (A8), from one scan of the data.

    Columns: ``rows, files, bytes, columns, sample_size, duplicate_texts,
    token_avg, token_median, token_min, token_max, exact_length, text_avg,
    text_median, text_min, text_max, detected_roles``.

    Plan: facts → ``posexplode_outer`` of the role markers (one row per marker, the
    other facts kept on the first) → ``GROUPING SETS ((), (len), (tokens),
    (digest), (role))`` with partial aggregation → digests counted again by how often they occur → one window
    partitioned by set for the running sums the medians need (histograms only) → one final aggregate.
    """
    f = facts(ds, aliases, sample_rows)
    e = f.select(
        F.when(F.col("has_text"), F.col("tlen")).alias("tv"),
        "ntok",
        F.when(F.col("has_text"), F.col("dupkey")).alias("dk"),
        F.posexplode_outer(F.when(F.col("has_text"), role_markers(F.col("s")))).alias("rpos", "role"),
    )
    first = F.col("rpos").isNull() | (F.col("rpos") == 0)
    e2 = e.select(
        F.when(first, F.col("tv")).alias("tv"),
        F.when(first, F.col("ntok")).alias("ntok"),
        F.when(first, F.col("dk")).alias("dk"),
        "role",
        first.alias("is_first"),
    )
    agg = e2.groupingSets([[], ["tv"], ["ntok"], ["dk"], ["role"]], "tv", "ntok", "dk", "role").agg(
        F.count_if("is_first").alias("nf"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    gid = F.col("gid")
    keep = ((gid == _GID["all"]) | ((gid == _GID["text"]) & F.col("tv").isNotNull())
            | ((gid == _GID["tok"]) & F.col("ntok").isNotNull()) | ((gid == _GID["dup"]) & F.col("dk").isNotNull())
            | ((gid == _GID["role"]) & F.col("role").isNotNull()))
    # Digest rows become a histogram of how often texts occur (v: copies, c: texts), so that what the windows see
    # does not grow with the number of texts.
    dup = gid == _GID["dup"]
    g = agg.where(keep).select(
        "gid", "role",
        F.when(dup, F.col("nf")).otherwise(F.coalesce("tv", "ntok")).alias("v"),
        F.when(dup, F.lit(1)).when(gid == _GID["role"], F.col("n")).otherwise(F.col("nf")).alias("c"),
    )
    g = g.groupBy("gid", "role", "v").agg(F.sum("c").alias("c"))
    part = Window.partitionBy("gid")
    g = g.withColumn("cum", F.sum("c").over(part.orderBy("v").rowsBetween(Window.unboundedPreceding,
                                                                             Window.currentRow)))
    g = g.withColumn("tot", F.sum("c").over(part))
    before = F.col("cum") - F.col("c")

    def stats(code: int, prefix: str) -> list[Column]:
        on = gid == code
        lo_idx = F.floor((F.col("tot") + 1) / 2)
        hi_idx = F.floor(F.col("tot") / 2) + 1
        rows = F.max(F.when(on, F.col("tot")))
        total = F.sum(F.when(on, F.col("v") * F.col("c")))
        lo = F.max(F.when(on & (before < lo_idx) & (lo_idx <= F.col("cum")), F.col("v")))
        hi = F.max(F.when(on & (before < hi_idx) & (hi_idx <= F.col("cum")), F.col("v")))
        return [
            (total / rows).cast("double").alias(f"{prefix}_avg"),
            ((lo + hi) / 2.0).cast("double").alias(f"{prefix}_median"),
            F.min(F.when(on, F.col("v"))).cast("long").alias(f"{prefix}_min"),
            F.max(F.when(on, F.col("v"))).cast("long").alias(f"{prefix}_max"),
        ]

    role_items = F.array_sort(F.collect_list(F.when(gid == _GID["role"], F.struct(
        (-F.col("c")).alias("k"), F.col("role").alias("r"), F.col("c").alias("n")))))
    roles_txt = F.array_join(F.transform(role_items, lambda x: F.concat(x["r"], F.lit(": "), x["n"].cast("string"))),
                             ", ")
    tok = stats(_GID["tok"], "token")
    report = g.agg(
        F.coalesce(F.max(F.when(gid == _GID["all"], F.col("c"))), F.lit(0)).cast("long").alias("sample_size"),
        F.coalesce(F.sum(F.when(gid == _GID["dup"], (F.col("v") - 1) * F.col("c"))), F.lit(0)).cast("long").alias("duplicate_texts"),
        *tok,
        F.when(F.max(F.when(gid == _GID["tok"], F.col("tot"))).isNotNull(),
               F.coalesce(F.sum(F.when((gid == _GID["tok"]) & (F.col("v") == seq_len), F.col("c"))), F.lit(0)))
        .cast("long").alias("exact_length"),
        *stats(_GID["text"], "text"),
        F.when(F.size(role_items) > 0, roles_txt).alias("detected_roles"),
    )
    # A full scan counts every row itself; only a head sample needs the total (footers).
    total = F.col("sample_size") if sample_rows is None else F.lit(ds.count())
    head = [total.cast("long").alias("rows")]
    if with_files:
        n_files, n_bytes = ds.file_stats()
        head += [F.lit(n_files).cast("long").alias("files"), F.lit(n_bytes).cast("long").alias("bytes")]
    head += [F.lit(", ".join(ds.columns)).alias("columns")]
    return report.select(*head, *report.columns)


# ---------------------------------------------------------------------- summary

def dashboard(ds: Dataset, sample_rows: int | None = None) -> DataFrame:
    """The dashboard card (A1, A2, A4): totals plus token and text statistics over all rows (or the first
    ``sample_rows``), dashboard alias list."""
    r = analytics_report(ds, aliases="dashboard", sample_rows=sample_rows)
    return r.select("rows", "files", "bytes", "columns", "sample_size", "token_avg", "token_median", "token_min",
                    "token_max", "text_avg", "text_median")


def dataset_summary(ds: Dataset) -> DataFrame:
    """One row: ``source_type, rows, files, bytes, n_columns, columns, token_column``."""
    n_files, n_bytes = ds.file_stats()
    tok = token_column(ds.columns)
    rows = ds.df.groupBy().agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(
        F.lit(ds.kind).alias("source_type"),
        F.col("rows").cast("long").alias("rows"),
        F.lit(n_files).cast("long").alias("files"),
        F.lit(n_bytes).cast("long").alias("bytes"),
        F.lit(len(ds.columns)).cast("long").alias("n_columns"),
        F.lit(", ".join(ds.columns)).alias("columns"),
        F.lit(tok).cast("string").alias("token_column"),
    )
