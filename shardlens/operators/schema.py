"""File manifest and schema consistency across shards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources import files as FS
from ..sources.dataset import Dataset


def file_manifest(ds: Dataset) -> DataFrame:
    """``path, name, bytes, rows`` per file, zero-row files included.

    Rows per file are counted from the data scan grouped by file; for Parquet the
    scan reads no column (footers only). The listing keeps files without rows.
    """
    counts = ds.ranges().groupBy(F.col("__path").alias("path")).agg(F.sum("rows").cast("long").alias("rows"))
    return (ds.listing.join(counts, "path", "left")
            .select("path", "name", F.col("bytes").cast("long").alias("bytes"),
                    F.coalesce("rows", F.lit(0)).cast("long").alias("rows")))


def _footer_schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read only the Parquet footer of each listed file: ``(path, ordinal, column, type)``."""
    import pyarrow.parquet as pq

    for pdf in batches:
        out = []
        for path in pdf["path"]:
            try:
                filesystem, inner = FS.arrow_fs(path)
                with filesystem.open_input_file(inner) as fh:
                    schema = pq.ParquetFile(fh).schema_arrow
                for i, field in enumerate(schema):
                    out.append((path, i + 1, field.name, str(field.type)))
            except Exception as exc:  # an unreadable footer is itself a finding
                out.append((path, 0, "", f"unreadable: {type(exc).__name__}"))
        yield pd.DataFrame(out, columns=["path", "ordinal", "column", "type"])


def shard_schemas(spark: SparkSession, source: str) -> DataFrame:
    """Per-file schemas of every ``*.parquet`` under ``source``, from footers only.

    Runs before the data is read, since Spark's own scan fails on the first shard
    whose column type differs.
    """
    ship_package(spark)
    listing = FS.list_files(spark, source, "*.parquet").select("path")
    return listing.mapInPandas(_footer_schemas, "path string, ordinal int, column string, type string")


def schema_drift(spark: SparkSession, source: str) -> DataFrame:
    """``column, n_types, types, files, consistent`` per column name over all shards.

    A column is consistent when it has one type and appears in every shard.
    """
    per_file = shard_schemas(spark, source)
    n_files = FS.list_files(spark, source, "*.parquet").count()
    # A file whose footer can't be read is a finding too: it shows under the empty name, never as consistent.
    tagged = per_file.withColumn("__files", F.lit(n_files))
    grouped = tagged.groupBy("column").agg(
        F.count_distinct("type").cast("long").alias("n_types"),
        F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types"),
        F.count_distinct("path").cast("long").alias("files"),
        F.max("__files").cast("long").alias("all_files"),
        F.min("ordinal").alias("ordinal"),
    )
    return grouped.select(
        "column", "n_types", "types", "files",
        ((F.col("column") != "") & (F.col("n_types") == 1) & (F.col("files") == F.col("all_files"))).alias("consistent"),
    ).orderBy("ordinal", "column")


# Python type names a JSON/CSV value takes, by Spark type.
_PY_TYPE_NAMES = [
    ("string", "str"), ("bigint", "int"), ("int", "int"), ("double", "float"), ("float", "float"),
    ("boolean", "bool"), ("decimal", "int"), ("array", "list"), ("struct", "dict"), ("map", "dict"),
]
_VARIANT_TYPE_NAMES = [
    ("STRING", "str"), ("BIGINT", "int"), ("INT", "int"), ("DOUBLE", "float"), ("DECIMAL", "float"),
    ("BOOLEAN", "bool"), ("ARRAY", "list"), ("OBJECT", "dict"),
]


def column_types(ds: Dataset) -> DataFrame:
    """``ordinal, column_name, type_name`` per column.

    Parquet: the column's type. JSON and CSV: the Python type name of the first
    non-null value in row order (``NoneType`` when there is none). One aggregate
    pass over the data.
    """
    from pyspark.sql import types as T

    from ..functions.mixed import raw_of

    fields = ds.schema.fields
    if ds.kind == "parquet":
        rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)]
        return ds.spark.createDataFrame(rows, "ordinal int, column_name string, type_name string")
    pos = F.struct(F.split("__path", "/"), "__block", "__local")
    aggs = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.VariantType):
            kind = F.min_by(F.schema_of_variant(c), F.when(c.isNotNull() & ~F.is_variant_null(c), pos))
            name = None
            for prefix, py in _VARIANT_TYPE_NAMES:
                cond = kind.startswith(prefix)
                name = F.when(cond, F.lit(py)) if name is None else name.when(cond, F.lit(py))
            aggs.append(F.coalesce(name.otherwise(F.lit("NoneType")), F.lit("NoneType")).alias(f.name))
        elif raw_of(f.dataType) is not None and not isinstance(f.dataType, (T.ArrayType, T.StructType)):
            first = F.min_by(raw_of(f.dataType), F.when(c.isNotNull(), pos))  # a number: whole or not as written
            aggs.append(F.when(F.count(c) == 0, F.lit("NoneType")).when(first.rlike(r"^-?[0-9]+$"), F.lit("int")).otherwise(F.lit("float")).alias(f.name))
        else:
            simple = f.dataType.simpleString().split("<")[0]
            py = dict(_PY_TYPE_NAMES).get(simple, simple)
            aggs.append(F.when(F.count(c) > 0, F.lit(py)).otherwise(F.lit("NoneType")).alias(f.name))
    one = ds.base.agg(*aggs)
    items = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                      F.col(f"`{f.name}`").alias("type_name")) for i, f in enumerate(fields)]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def malformed_rows(ds: Dataset) -> DataFrame:
    """``row_no, record, <columns>`` for CSV rows whose field count differs from the header.

    Their missing fields stay null and extra fields are not turned into a column;
    the raw record is reported here instead.
    """
    from ..sources.readers import CORRUPT_COL

    if CORRUPT_COL not in ds.base.columns:
        return ds.spark.createDataFrame([], "row_no long, record string")
    pos = ds.positioned()
    # The parsed fields come along: Spark refuses a CSV scan that reads only the
    # corrupt-record column.
    return pos.where(F.col(CORRUPT_COL).isNotNull()).select(
        F.col("__row_no").alias("row_no"), F.col(CORRUPT_COL).alias("record"),
        *[F.col(f"`{c}`") for c in ds.columns])
