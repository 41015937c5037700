"""Readers for the four source kinds.

Each reader returns a *base* frame: the user columns plus three hidden columns that
locate every row in the source,

* ``__path``  – file path (decoded, the form ``binaryFile`` lists),
* ``__block`` – start offset of the scan split inside that file (0 for Parquet),
* ``__local`` – increasing position of the row inside that split,

from which ``Dataset`` derives 1-based global row numbers without any global sort.
For Parquet the position is the file's own ``_metadata.row_index``. For JSON Lines
it is ``monotonically_increasing_id``, which is consecutive within a scan task, and
every split is read by one task. JSON documents and CSV are cut into records once
(:mod:`.records`), which carry their place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mixed import own_keys
from ..functions.text import py_strip
from .files import decoded_path, metadata_path
from .records import csv_records, json_records

HIDDEN = ["__path", "__block", "__local"]
KEYS_COL = "__keys"
CORRUPT_COL = "__corrupt"
#: The text of each field of a JSON row, by key.
RAW_COL = "__raw"
EXTRA_COLS = [KEYS_COL, CORRUPT_COL, RAW_COL]
# Fixed value: the text of the key under which the viewer keeps CSV fields beyond the header.
EXTRA_FIELDS = "None"


def parquet_reader(spark: SparkSession, source: str, is_dir: bool) -> DataFrame:
    """The plain Parquet scan (user columns only)."""
    reader = spark.read
    if is_dir:
        # A file list, not a partitioned table: no partition columns are inferred.
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return reader.parquet(source)


def parquet_counts(spark: SparkSession, source: str, is_dir: bool) -> DataFrame:
    """``__path, rows`` of every file with rows. No column is read, so the counts come from the footers."""
    per_file = parquet_reader(spark, source, is_dir).groupBy(F.col("_metadata.file_path").alias("__uri")).agg(F.count(F.lit(1)).alias("rows"))
    return per_file.select(decoded_path(F.col("__uri")).alias("__path"), "rows")


def read_parquet(spark: SparkSession, source: str, is_dir: bool) -> DataFrame:
    raw = parquet_reader(spark, source, is_dir)
    cols = [F.col(f"`{c}`") for c in raw.columns]
    return raw.select(
        *cols,
        metadata_path().alias("__path"),
        F.lit(0).cast("long").alias("__block"),
        F.col("_metadata.row_index").alias("__local"),
    )


def _text_lines(spark: SparkSession, source: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(source).select(
        F.col("value").alias("__line"),
        metadata_path().alias("__path"),
        F.col("_metadata.file_block_start").alias("__block"),
    )


def _object_of(v: Column) -> Column:
    """A parsed JSON value as a row object: objects as they are, anything else as
    ``{"value": x}``."""
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    wrapped = F.parse_json(F.concat(F.lit('{"value":'), F.to_json(v), F.lit("}")))
    return F.when(is_obj, v).otherwise(wrapped)


def _keys_of(line: Column, v: Column) -> Column:
    """Keys of the row object in the order they were written."""
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_obj, own_keys(line)).otherwise(F.array(F.lit("value")))


def _raw_of(line: Column, v: Column) -> Column:
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_obj, F.from_json(line, "map<string,string>")).otherwise(F.create_map(F.lit("value"), line))


#: Spark's setting under which the last of repeated keys counts; taken up when an expression is resolved.
LAST_KEY_COUNTS = "spark.sql.variant.allowDuplicateKeys"


def jsonl_lines(spark: SparkSession, source: str, path_filter: Column | None = None, glob: str | None = None) -> DataFrame:
    """The non-blank lines of JSON Lines files, located but not parsed.

    ``path_filter`` (a condition on ``__path``) selects files before row ids are
    given, so the file listing is pruned to them.
    """
    lines = _text_lines(spark, source, glob)
    if path_filter is not None:
        lines = lines.where(path_filter)
    lines = lines.where(py_strip(F.col("__line")) != "")
    return lines.withColumn("__local", F.monotonically_increasing_id())


def parse_jsonl(lines: DataFrame, keep: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """One JSON value per line; a bad line fails the read; of repeated keys the last counts. ``keep``: further columns to
    carry. ``strict`` also finds what follows a value (once, when a dataset is opened)."""
    spark = lines.sparkSession
    before = spark.conf.get(LAST_KEY_COUNTS, "false")
    spark.conf.set(LAST_KEY_COUNTS, "true")
    try:
        # Parse once into its own column; the derived columns below reuse it (Catalyst
        # does not inline a non-trivial expression that is referenced several times).
        # Parsed as the one item of a list, since the parser passes over what follows a value.
        line = F.col("__line")
        listed = F.parse_json(F.concat(F.lit("["), line, F.lit("]")))
        parsed = lines.select(F.variant_get(listed, "$", "array<variant>").alias("__all"), "__line", *HIDDEN, *keep)
        one = F.size("__all") == 1
        if strict:  # a line that closes that list itself does not pass as a member of an object
            one = one & (~F.contains(line, F.lit("]")) | F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}"))).isNotNull())
        more = F.raise_error(F.concat(F.lit("more than one JSON value in a line of "), F.col("__path")))
        parsed = parsed.select(F.when(one, F.col("__all")[0]).otherwise(more).alias("__v"), "__line", *HIDDEN, *keep)
        v = F.col("__v")
        return parsed.select(_object_of(v).alias("__obj"), _keys_of(line, v).alias(KEYS_COL), _raw_of(line, v).alias(RAW_COL), *HIDDEN, *keep)
    finally:
        spark.conf.set(LAST_KEY_COUNTS, before)


def read_jsonl(spark: SparkSession, source: str, glob: str | None = None, strict: bool = False) -> DataFrame:
    return parse_jsonl(jsonl_lines(spark, source, glob=glob), strict=strict)


def read_json_document(spark: SparkSession, source: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON documents: a list of rows, ``{"data": [...]}``, ``{"rows": [...]}`` or a single value.

    The texts of the rows are cut out by as many tasks as the files have splits (:mod:`.records`); each is then one
    JSON value like a line of JSON Lines. The parts of an exported array are read as the one list they form. Returned as
    :func:`read_jsonl` does, without and with the strict check.
    """
    records = json_records(spark, source, glob)
    return parse_jsonl(records), parse_jsonl(records, strict=True)


_SCALARS = {
    "STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "VOID": T.StringType(),
    "TIMESTAMP": T.TimestampType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "BINARY": T.BinaryType(),
}


def variant_type_to_spark(type_text: str) -> T.DataType | None:
    """Spark type for a ``schema_of_variant`` text, or ``None`` to keep ``VARIANT``."""
    t = type_text.strip()
    if t in _SCALARS:
        return _SCALARS[t]
    m = re.fullmatch(r"DECIMAL\((\d+),\s*(\d+)\)", t)
    if m:
        # JSON numbers with a fraction arrive as decimals; Python reads them as floats. Whole numbers stay whole.
        return T.DecimalType(int(m[1]), 0) if int(m[2]) == 0 else T.DoubleType()
    if "VARIANT" in t:
        return None
    ddl = t.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    ddl = re.sub(r"DECIMAL\(\d+,\s*[1-9]\d*\)", "DOUBLE", ddl)
    try:
        return T.DataType.fromDDL(ddl)
    except Exception:
        return None


#: Keys that are made columns at most. Rows that use more take ids as keys: they are one map column, ``OPEN_KEYS``.
KEY_LIMIT, OPEN_KEYS = 10_000, "fields"


def json_columns(base: DataFrame) -> list[tuple[str, str]] | None:
    """``(key, type text)`` of a JSON source, keys in first-seen order (S6, S11); none if there are more than ``KEY_LIMIT``.

    One pass: every row object is exploded into its fields (``variant_explode``);
    grouping by key gives both the key's first position (row order, then the key's
    place in that row as written) and its merged type (``schema_of_variant_agg``).
    Only one partial row per key and task is shuffled, so the cost is the number of
    distinct keys.
    """
    spark = base.sparkSession
    rows = base.select("__obj", KEYS_COL, F.split("__path", "/").alias("__p"), "__block", "__local")
    fields = rows.lateralJoin(spark.tvf.variant_explode(F.col("__obj").outer()))
    per_key = fields.groupBy("key").agg(
        F.min(F.struct("__p", "__block", "__local",
                       F.array_position(F.col(KEYS_COL), F.col("key")).alias("kpos"))).alias("first"),
        F.schema_of_variant_agg("value").alias("t"),
    )
    found = per_key.limit(KEY_LIMIT + 1).collect()
    if len(found) > KEY_LIMIT:
        return None
    return [(r["key"], r["t"]) for r in sorted(found, key=lambda r: tuple(r["first"]))]


def open_keys(base: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows as one map from their keys to the text of their fields."""
    return base.select(F.col(RAW_COL).alias(OPEN_KEYS), *HIDDEN, *keep)


def typed_columns(base: DataFrame, columns: list[tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Turn the row objects of a JSON source into typed columns; a key whose values
    disagree in type stays ``VARIANT``."""
    cols = []
    for name, type_text in columns:
        path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        dtype = variant_type_to_spark(type_text)
        if dtype is None:
            cols.append(F.try_variant_get("__obj", path, "variant").alias(name))
        else:
            cols.append(F.try_variant_get("__obj", path, dtype.simpleString()).alias(name))
    return base.select(*cols, KEYS_COL, RAW_COL, *HIDDEN, *keep)


def read_csv(spark: SparkSession, source: str, glob: str | None = None) -> tuple[DataFrame, list[str]]:
    """The base frame and its columns: header row, every value a string, quoted newlines and doubled quotes.

    Rows are cut out and split into fields by as many tasks as the files have splits (:mod:`.records`), and kept. Empty
    fields (quoted or not) are ``''``, missing trailing ones null; when a header repeats a name the last such column
    wins. Fields beyond the header are a list in a further column, there if any row has some; its name is the text of
    the key the viewer files them under.
    """
    rows = csv_records(spark, source, glob)
    headers = [r["fields"] for r in rows.filter("is_header").select("fields").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"the files differ in their header: {headers[0]} and {headers[1]}")
    header = [name or f"_c{i}" for i, name in enumerate(headers[0])] if headers else []
    place = {name: i for i, name in enumerate(header)}  # later repeats overwrite earlier ones
    data = rows.filter(~F.col("is_header"))
    cols = [F.get("fields", F.lit(i)).alias(name) for name, i in place.items()]
    width, columns = F.size("fields"), list(place)
    if not data.filter(width > len(header)).isEmpty():
        extra = EXTRA_FIELDS if EXTRA_FIELDS not in place else EXTRA_FIELDS + "_"
        cols.append(F.when(width > len(header), F.slice("fields", len(header) + 1, F.greatest(width - len(header), F.lit(0)))).alias(extra))
        columns.append(extra)
    quoted = F.transform("fields", lambda f: F.when(f.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f))
    base = data.select(*cols, F.when(width != len(header), F.array_join(quoted, ",")).alias(CORRUPT_COL), *HIDDEN)
    return base, columns
