"""File listing and path forms.

Listing goes through Spark's ``binaryFile`` source with the content column pruned,
so it works for any file system Spark can read and never loads file bodies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism, ship_package, work_dir

ERR_MISSING = "nothing is stored at {source}"
ERR_NO_FILES = "the folder holds no Parquet, JSON, JSON Lines or CSV file"
ERR_MANY_FILES = ("the folder holds several JSON or CSV files; name one of them, or pass strict=False to read all files "
                  "of one kind together")
ERR_UNSUPPORTED = "only .parquet, .json, .jsonl and .csv files can be opened"
# The supported suffixes besides Parquet.
SMALL_SUFFIXES = ["json", "jsonl", "csv"]
# Endings of data files, exported parts included.
DATA_ENDINGS = (".parquet", ".json", ".jsonl", ".csv", ".txt")


def list_files(spark: SparkSession, source: str, glob: str | None = None) -> DataFrame:
    """``(path, name, bytes, modified)`` for every file under ``source`` (recursive)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(source)
    return df.select(
        F.col("path"),
        F.element_at(F.split(F.col("path"), "/"), -1).alias("name"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def metadata_path() -> Column:
    """``_metadata.file_path`` in the same (decoded) form ``binaryFile`` lists it.

    The metadata column is URI-encoded (a space is ``%20``); a literal ``+`` must
    survive the decode, so it is escaped first.
    """
    return decoded_path(F.col("_metadata.file_path"))


def decoded_path(uri: Column) -> Column:
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def path_order(path: Column) -> Column:
    """Sort key for paths compared component by component (``a/x`` before ``a-b/x``)."""
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# Hadoop URI schemes and the PyArrow scheme for the same store.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_fs(path: str):
    """``(PyArrow file system, path inside it)`` for a Spark/Hadoop path.

    Local paths (``file:`` or none) go to the local file system as plain paths, so
    spaces and other characters need no URI encoding; remote ones through a URI.
    """
    import os

    from pyarrow import fs as pafs

    if path.startswith("file:") or "://" not in path:
        plain = path[len("file:"):] if path.startswith("file:") else path
        while plain.startswith("//"):
            plain = plain[1:]
        return pafs.LocalFileSystem(), os.path.abspath(plain)
    scheme, _, rest = path.partition("://")
    return pafs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}")


def path_kind(source: str) -> str:
    """``'dir'``, ``'file'`` or ``'missing'`` for a local or remote path."""
    try:
        from pyarrow import fs as pafs

        filesystem, inner = arrow_fs(source)
        info = filesystem.get_file_info(inner)
        if info.type == pafs.FileType.Directory:
            return "dir"
        if info.type == pafs.FileType.File:
            return "file"
        return "missing"
    except Exception:  # an unknown scheme: let Spark's listing decide
        return "unknown"


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def any_case(ending: str) -> str:
    """A glob for names with this ending in any case."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in ending)


def is_hidden(name: str) -> bool:
    """Whether Spark passes over a file or folder of this name."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


WALK = "path string, hidden boolean, folder boolean"


def _list_folders(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        filesystem = arrow_fs(source)[0]
        for batch in batches:
            for folder, hidden in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = filesystem.get_file_info(pafs.FileSelector(folder))
                for at in range(0, len(found), 10_000):
                    some = found[at:at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path for f in some], pa.string()),
                                                      pa.array([hidden or is_hidden(f.base_name) for f in some], pa.bool_()),
                                                      pa.array([f.type == pafs.FileType.Directory for f in some], pa.bool_())], ["path", "hidden", "folder"])
    return run


def walk(spark: SparkSession, source: str) -> DataFrame:
    """(path, hidden, folder): everything below a folder, also what Spark's own listing passes over.

    Folders are rows: round by round, one for each level of nesting, the tasks list the folders that the round before
    found. The driver sees how many there are, no names.
    """
    work_dir(spark)
    ship_package(spark)
    level, folders, found = spark.createDataFrame([(arrow_fs(source)[1], False)], "path string, hidden boolean"), 1, None
    while folders:
        spread = level.select("path", "hidden").repartition(min(folders, 4 * parallelism(spark)))
        here = spread.mapInArrow(_list_folders(source), WALK).checkpoint(eager=True)
        found = here if found is None else found.unionByName(here)
        level = here.filter("folder")
        folders = level.count()
    return found


def hidden_files(spark: SparkSession, source: str, endings: tuple[str, ...], most: int = 5) -> list[str]:
    """Data files Spark would leave out without a word because of their name or a folder's (the first few). What Spark's
    writers leave while they work is none. In stores that PyArrow has no file system for, none are seen."""
    where = path_kind(source)
    if where == "file":
        return [source] if is_hidden(source.rstrip("/").rsplit("/", 1)[-1]) else []
    if where != "dir":
        return []
    root = arrow_fs(source)[1].rstrip("/")
    names = F.lower("path")
    ends = names.endswith(endings[0])
    for e in endings[1:]:
        ends = ends | names.endswith(e)
    rows = (walk(spark, source).filter(F.col("hidden") & ~F.col("folder") & ends & ~F.col("path").contains("/_temporary/"))
            .orderBy("path").limit(most).collect())
    return [source.rstrip("/") + r["path"][len(root):] for r in rows]
