"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlens.session import scratch_path, ship_package, work_dir


#: Bytes of a batch that goes to or comes from Python. Spark's default is 64 MB, which each running task holds
#: several times, in the JVM and in Python. A session that sets a size of its own keeps it.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, so later jobs neither repeat it nor
    depend on the executors that made it. For compact intermediate tables (ids, counts, links)."""
    work_dir(df.sparkSession)  # a local session that names no folder gets one of its own
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder, read again: compressed, columns can be pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    """The text as a string; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers: from the installed package, or from the folder that
    ``SHARDLENS_TOKENIZERS`` names."""
    folder = os.environ.get("SHARDLENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Called at the end of every function wrapped by :func:`frugal`, in its worker: caches that may have grown with the data.
AT_END: list[Callable[[], None]] = []


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1000) -> Callable:
    """A function for ``mapInArrow`` that sees batches of at most ``rows`` rows and, at its end, gives the memory it
    used back: Python workers outlive their tasks, and several wait beside each running one."""

    @functools.wraps(run)
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        try:
            yield from run(small)
        finally:
            give_back()

    return bounded


def give_back() -> None:
    for forget in AT_END:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Recent(dict):
    """A cache of at most ``2 * most`` entries, made on demand: those met since the last but one time that ``most`` new ones
    had come. What is common stays, what came once goes. Keys longer than ``longest`` are not kept."""

    def __init__(self, make: Callable, most: int, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
