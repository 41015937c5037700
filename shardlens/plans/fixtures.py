"""Datasets derived from the driver tables, in the shapes the profiler reads.

Every fixture is a Spark job over a whole table: nothing is sampled, capped or
made up. Written fixtures go to a fresh folder under the session's work folder
(``spark.checkpoint.dir`` on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism, scratch_path
from ..sources.dataset import Dataset, from_frame, open_dataset
from ..sources.sinks import export

# Rows per shard when a table is cut into Parquet shards (so the shard count grows
# with the table: 3 shards at sf0.01, 25 at sf0.1).
ROWS_PER_SHARD = 400
# The token-length the oracle tests use: no derived token list has 1,024 entries.
TEST_SEQ_LEN = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Dataset:
    return open_dataset(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


def token_documents(spark: SparkSession, sf_dir: str) -> Dataset:
    """``documents`` plus ``tokens``: the length of every space-separated word."""
    docs = table(spark, sf_dir, "documents")
    tokens = F.transform(F.split(F.col("text"), " "), lambda w: F.length(w))
    return from_frame(spark, docs.select("*", tokens.alias("tokens")), "documents+tokens")


# Every so many documents lose their text and their tokens in ``blanked_documents``.
BLANK_EVERY = 7


def blanked_documents(spark: SparkSession, sf_dir: str) -> Dataset:
    """``token_documents`` in which every ``BLANK_EVERY``-th document has a blank text and an empty token list."""
    rows = token_documents(spark, sf_dir).df
    blank = F.col("doc_id") % BLANK_EVERY == 0
    return from_frame(spark, rows.withColumns({"text": F.when(blank, F.lit(" \u00a0\n")).otherwise(F.col("text")),
                                               "tokens": F.when(blank, F.array().cast("array<int>")).otherwise(F.col("tokens"))}), "blanked")


def write_token_documents(spark: SparkSession, sf_dir: str) -> str:
    """``documents`` with its ``tokens`` column stored as Parquet (the X1 shape:
    text plus a token list per row), as a real tokenized dataset would be."""
    target = scratch_path(spark, "token-docs")
    token_documents(spark, sf_dir).df.write.parquet(target)
    return target


def conversation_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: ``conv_id, conversation`` as a list of
    ``{from, value}`` messages in turn order."""
    conv = table(spark, sf_dir, "conversations")
    msgs = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return msgs.select("conv_id", F.transform("m", lambda x: F.struct(
        x["role"].alias("from"), x["text"].alias("value"))).alias("conversation"))


def conversations(spark: SparkSession, sf_dir: str, ordered: bool = True) -> Dataset:
    """``ordered`` by ``conv_id``, for what shows positions; reports need none."""
    frame = conversation_frame(spark, sf_dir)
    return from_frame(spark, frame.orderBy("conv_id") if ordered else frame, "conversations")


def flagged_labels(spark: SparkSession, sf_dir: str) -> Dataset:
    """``labels`` with ``toxic = 1`` as a boolean ``banned`` flag."""
    lab = table(spark, sf_dir, "labels")
    return from_frame(spark, lab.select("doc_id", "quality", (F.col("toxic") == 1).alias("banned")), "labels")


def _with_position(ds: Dataset) -> DataFrame:
    return ds.positioned().withColumn("__shard_no", F.floor((F.col("__row_no") - 1) / ROWS_PER_SHARD).cast("long"))


def write_shards(spark: SparkSession, sf_dir: str, drift_shard: int | None = None) -> str:
    """``documents`` cut into Parquet shards of ``ROWS_PER_SHARD`` consecutive rows,
    one file per shard in folders ``shard=000000``, ``shard=000001``, … .

    With ``drift_shard`` that one shard stores ``doc_id`` as a string.
    """
    ds = documents(spark, sf_dir)
    rows = _with_position(ds)
    folder = F.lpad(F.col("__shard_no").cast("string"), 6, "0").alias("shard")
    data = rows.select(*[F.col(c) for c in ds.columns], folder, "__row_no", "__shard_no")
    n_tasks = parallelism(spark)
    target = scratch_path(spark, "shards")

    def write(frame: DataFrame, mode: str) -> None:
        (frame.repartition(n_tasks, "shard").sortWithinPartitions("shard", "__row_no")
         .drop("__row_no", "__shard_no").write.mode(mode).partitionBy("shard").parquet(target))

    if drift_shard is None:
        write(data, "overwrite")
    else:
        write(data.where(F.col("__shard_no") != drift_shard), "overwrite")
        drifted = data.where(F.col("__shard_no") == drift_shard).withColumn("doc_id", F.col("doc_id").cast("string"))
        write(drifted, "append")
    return target


def shards(spark: SparkSession, sf_dir: str) -> Dataset:
    return open_dataset(spark, write_shards(spark, sf_dir))


def export_documents(spark: SparkSession, sf_dir: str, fmt: str) -> str:
    """``documents`` exported (in row order) as JSON Lines, a JSON array or CSV."""
    ds = documents(spark, sf_dir)
    target = scratch_path(spark, f"export-{fmt}")
    if fmt == "csv":
        (ds.positioned().orderBy("__row_no").select(*ds.columns).write
         .option("header", "true").option("escape", '"')
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
         .csv(target))
    else:
        export(ds.positioned(), target, fmt, ds=ds, order_col="__row_no")
    return target


# Which keys a ragged JSON row carries, by the document's language.
RAGGED_KEYS = {
    "en": ["doc_id", "text"],
    "fr": ["doc_id", "content", "lang"],
    "de": ["lang", "doc_id", "prompt"],
    "es": ["doc_id", "text", "content"],  # "text" present but null
}


def write_ragged_jsonl(spark: SparkSession, sf_dir: str) -> str:
    """JSON Lines whose keys differ by row (see ``RAGGED_KEYS``), in ``doc_id`` order."""
    docs = table(spark, sf_dir, "documents")
    opts = {"ignoreNullFields": "false"}
    null_text = F.lit(None).cast("string")
    line = (
        F.when(F.col("lang") == "en", F.to_json(F.struct("doc_id", "text"), opts))
        .when(F.col("lang") == "fr", F.to_json(F.struct("doc_id", F.col("text").alias("content"), "lang"), opts))
        .when(F.col("lang") == "de", F.to_json(F.struct("lang", "doc_id", F.col("text").alias("prompt")), opts))
        .otherwise(F.to_json(F.struct("doc_id", null_text.alias("text"), F.col("text").alias("content")), opts))
    )
    target = scratch_path(spark, "ragged")
    docs.orderBy("doc_id").select(line.alias("value")).write.text(target)
    return target


def write_event_props_jsonl(spark: SparkSession, sf_dir: str) -> str:
    """``events`` as JSON Lines with the ``props`` JSON text nested as an object."""
    ev = table(spark, sf_dir, "events")
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"props":'),
                    F.col("props"), F.lit("}"))
    target = scratch_path(spark, "events-jsonl")
    ev.orderBy("event_id").select(line.alias("value")).write.text(target)
    return target


def write_ragged_conversations_jsonl(spark: SparkSession, sf_dir: str) -> str:
    """``conversations`` as JSON Lines whose messages differ in their keys: in even turns ``from``, a null ``value`` and
    ``content``, in odd ones ``role`` and ``content``."""
    conv = table(spark, sf_dir, "conversations")
    opts = {"ignoreNullFields": "false"}
    empty = F.lit(None).cast("string")
    message = (F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("role").alias("from"), empty.alias("value"), F.col("text").alias("content")), opts))
               .otherwise(F.to_json(F.struct("role", F.col("text").alias("content")), opts)))
    rows = conv.select("conv_id", "turn", message.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("ms"))
    line = F.concat(F.lit('{"conv_id": '), F.col("conv_id").cast("string"), F.lit(', "conversation": ['), F.array_join("ms.m", ", "), F.lit("]}"))
    target = scratch_path(spark, "ragged-conversations")
    rows.select(line.alias("value")).write.text(target)
    return target


def write_objects_jsonl(spark: SparkSession, sf_dir: str) -> str:
    """A JSON object for each document: its keys stand in another order, or are null or absent, by ``doc_id``."""
    docs = table(spark, sf_dir, "documents")
    opts = {"ignoreNullFields": "false"}
    size, nothing = F.col("n_chars").alias("z"), F.lit(None).cast("string").alias("a")
    meta = (F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(size, nothing, "lang"), opts))
            .when(F.col("doc_id") % 3 == 1, F.to_json(F.struct("lang", F.struct(nothing, size).alias("n")), opts)).otherwise(F.lit("{}")))
    line = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "meta": '), meta, F.lit("}"))
    target = scratch_path(spark, "objects")
    docs.select(line.alias("value")).write.text(target)
    return target


def aliased_documents(spark: SparkSession, sf_dir: str) -> Dataset:
    """``documents`` under three text columns, of which each view's alias list means another."""
    message = F.struct(F.col("source").alias("from"), F.col("lang").alias("value"))
    return from_frame(spark, table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("prompt"), F.col("lang").alias("Chat_String"), F.array(message).alias("conversation")), "aliased")
