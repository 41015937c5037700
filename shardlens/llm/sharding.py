"""Sharding by weighted rendezvous hashing (operator 6); DataFrame functions only.

Every (record key, shard) pair gets a uniform number ``u`` from MD5; the record goes to the shard with the
smallest ``-ln(u) / weight``. The choice depends on the key, the shard names and their weights alone: a new
shard takes records only into itself, and a removed one spreads its own records over the rest.

Defined results: a null key is one key of its own (all such rows share a shard); a null text has 1 byte;
repeated rows each get their own slot; an empty table gives no rows; a shard with weight 0 gets nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardlens.llm.common import text_or_empty

#: Slot numbers are counted bucket by bucket; a fixed number, so that the slots of a table never depend on
#: how Spark cuts it. The offset table has at most this many rows a shard.
SLOT_BUCKETS = 4096
_TOP = float(1 << 52)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of ``key`` among ``weights`` (shard number to weight); ties go to the smaller number."""
    shards = {s: float(w) for s, w in sorted(weights.items()) if w > 0}
    if not shards:
        raise ValueError("no shard has a positive weight")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in shards.items():
        digits = F.substring(F.md5(F.concat(name, F.lit(f"|{shard}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 1) / (_TOP + 1)
        scores.append(F.struct((-F.log(u) / weight).alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scores))["shard"]


def with_shard(df: DataFrame, key: str, weights: Mapping[int, float], column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row in ``column`` (replaced if there already)."""
    return df.withColumn(column, rendezvous(F.col(key), weights))


def with_slots(df: DataFrame, columns: list[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Rows of ``columns`` and ``shard`` with a slot, gapless from 0 within each shard.

    Equal rows are counted first (map-side), then numbered by runs: no window holds a whole shard, however
    large one key or one group of equal rows is. A window holds one of ``SLOT_BUCKETS`` buckets of a shard.
    """
    names = [*columns, shard]
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null"))
                                                               for c in columns])), 1, 8), 16, 10).cast("long"),
                    F.lit(SLOT_BUCKETS)).cast("int")
    runs = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).withColumn("__bucket", bucket)
    sizes = runs.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__rows"))
    before = W.partitionBy(shard).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col(shard).alias("__shard"), F.col("__bucket").alias("__b"),
                           F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    within = W.partitionBy(shard, "__bucket").orderBy(*columns).rowsBetween(W.unboundedPreceding, -1)
    placed = (runs.withColumn("__first", F.coalesce(F.sum("__n").over(within), F.lit(0)))
              .join(F.broadcast(offsets), (F.col(shard) == F.col("__shard")) & (F.col("__bucket") == F.col("__b"))))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))
    return (placed.select(*names, "__offset", "__first", copies.alias("__i"))
            .select(*names, (F.col("__offset") + F.col("__first") + F.col("__i")).alias(slot)))


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """The digest of every document: shard among ``shards`` equal ones, its slot, and the shard with one more."""
    text = text_or_empty()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            (F.octet_length(text) + 1).cast("long").alias("size"),
                            F.crc32(text.cast("binary")).alias("text_crc32"))
    now, grown = ({s: 1.0 for s in range(n)} for n in (shards, shards + 1))
    rows = with_shard(with_shard(rows, "doc_id", now), "doc_id", grown, "grown_shard")
    slots = with_slots(rows, ["doc_id", "size", "text_crc32", "grown_shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"),
                        F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))


def op6_rendezvous_sharding(spark, sf_dir):
    from shardlens.llm.common import table

    return shard_documents(table(spark, sf_dir, "documents"))


def _best(shards: int) -> str:
    return (f"list_min(list_transform(range({shards}), lambda s: {{'score': -ln((('0x' || substr(md5(key || '|' || s), "
            "1, 13))::bigint::double + 1) / 4503599627370497.0), 'shard': s})).shard::integer")


ORACLE_SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
           CASE WHEN c & 1 = 1 THEN xor(3988292384::bigint, c >> 1) ELSE c >> 1 END, n::bigint)) AS t),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::varchar, 'null') AS key,
         hex(encode(coalesce(text, ''))) AS h FROM documents),
r AS (
  SELECT doc_id, strlen(text) + 1 AS size,
         xor(4294967295::bigint, list_reduce(list_transform(range(strlen(text)), lambda i:
             ('0x' || substr(h, 2 * i + 1, 2))::bigint),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint)) AS text_crc32,
         {_best(16)} AS shard, {_best(17)} AS grown_shard
  FROM d, crc_table),
b AS (
  SELECT *, (('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, 'null'), size, text_crc32, grown_shard)),
              1, 8))::bigint % {SLOT_BUCKETS})::integer AS bucket FROM r)
SELECT doc_id, size::bigint AS size, text_crc32::bigint AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32, grown_shard) - 1 AS slot,
       grown_shard
FROM b
"""
