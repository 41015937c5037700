"""Exact top-k search over binary codes by incremental multi-index hashing (operator 7); DataFrame functions only.

A vector's code has a bit for each of its components: whether it is positive. It is kept in words of 64 bits, as many
as the longest vector needs. Codes are cut into segments of 16 bits, 4 a word, each with its own index. Round by
round the search radius of the segments grows: round s looks up all segment values that differ in exactly s bits from
the query's. After it every code within m(s + 1) - 1 of the query has been seen (of m segments one differs in at most
s bits), so a query is finished once its k-th verified distance is at most that; the others go on. Equal codes are one, with their k + 1 smallest ids (a result never needs more).

Defined results: the neighbours of a query are the other rows by (distance, vec_id); a null vector has no code and is
neither query nor neighbour; null and NaN components give bit 0, missing ones too; repeated ids are one row each
and, being the query itself, no neighbours of it; with fewer than k other rows all are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardlens.llm.common import kept, table

K, SEGMENTS, BITS = 10, 4, 16
WORD = SEGMENTS * BITS
EVERY = 100  # ids divisible by this are the queries
SALTS = 64


def code(embedding: Column, words: int) -> Column:
    positive = lambda x: F.coalesce((x > 0) & ~F.isnan(x), F.lit(False)).cast("long")
    word = lambda w: F.aggregate(F.sequence(F.lit(w * WORD), F.lit(w * WORD + WORD - 1)), F.lit(0).cast("long"),
                                 lambda bits, i: F.shiftleft(bits, 1).bitwiseOR(positive(F.get(embedding, i))))
    return F.array(*[word(w) for w in range(words)])


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _segments(codes: DataFrame, name: str, words: int) -> DataFrame:
    parts = F.array(*[F.shiftrightunsigned(F.get(F.col(name), F.lit(w)), BITS * i).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
                      for w in range(words) for i in range(SEGMENTS)])
    return codes.select(name, F.posexplode(parts).alias("segment", "value"))


def _smallest(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; a hot group is thinned in slices first."""
    salted = W.partitionBy(by, F.pmod(F.xxhash64(*order), F.lit(SALTS))).orderBy(*order)
    whole = W.partitionBy(by).orderBy(*order)
    rows = rows.withColumn("__i", F.row_number().over(salted)).filter(F.col("__i") <= n)
    return rows.withColumn("__i", F.row_number().over(whole)).filter(F.col("__i") <= n).drop("__i")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, distance) for the rows of ``queries`` among ``vectors``; both have vec_id, embedding."""
    spark = vectors.sparkSession
    longest = vectors.select("embedding").unionByName(queries.select("embedding")).agg(F.max(F.size("embedding"))).first()[0]
    words = max(1, -(-(longest or 0) // WORD))
    segments = SEGMENTS * words
    known = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", code(F.col("embedding"), words).alias("code")).distinct()
    ids = _smallest(known, "code", ["vec_id"], k + 1)
    members = kept(ids.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # k + 1 at most
    index = kept(_segments(members.select("code"), "code", words).repartition("segment", "value"))
    asked = queries.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), code(F.col("embedding"), words).alias("query")).distinct()
    active = kept(asked.select("query").distinct())
    flips = spark.range(1 << BITS).select(F.col("id").alias("flip"), F.bit_count("id").alias("flipped"))  # 2^16 rows, always

    seen, answers = None, None
    for radius in range(BITS + 1):
        mine = flips.filter(F.col("flipped") == radius).crossJoin(spark.range(segments).select(F.col("id").cast("int").alias("segment")))
        probes = _segments(active, "query", words).join(F.broadcast(mine), "segment").select("query", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        hits = probes.join(index, ["segment", "value"]).select("query", "code").distinct()
        rows = hits.withColumn("distance", distance(F.col("query"), F.col("code")))
        rows = rows.join(members, "code").select("query", "distance", F.explode("ids").alias("vec_id"))
        if seen is not None:
            rows = rows.unionByName(seen.join(active, "query", "left_semi"))
        best = kept(_smallest(rows.distinct(), "query", ["distance", "vec_id"], k + 1))
        covered = segments * (radius + 1) - 1
        done = (best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
                .filter(f"n > {k} AND far <= {covered}" if radius < BITS else "true").select("query"))
        part = best.join(done, "query", "left_semi")
        answers = part if answers is None else answers.unionByName(part)
        seen, active = best, kept(active.join(done, "query", "left_anti"))
        if active.isEmpty():
            break

    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return (asked.join(answers, "query").filter("vec_id <> query_id").withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance")))


def op7_multi_index_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0 AND NOT isnan(embedding[i]), false)) AS bits
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, v.vec_id,
             list_sum(list_transform(range(1, 65), lambda i: (q.bits[i] <> v.bits[i])::integer))::integer AS distance
      FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::integer AS rank, vec_id, distance FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {K}
"""
