"""Rendezvous sharding: key law, few moves, gapless slots, hot keys."""

from pyspark.sql import functions as F

from shardlens.llm import sharding


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, size string")


def test_key_law_and_slots(spark):
    rows = [(i, f"t{i % 7}", "x", "y") for i in range(3000)] + [(5, "t5", "x", "y")] * 900 + [(None, None, None, None)] * 5
    out = sharding.shard_documents(documents(spark, rows)).toPandas()
    assert len(out) == len(rows)
    assert (out.groupby("doc_id", dropna=False)["shard"].nunique() == 1).all()
    moved = out[out.shard != out.grown_shard]
    assert set(moved.grown_shard) == {16} and 0 < len(moved) < len(out) / 8
    for _, group in out.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert (out[out.doc_id.isna()]["size"] == 1).all() and (out[out.doc_id.isna()].text_crc32 == 0).all()


def test_weights(spark):
    keys = spark.range(6000)
    weights = {0: 1.0, 1: 3.0, 2: 0.0}
    got = dict(sharding.with_shard(keys, "id", weights).groupBy("shard").count().collect())
    assert set(got) == {0, 1} and 2.6 < got[1] / got[0] < 3.4
    more = sharding.with_shard(sharding.with_shard(keys, "id", weights), "id", weights | {7: 1.0}, "grown")
    assert {r.grown for r in more.filter(F.col("grown") != F.col("shard")).collect()} == {7}


def test_empty(spark):
    assert sharding.shard_documents(documents(spark, [])).collect() == []


def test_plan_is_native(spark):
    plan = sharding.shard_documents(documents(spark, [(1, "a", "", "")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
