"""Quality scan, analytics and role counts on hand-worked edge rows."""

import pytest
from pyspark.sql import functions as F

from shardlens.operators import profile
from shardlens.sources.dataset import from_frame

EDGE = [
    (1, None, [1, 2]),
    (2, "", []),
    (3, "   ", None),
    (4, " ", list(range(1024))),
    (5, "hello", None),
    (6, "  hello\n", None),
    (7, "say user: hi", None),
    (8, "x", [3]),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "id long, text string, tokens array<int>")
    return from_frame(spark, df)


def test_quality_scan_edge_rows(edge):
    r = profile.quality_scan(edge).first().asDict()
    assert r == {"rows_checked": 8, "empty_text": 4, "empty_token_lists": 1, "duplicate_texts": 1,
                 "no_markers": 5, "exact_length": 1}


def test_quality_scan_sample_equals_full_when_large(edge):
    assert profile.quality_scan(edge, sample_rows=100).first() == profile.quality_scan(edge).first()
    assert profile.quality_scan(edge, sample_rows=2).first()["rows_checked"] == 2


def test_analytics_edge_rows(edge):
    r = profile.analytics_report(edge, with_files=False).first().asDict()
    assert r["sample_size"] == 8 and r["duplicate_texts"] == 1
    assert (r["text_min"], r["text_max"], r["text_median"]) == (0, 12, 3.0)
    assert r["text_avg"] == pytest.approx(30 / 7)
    assert (r["token_min"], r["token_max"], r["token_median"], r["exact_length"]) == (0, 1024, 1.5, 1)
    assert r["token_avg"] == pytest.approx(1027 / 4)
    assert r["detected_roles"] is None


def test_role_counts_spelling_and_ties(spark):
    rows = [(1, "USER: a\nUser : b\nassistant: c"), (2, "GPT: x\n  gpt: y\nUSER: z"), (3, None)]
    ds = from_frame(spark, spark.createDataFrame(rows, "id long, text string"))
    got = [(r["role"], r["n"]) for r in profile.role_counts(ds).collect()]
    assert got == [("USER", 2), ("GPT", 1), ("User", 1), ("assistant", 1), ("gpt", 1)]
    rep = profile.analytics_report(ds, with_files=False).first()
    assert rep["detected_roles"] == "USER: 2, GPT: 1, User: 1, assistant: 1, gpt: 1"


def test_median_even_and_odd(spark):
    for lens, want in (([1, 2, 3, 10], 2.5), ([5, 1, 9], 5.0), ([4], 4.0)):
        df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lens)], "id long, text string")
        st = profile.text_stats(from_frame(spark, df)).first()
        assert st["text_median"] == want


def test_messages_only_dataset_is_profiled(spark):
    df = spark.createDataFrame([(1, [("user", "hi")])], "id long, messages array<struct<role:string,content:string>>")
    ds = from_frame(spark, df)
    assert profile.quality_scan(ds).first()["empty_text"] == 0
    assert profile.quality_scan(ds, aliases="profile").first()["empty_text"] == 1


def test_duplicate_key_skew_stays_exact(spark):
    # A third of the rows share one text: still exact, counted through partial aggregates.
    n = 3000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("same text"))
                               .otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    ds = from_frame(spark, df.repartition(7))
    assert profile.duplicate_texts(ds).first()["dup_count"] == n // 3 - 1


def test_duplicates_plus_distinct_is_non_blank(spark):
    from shardlens.functions.text import py_strip
    from shardlens.plans import fixtures as X
    ds = X.documents(spark, "/root/testdata/sf0.01")
    dup = profile.duplicate_texts(ds).first()["dup_count"]
    key = py_strip(F.coalesce(F.col("text"), F.lit("")))
    stats = ds.df.where(key != "").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
    assert dup + stats["d"] == stats["n"] and dup == 73


def test_sampled_report_covering_everything_equals_full(spark):
    from shardlens.plans import fixtures as X
    ds = X.documents(spark, "/root/testdata/sf0.01")
    full = profile.analytics_report(ds).first().asDict()
    sampled = profile.analytics_report(ds, sample_rows=10_000).first().asDict()
    assert full == sampled
    head = profile.analytics_report(ds, sample_rows=10).first()
    assert (head["rows"], head["sample_size"]) == (1000, 10)


def test_reports_over_variant_text(spark, tmp_path):
    from shardlens import open_dataset
    rows = ['{"text": [{"from": "user", "value": "hi"}, {"from": "gpt", "value": "yo"}]}',
            '{"text": "USER: same"}', '{"text": "USER: same "}', '{"text": null}']
    p = tmp_path / "v.jsonl"
    p.write_text("\n".join(rows) + "\n", encoding="utf-8")
    ds = open_dataset(spark, str(p))
    q = profile.quality_scan(ds).first()
    # Every non-empty text holds a marker once upper-cased ("user: hi" → "USER: HI").
    assert (q["rows_checked"], q["empty_text"], q["duplicate_texts"], q["no_markers"]) == (4, 1, 1, 0)
    a = profile.analytics_report(ds, with_files=False).first()
    # Markers are counted as written: "user" and "gpt" in the conversation, "USER" in each plain text.
    assert a["detected_roles"] == "USER: 2, gpt: 1, user: 1" and a["text_max"] == len("user: hi\n\ngpt: yo")


def test_conversation_positions_are_stable(spark):
    from shardlens.operators import paging
    from shardlens.plans import fixtures as X
    ds = X.conversations(spark, "/root/testdata/sf0.01")
    first = [r["conv_id"] for r in ds.positioned().orderBy("__row_no").collect()]
    assert first == sorted(first) and len(first) == 100
    assert [r["conv_id"] for r in paging.head_sample(ds, 5).orderBy("__row_no").collect()] == first[:5]
