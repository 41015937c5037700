"""Search (F1-F5, F10, P8), paging (L2-L6, W1-W3), inspection (P6, P7) and export (K1-K3)."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shardlens import DatasetError, open_dataset
from shardlens.operators import paging, search
from shardlens.sources.dataset import from_frame
from shardlens.sources.sinks import export


@pytest.fixture(scope="module")
def rows_ds(spark):
    df = spark.createDataFrame(
        [(1, None, "Hello 100%"), (2, "b_x", "nothing"), (3, "z", "HELLO world")],
        "a long, b string, c string")
    return from_frame(spark, df)


def test_all_column_search_flags(rows_ds):
    ids = lambda df: sorted(r["a"] for r in df.collect())
    assert ids(search.search(rows_ds, "  HELLO ")) == [1, 3]
    assert ids(search.search(rows_ds, "b none", match_names=True, match_nulls=True)) == [1]
    assert ids(search.search(rows_ds, "b none")) == []
    assert ids(search.search(rows_ds, "c ", match_names=True)) == [1, 2, 3]
    assert ids(search.search(rows_ds, "%")) == [1]
    assert ids(search.search(rows_ds, "_")) == [2]
    assert ids(search.search(rows_ds, "")) == [1, 2, 3]


def test_column_search_and_cap(rows_ds):
    ids = lambda df: sorted(r["a"] for r in df.collect())
    assert ids(search.search(rows_ds, "hello", column="c")) == [1, 3]
    assert ids(search.search(rows_ds, "none", column="b", match_nulls=True)) == [1]
    assert ids(search.search(rows_ds, "hello", column="missing")) == []
    assert ids(search.search(rows_ds, "hello", column="c", max_results=1)) == [1]
    st = search.search_stats(rows_ds, "hello").first()
    assert (st["matches"], st["scanned"]) == (2, 3)


def test_search_pages_number_matches(spark, tmp_path):
    path = str(tmp_path / "docs")
    os.makedirs(path)
    for i in range(4):
        ids = list(range(i * 10, i * 10 + 10))
        pq.write_table(pa.table({"id": ids, "text": [f"row {k} {'hit' if k % 3 == 0 else ''}" for k in ids]}),
                       f"{path}/part-{i}.parquet")
    ds = open_dataset(spark, path)
    want = [k for k in range(40) if k % 3 == 0]
    got = []
    for p in range(4):
        got += [r["id"] for r in search.search_page(ds, "hit", p, 4).orderBy("__match_no").collect()]
    assert got == want
    last = search.search_page(ds, "hit", 99, 4).orderBy("__match_no").collect()
    assert [r["__match_no"] for r in last] == [13, 14]


def test_browse_and_inspect(spark):
    df = spark.createDataFrame(
        [("gpt-x", "true", [5, 1, 9], "  some\n text "), ("m2", "False", [], "")],
        "model string, is_banned string, input_ids array<int>, Prompt string")
    ds = from_frame(spark, df)
    page = paging.browse(ds, 0, 25).orderBy("row_no").collect()
    assert [(r["row_no"], r["model"], r["preview"], r["n_tokens"], r["flagged"]) for r in page] == [
        (1, "gpt-x", "some text", 3, True), (2, "m2", "", 0, False)]
    fields = paging.inspect_fields(ds, 1).orderBy("ordinal").collect()
    assert [(r["field"], r["value"]) for r in fields] == [
        ("model", "gpt-x"), ("is_banned", "true"), ("input_ids", "[5, 1, 9]"), ("Prompt", "some text")]
    rec = paging.inspect_record(ds, 1).first()
    assert (rec["token_count"], rec["token_head"], rec["token_min"], rec["token_max"]) == (3, "[5, 1, 9]", 1, 9)
    assert rec["display"] == "  some\n text "
    rec2 = paging.inspect_record(ds, 2).first()
    assert (rec2["token_count"], rec2["token_min"], rec2["token_max"]) == (0, None, None)


def test_export_roundtrip_and_read_only(spark, tmp_path):
    src = str(tmp_path / "src")
    os.makedirs(src)
    pq.write_table(pa.table({"id": [1, 2], "text": ["é", None]}), f"{src}/a.parquet")
    ds = open_dataset(spark, src)
    with pytest.raises(DatasetError):
        export(ds.positioned(), src + "/out", "jsonl", ds=ds)
    out = str(tmp_path / "out")
    export(ds.positioned(), out, "jsonl", ds=ds, order_col="__row_no")
    back = open_dataset(spark, out, kind="jsonl")
    assert sorted((r["id"], r["text"]) for r in back.df.collect()) == [(1, "é"), (2, None)]
    arr = str(tmp_path / "arr")
    export(ds.positioned(), arr, "json", ds=ds, order_col="__row_no")
    part = [f for f in os.listdir(arr) if f.startswith("part-")][0]
    assert json.loads(open(f"{arr}/{part}", encoding="utf-8").read()) == [{"id": 1, "text": "é"},
                                                                          {"id": 2, "text": None}]


def test_page_count_and_clamp():
    from shardlens.sources.dataset import clamp_page, page_count
    assert page_count(0, 100) == 1 and page_count(100, 100) == 1 and page_count(101, 100) == 2
    assert clamp_page(-3, 100, 250) == 0 and clamp_page(7, 100, 250) == 2 and clamp_page(1, 100, 0) == 0
    assert paging.PAGE_SIZES == [25, 50, 100, 250, 500]


@pytest.mark.parametrize("fmt", ["jsonl", "json"])
def test_exports_open_again_as_they_were(spark, tmp_path, fmt):
    """Ragged rows, one or many parts: every row once, with its own keys, without naming a kind."""
    source = tmp_path / "rows.jsonl"
    rows = [{"id": i, **({"text": f"t{i}"} if i % 3 else {}), **({"note": None} if i % 5 == 0 else {})} for i in range(200)]
    source.write_text("\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    ds = open_dataset(spark, str(source))
    for parts in (1, 6):
        target = str(tmp_path / f"{fmt}{parts}")
        export(ds.positioned().repartition(parts), target, fmt, ds=ds, order_col="__row_no")
        again = open_dataset(spark, target)
        got = {r["id"]: (r["text"], sorted(r["__keys"])) for r in again.data().collect()}
        assert got == {r["id"]: (r.get("text"), sorted(r)) for r in rows}
        assert again.count() == 200
        if fmt == "json":
            texts = [open(os.path.join(target, f), encoding="utf-8").read() for f in sorted(os.listdir(target)) if f.startswith("part-")]
            assert json.loads("".join(texts)) == rows


def test_export_of_no_hits_writes_nothing(spark, tmp_path, rows_ds):
    hits = search.search(rows_ds, "no such text anywhere")
    target = str(tmp_path / "none")
    assert export(hits, target, "jsonl") is False
    assert not os.path.exists(target)


def test_pager_navigation():
    p = paging.Pager(total=250, page_size=100)
    assert (p.pages, p.index) == (3, 0)
    assert p.previous() == 0 and p.next() == 1 and p.next() == 2 and p.next() == 2
    assert p.first() == 0 and p.last() == 2 and p.jump(2) == 1 and p.jump(99) == 2 and p.jump(0) == 0
    assert paging.Pager(0, 25).pages == 1 and paging.Pager(251, 100, 7).bounds == (201, 300)


def test_search_results_are_kept_for_paging(spark, tmp_path):
    path = str(tmp_path / "docs2")
    os.makedirs(path)
    for i in range(3):
        ids = list(range(i * 10, i * 10 + 10))
        pq.write_table(pa.table({"id": ids, "text": [f"r{k} {'hit' if k % 4 == 0 else ''}" for k in ids]}),
                       f"{path}/p{i}.parquet")
    res = search.SearchResults(open_dataset(spark, path), "HIT")
    assert res.count() == 8
    pages = [[r["id"] for r in res.page(i, 3).orderBy("__match_no").collect()] for i in range(4)]
    assert pages == [[0, 4, 8], [12, 16, 20], [24, 28], [24, 28]]


def test_json_search_follows_each_rows_key_order(spark, tmp_path):
    p = str(tmp_path / "order.jsonl")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write('{"a": "x", "b": "y"}\n{"b": "y", "a": "x"}\n{"a": null}\n')
    ds = open_dataset(spark, p)
    rows = ds.rows_between(1, 3)
    hit = lambda q, **kw: sorted(r["__row_no"] for r in rows.where(search.match_condition(ds, q, **kw)).collect())
    assert hit("a x b y", match_names=True) == [1]
    assert hit("b y a x", match_names=True) == [2]
    assert hit("a none", match_names=True, match_nulls=True) == [3]
    assert hit("none") == []


def test_all_column_search_over_variant_column(spark, tmp_path):
    p = str(tmp_path / "mixed.jsonl")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write('{"id": 1, "conv": [{"from": "user", "value": "Hello"}]}\n{"id": 2, "conv": "plain"}\n')
    ds = open_dataset(spark, p)
    assert sorted(r["id"] for r in search.search(ds, "user: hello").collect()) == [1]
    assert sorted(r["id"] for r in search.search(ds, "conv plain", match_names=True).collect()) == [2]


def test_search_pages_across_buckets(spark, tmp_path, monkeypatch):
    """Tiny buckets: page ranks continue across bucket and file boundaries."""
    monkeypatch.setattr(search, "BUCKET_ROWS", 4)
    path = str(tmp_path / "buckets")
    os.makedirs(path)
    for i in range(5):
        ids = list(range(i * 7, i * 7 + 7))
        pq.write_table(pa.table({"id": ids, "text": ["hit" if k % 2 == 0 else "miss" for k in ids]}),
                       f"{path}/p{i}.parquet")
    ds = open_dataset(spark, path)
    want = [k for k in range(35) if k % 2 == 0]
    got = []
    for p in range(4):
        page = search.search_page(ds, "hit", p, 5).orderBy("__match_no").collect()
        assert [r["__match_no"] for r in page] == list(range(p * 5 + 1, min(len(want), p * 5 + 5) + 1))
        got += [r["id"] for r in page]
    assert got == want


def test_capped_search_is_exact_without_top_k(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BUCKET_ROWS", 4)
    path = str(tmp_path / "cap")
    os.makedirs(path)
    for i in range(4):
        ids = list(range(i * 9, i * 9 + 9))
        pq.write_table(pa.table({"id": ids, "text": ["hit" if k % 3 else "x" for k in ids]}), f"{path}/p{i}.parquet")
    ds = open_dataset(spark, path)
    capped = search.search(ds, "hit", column="text", max_results=10)
    assert sorted(r["id"] for r in capped.collect()) == [k for k in range(36) if k % 3][:10]
    assert "TakeOrderedAndProject" not in capped._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few, listed", [(64, 1000), (0, 0)])
def test_pages_by_conditions_and_by_joins_agree(spark, tmp_path, monkeypatch, few, listed):
    """The rows of a page are the same whether its scan units are few enough to be conditions or not."""
    import json

    from shardlens import open_dataset
    from shardlens.operators import search
    from shardlens.sources import dataset as D

    monkeypatch.setattr(D, "FEW", few)
    monkeypatch.setattr(search, "LISTED", listed)
    for i in range(6):
        (tmp_path / f"f{i}.jsonl").write_text("".join(json.dumps({"i": i * 40 + k, "t": "hit" if k % 7 == 0 else "no"}) + "\n" for k in range(40)))
    text = open_dataset(spark, str(tmp_path), strict=False)
    spark.range(0, 240).repartitionByRange(5, "id").selectExpr("id AS i", "IF(id % 40 % 7 = 0, 'hit', 'no') AS t").sortWithinPartitions("i").write.parquet(str(tmp_path / "p"))
    for ds in (text, open_dataset(spark, str(tmp_path / "p"))):
        for first, last in ((1, 240), (39, 42), (100, 100), (200, 300), (241, 250)):
            got = sorted((r["__row_no"], r["i"]) for r in ds.rows_between(first, last).collect())
            assert got == [(n + 1, n) for n in range(first - 1, min(last, 240))]
        assert sorted(r["i"] for r in ds.rows_between(5, 200, [5, 77, 200]).collect()) == [4, 76, 199]
        hits = [n for n in range(240) if n % 40 % 7 == 0]
        for page in (0, 1, 3, 99):
            rows = search.search_page(ds, "hit", page, 10, column="t").orderBy("__match_no").collect()
            at = min(page, 3) * 10
            assert [(r["__match_no"], r["i"]) for r in rows] == [(at + k + 1, n) for k, n in enumerate(hits[at:at + 10])]


def test_search_pages_over_many_bitmaps(spark, monkeypatch):
    """Matches in several bitmaps and stretches of bitmaps; the condition is evaluated in one scan."""
    from shardlens.operators import search
    from shardlens.sources.dataset import from_frame

    monkeypatch.setattr(search, "STRETCH", 2)
    ds = from_frame(spark, spark.range(0, 300_000, 1, 4).selectExpr("id", "IF(id % 9973 = 5, 'needle', 'hay') AS t"))
    want = [n for n in range(300_000) if n % 9973 == 5]
    for page in range(4):
        rows = search.search_page(ds, "needle", page, 9, column="t").orderBy("__match_no").collect()
        assert [(r["__match_no"], r["id"]) for r in rows] == [(page * 9 + k + 1, n) for k, n in enumerate(want[page * 9:page * 9 + 9])]
    assert search.search_page(ds, "needle", 0, 9, column="t", max_results=4).count() == 4
    assert search.search_page(ds, "absent", 0, 9, column="t").count() == 0
    assert search.match_bitmaps(ds, F.col("t") == "needle").count() == 10


def test_hits_are_numbered_by_many_tasks(spark):
    """However the hits lie, no task gets all of their rows."""
    from shardlens.operators.paging import number_rows

    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in names}
    spark.conf.set(names[0], "false")
    try:
        hits = spark.range(1, 200_001).selectExpr("id * 2 AS at")
        rows = number_rows(hits, "at", "no").select("at", "no", F.spark_partition_id().alias("p"))
        got = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("no") * 2 - F.col("at"))).alias("off")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["n"] for r in got) == 200_000 and not any(r["off"] for r in got)
    assert max(r["n"] for r in got) < 150_000
