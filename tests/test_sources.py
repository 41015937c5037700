"""Source discovery (S1), readers (S2-S6, S11) and field resolution on ragged rows."""

import json
import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shardlens import DatasetError, open_dataset
from shardlens.operators import paging, schema
from shardlens.operators.resolve import resolve_apply
from shardlens.functions.fields import TEXT_ALIASES_REPORT
from shardlens.functions.render import render


def _write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, encoding="utf-8") as fh:
        fh.write(text)


def _parquet(path, table):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(table, path)


# ---------------------------------------------------------------------- S1

def test_missing_path(spark, tmp_path):
    with pytest.raises(DatasetError, match="nothing is stored"):
        open_dataset(spark, str(tmp_path / "nope"))


def test_unknown_suffix(spark, tmp_path):
    _write(str(tmp_path / "a.txt"), "x")
    with pytest.raises(DatasetError, match="can be opened"):
        open_dataset(spark, str(tmp_path / "a.txt"))


def test_empty_folder(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(DatasetError, match="holds no Parquet"):
        open_dataset(spark, str(tmp_path / "empty"))


def test_two_json_files(spark, tmp_path):
    _write(str(tmp_path / "d" / "a.jsonl"), '{"x": 1}\n')
    _write(str(tmp_path / "d" / "b.json"), '[{"x": 2}]')
    with pytest.raises(DatasetError, match="several JSON or CSV"):
        open_dataset(spark, str(tmp_path / "d"))


def test_parquet_wins_over_json(spark, tmp_path):
    _parquet(str(tmp_path / "m" / "sub" / "p.parquet"), pa.table({"text": ["a", "b"]}))
    _write(str(tmp_path / "m" / "x.jsonl"), '{"text": "z"}\n')
    ds = open_dataset(spark, str(tmp_path / "m"))
    assert ds.kind == "parquet" and ds.count() == 2


def test_one_json_in_folder(spark, tmp_path):
    _write(str(tmp_path / "one" / "rows.JSONL"), '{"a": 1}\n{"a": 2}\n')
    ds = open_dataset(spark, str(tmp_path / "one"))
    assert ds.kind == "jsonl" and ds.count() == 2


# ---------------------------------------------------------------------- shards

def test_shards_pages_and_counts(spark, tmp_path):
    base = tmp_path / "sh"
    _parquet(str(base / "a b" / "s 0.parquet"), pa.table({"id": [0, 1, 2], "text": ["t0", "t1", "t2"]}))
    _parquet(str(base / "a b" / "s 1.parquet"), pa.table({"id": pa.array([], pa.int64()),
                                                          "text": pa.array([], pa.string())}))
    _parquet(str(base / "a-b" / "s.parquet"), pa.table({"id": [3, 4], "text": ["t3", "t4"]}))
    _parquet(str(base / "c" / "s.parquet"), pa.table({"id": [5, 6, 7, 8], "text": ["t5", "t6", "t7", "t8"]}))
    ds = open_dataset(spark, str(base))
    assert ds.count() == 9
    # Path order compares components: "a b" < "a-b" < "c".
    order = [r["id"] for r in ds.positioned().orderBy("__row_no").collect()]
    assert order == list(range(9))
    pages = [sorted(r["id"] for r in ds.page(i, 2).collect()) for i in range(5)]
    assert pages == [[0, 1], [2, 3], [4, 5], [6, 7], [8]]
    assert [r["id"] for r in ds.page(99, 2).collect()] == [8]  # clamped to the last page
    man = {"/".join(r["path"].split("/")[-2:]): (r["rows"], r["bytes"] > 0)
           for r in schema.file_manifest(ds).collect()}
    assert man == {"a b/s 0.parquet": (3, True), "a b/s 1.parquet": (0, True), "a-b/s.parquet": (2, True),
                   "c/s.parquet": (4, True)}
    assert sum(r["rows"] for r in schema.file_manifest(ds).collect()) == 9
    shards = paging.shard_ranges(ds).orderBy("shard_no").collect()
    assert [(r["start"], r["rows"]) for r in shards] == [(0, 3), (3, 2), (5, 4)]
    labels = {r["id"]: r["__shard"] for r in ds.positioned().collect()}
    assert labels[0] == "s 0.parquet" and labels[5] == "s.parquet"


def test_schema_drift_found_before_read(spark, tmp_path):
    base = tmp_path / "drift"
    _parquet(str(base / "p0.parquet"), pa.table({"id": [1, 2], "text": ["a", "b"]}))
    _parquet(str(base / "p1.parquet"), pa.table({"id": ["3"], "text": ["c"]}))
    rows = {r["column"]: (r["n_types"], r["consistent"]) for r in schema.schema_drift(spark, str(base)).collect()}
    assert rows == {"id": (2, False), "text": (1, True)}


# ---------------------------------------------------------------------- JSONL

def test_jsonl_rules(spark, tmp_path):
    lines = ["﻿" + json.dumps({"text": "hello", "n": 1}), "", "   ", "[1, 2]", '"just text"',
             json.dumps({"n": 2, "content": "c", "extra": True}), json.dumps({"text": None, "content": "x"})]
    p = str(tmp_path / "x.jsonl")
    _write(p, "\n".join(lines) + "\n")
    ds = open_dataset(spark, p)
    assert ds.columns == ["text", "n", "value", "content", "extra"]
    assert ds.count() == 5
    text = resolve_apply(ds, TEXT_ALIASES_REPORT, lambda c, dt: F.when(c.isNotNull(), render(c, dt)), F.lit(None))
    got = [r["t"] for r in ds.rows_between(1, 5).orderBy("__row_no").select(text.alias("t")).collect()]
    # Row 5 has "text": null — the lookup stops there.
    assert got == ["hello", None, None, "c", None]
    types = {r["column_name"]: r["type_name"] for r in schema.column_types(ds).collect()}
    assert types["text"] == "str" and types["n"] == "int" and types["extra"] == "bool"
    assert types["value"] in ("list", "str")


def test_jsonl_bad_line_fails(spark, tmp_path):
    p = str(tmp_path / "bad.jsonl")
    _write(p, '{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        open_dataset(spark, p).df.collect()


# ---------------------------------------------------------------------- JSON documents

@pytest.mark.parametrize("doc,n", [
    ([{"a": 1}, {"a": 2}, 3], 3),
    ({"data": [{"a": 1}, {"a": 2}]}, 2),
    ({"rows": [{"a": 1}]}, 1),
    ({"data": [{"a": 1}], "rows": [{"a": 1}, {"a": 2}]}, 1),
    ({"a": 1, "b": 2}, 1),
])
def test_json_document_shapes(spark, tmp_path, doc, n):
    p = str(tmp_path / "d.json")
    _write(p, "﻿" + json.dumps(doc))
    ds = open_dataset(spark, p)
    assert ds.count() == n


# ---------------------------------------------------------------------- CSV

def test_csv_rules(spark, tmp_path):
    p = str(tmp_path / "t.csv")
    _write(p, 'id,text,id\n1,"multi\nline ""q""",x\n2,,y\n3,"",z\n4,short\n')
    ds = open_dataset(spark, p)
    assert ds.columns == ["id", "text"]
    rows = [tuple(r) for r in ds.rows_between(1, 10).orderBy("__row_no").select("id", "text").collect()]
    # The later duplicate header wins; empty fields read as ''; a missing trailing field is null.
    assert rows == [("x", 'multi\nline "q"'), ("y", ""), ("z", ""), (None, "short")]


def test_wide_integers_stay_whole(spark, tmp_path):
    from shardlens.operators import search

    p = str(tmp_path / "w.jsonl")
    _write(p, '{"n": 12345678901234567890}\n{"n": 7}\n')
    ds = open_dataset(spark, p)
    assert [r["t"] for r in ds.base.select(render(F.col("n"), ds.schema["n"].dataType).alias("t")).collect()] == ["12345678901234567890", "7"]
    assert search.search(ds, "12345678901234567890").count() == 1


@pytest.mark.parametrize("line", ['{"a":1} {"a":2}', "[1] garbage", "1, 2"])
def test_content_after_the_value_fails(spark, tmp_path, line):
    p = str(tmp_path / "b.jsonl")
    _write(p, '{"a": 1}\n' + line + "\n")
    with pytest.raises(Exception):
        open_dataset(spark, p).df.collect()


def test_ragged_messages(spark, tmp_path):
    rows = [{"m": [{"from": "a", "value": "x"}, {"role": "b", "content": "y"}]}, {"m": [{"role": "c", "content": "z"}]},
            {"m": [{"from": "d"}, {"note": {"k": 1}}]}]
    p = str(tmp_path / "r.jsonl")
    _write(p, "\n".join(json.dumps(r) for r in rows) + "\n")
    ds = open_dataset(spark, p)
    got = [r["t"] for r in ds.base.select(render(F.col("m"), ds.schema["m"].dataType).alias("t"), "__local").orderBy("__local").collect()]
    assert got[:2] == ["a: x\n\nb: y", "c: z"]
    assert got[2] == 'd: {\n  "from": "d"\n}\n\nmessage: {\n  "note": {\n    "k": 1\n  }\n}'


def test_mixed_conversations_render_like_typed(spark, tmp_path):
    rows = [{"id": 1, "conversation": [{"from": "user", "value": "hi"}, {"role": "bot", "content": "yo"}]},
            {"id": 2, "conversation": "plain text"},
            {"id": 3, "conversation": [{"from": "a", "value": None, "content": "x"}]},
            {"id": 4, "conversation": {"role": "assistant", "content": "ok"}},
            {"id": 5, "conversation": [1, "two", None]}]
    p = str(tmp_path / "v.jsonl")
    _write(p, "\n".join(json.dumps(r) for r in rows) + "\n")
    ds = open_dataset(spark, p)
    text = resolve_apply(ds, TEXT_ALIASES_REPORT, lambda c, dt: render(c, dt), F.lit(""))
    got = {r["id"]: r["t"] for r in ds.base.select("id", text.alias("t")).collect()}
    assert got == {1: "user: hi\n\nbot: yo", 2: "plain text", 3: "a: a: x", 4: "assistant: ok",
                   5: "1\n\ntwo\n\nNone"}
    from shardlens.operators import search as S
    assert sorted(r["id"] for r in S.search(ds, "bot: yo", column="conversation").collect()) == [1]


def _jsonl(spark, tmp_path, lines):
    p = str(tmp_path / "raw.jsonl")
    _write(p, "\n".join(lines) + "\n")
    return open_dataset(spark, p)


def test_nested_keys_as_written(spark, tmp_path):
    """Order, nulls and absence of keys at every depth: in previews, displays, exports and rendering."""
    lines = ['{"m": {"z": 1, "a": null}}', '{"m": {"a": [{"q": null, "b": 2}, {"b": {}}], "z": 5}}', '{"m": {}}', '{"m": null}', '{}',
             '{"m": {"z": 1.0, "a": [], "y": 1e2}}']
    ds = _jsonl(spark, tmp_path, lines)
    from shardlens.functions.render import preview_source, py_json
    rows = [json.loads(line) for line in lines]
    m = F.col("m")
    got = ds.positioned().orderBy("__row_no").select(preview_source(m, ds.schema["m"].dataType).alias("p"), py_json(m, ds.schema["m"].dataType, 2).alias("j")).collect()
    assert [r["p"] for r in got] == ["" if r.get("m") is None else json.dumps(r["m"]) for r in rows]
    assert [r["j"] for r in got] == [json.dumps(r.get("m"), indent=2) for r in rows]
    from shardlens.sources.sinks import export
    out = str(tmp_path / "out")
    export(ds.positioned().coalesce(1), out, "jsonl", ds, order_col="__row_no")
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == sorted(json.dumps(r) for r in rows)


def test_messages_with_null_and_absent_fields(spark, tmp_path):
    lines = ['{"m": [{"from": "a", "value": null, "content": "x"}, {"role": "b", "content": "y"}]}', '{"m": [{"from": "c", "content": "z", "value": "v"}, null, 7, 2.5, "t"]}']
    ds = _jsonl(spark, tmp_path, lines)
    got = [r["t"] for r in ds.positioned().orderBy("__row_no").select(render(F.col("m"), ds.schema["m"].dataType).alias("t")).collect()]
    assert got == ["a: a: x\n\nb: y", "c: v\n\nNone\n\n7\n\n2.5\n\nt"]


def test_numbers_as_written(spark, tmp_path):
    from shardlens.functions.render import py_str

    ds = _jsonl(spark, tmp_path, ['{"n": 1, "l": [1, 2.5, -0, 12345678901234567890]}', '{"n": 2.5}', '{"n": 1e2}', '{"n": null}', '{"n": 3.0, "l": []}'])
    got = [tuple(r) for r in ds.positioned().orderBy("__row_no").select(*[py_str(F.col(c), ds.schema[c].dataType).alias(c) for c in ("n", "l")]).collect()]
    assert got == [("1", "[1, 2.5, 0, 12345678901234567890]"), ("2.5", "None"), ("100.0", "None"), (None, "None"), ("3.0", "[]")]
    types = {r["column_name"]: r["type_name"] for r in schema.column_types(ds).collect()}
    assert types == {"n": "int", "l": "list"}  # of the first value


def test_of_repeated_keys_the_last_counts(spark, tmp_path):
    ds = _jsonl(spark, tmp_path, ['{"a": 1, "b": 2, "a": 3}', '{"b": {"x": 1, "x": 2}}'])
    assert ds.columns == ["a", "b"]
    assert ds.df.select(F.col("a").cast("string")).orderBy("a").collect()[-1][0] == "3"
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_a_line_may_not_close_what_it_does_not_open(spark, tmp_path):
    for line in ('{"a":1}],[2', '{"a": 1}] garbage', '1}, {"b": 2'):
        with pytest.raises(Exception):
            _jsonl(spark, tmp_path, ['{"a": [1]}', line])


def test_ids_as_keys_are_one_map(spark, tmp_path, monkeypatch):
    """More keys than can be columns: none are collected, rows, pages and searches work."""
    from shardlens.operators import search
    from shardlens.sources import readers

    monkeypatch.setattr(readers, "KEY_LIMIT", 100)
    ds = _jsonl(spark, tmp_path, [json.dumps({f"id{i}": i, f"id{i + 1}": {"x": f"v{i}"}}) for i in range(300)])
    assert ds.columns == ["fields"] and ds.count() == 300
    assert [r["fields"] for r in ds.rows_between(7, 7).collect()] == [{"id6": "6", "id7": '{"x":"v6"}'}]
    assert search.search(ds, "v123").count() == 1
    (tmp_path / "o.json").write_text(json.dumps({f"id{i}": [i] for i in range(1000)}))
    ds = open_dataset(spark, str(tmp_path / "o.json"))
    assert ds.columns == ["fields"] and ds.df.select(F.size("fields")).first()[0] == 1000


def test_json_document_keeps_key_order(spark, tmp_path):
    p = str(tmp_path / "k.json")
    _write(p, '{"data": [{"zeta": 1, "alpha": "a"}, {"mid": null, "zeta": 2}, "x"]}')
    ds = open_dataset(spark, p)
    assert ds.columns == ["zeta", "alpha", "mid", "value"]
    assert [tuple(r) for r in ds.rows_between(1, 3).orderBy("__row_no").select("zeta", "alpha", "value").collect()] == [
        (1, "a", None), (2, None, None), (None, None, "x")]


def test_csv_malformed_rows_reported(spark, tmp_path):
    from shardlens.operators.schema import malformed_rows
    p = str(tmp_path / "m.csv")
    _write(p, "a,b\n1,2\n3\n4,5,6\n")
    ds = open_dataset(spark, p)
    assert ds.columns == ["a", "b", "None"]  # fields beyond the header are a list of their own
    assert [tuple(r) for r in ds.df.collect()] == [("1", "2", None), ("3", None, None), ("4", "5", ["6"])]
    got = sorted((r["row_no"], r["record"]) for r in malformed_rows(ds).collect())
    assert got == [(2, "3"), (3, "4,5,6")]


def test_case_duplicate_columns_raise(spark, tmp_path):
    p = str(tmp_path / "case.jsonl")
    _write(p, '{"Text": "a", "text": "b"}\n')
    with pytest.raises(DatasetError, match="differ only by case"):
        open_dataset(spark, p)


def test_check_schema_refuses_drift(spark, tmp_path):
    from shardlens.operators.profile import quality_report
    base = tmp_path / "drift2"
    _parquet(str(base / "p0.parquet"), pa.table({"id": [1], "text": ["a"]}))
    _parquet(str(base / "p1.parquet"), pa.table({"id": ["2"], "text": ["b"]}))
    with pytest.raises(DatasetError, match="id: int64, string"):
        open_dataset(spark, str(base), check_schema=True)
    good = tmp_path / "good"
    _parquet(str(good / "p0.parquet"), pa.table({"id": [1], "text": ["a"]}))
    _parquet(str(good / "p1.parquet"), pa.table({"id": [2], "text": ["a"]}))
    r = quality_report(open_dataset(spark, str(good), check_schema=True)).first()
    assert (r["schema_consistent"], r["source_modified"], r["duplicate_texts"]) == (True, False, 1)


def test_positions_over_many_files(spark, tmp_path):
    base = tmp_path / "many"
    for i in range(7):
        _parquet(str(base / f"f{i}.parquet"), pa.table({"x": list(range(i * 5, i * 5 + 5))}))
    ds = open_dataset(spark, str(base))
    assert sorted((r["__row_no"], r["x"]) for r in ds.positioned().collect()) == [(x + 1, x) for x in range(35)]
    assert [r["x"] for r in ds.page(3, 4).orderBy("__row_no").collect()] == [12, 13, 14, 15]
    assert "row_index" not in ds.counts._jdf.queryExecution().executedPlan().toString()


def test_pruned_text_files_are_split_otherwise(spark, tmp_path):
    """Which files a scan selects changes how Spark splits them; no row may be lost or numbered twice."""
    base = tmp_path / "jl"
    for i in range(16):
        _write(str(base / f"f{i:02d}.jsonl"), "".join(json.dumps({"i": i * 500 + k, "t": "w" * 40}) + "\n" for k in range(500)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        for most in ("128m", "7000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            ds = open_dataset(spark, str(base), strict=False)
            assert sorted((r["__row_no"], r["i"]) for r in ds.positioned().select("__row_no", "i").collect()) == [(n + 1, n) for n in range(8000)]
            for first, last in ((1, 8000), (400, 1700), (7990, 8000), (501, 501)):
                got = sorted((r["__row_no"], r["i"]) for r in ds.rows_between(first, last).select("__row_no", "i").collect())
                assert got == [(n + 1, n) for n in range(first - 1, last)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_text_page_reads_its_files_only(spark, tmp_path):
    base = tmp_path / "jl"
    for i in range(400):
        _write(str(base / f"f{i:04d}.jsonl"), json.dumps({"i": 2 * i}) + "\n" + json.dumps({"i": 2 * i + 1}) + "\n")
    ds = open_dataset(spark, str(base), strict=False)
    page = ds.page(20, 10)
    assert [r["i"] for r in page.orderBy("__row_no").collect()] == list(range(200, 210))
    assert ds.rows_between(1, 800).count() == 800
    scans = re.findall(r"FileScan text .*", page._jdf.queryExecution().executedPlan().toString())
    assert scans and all("file_path" in scan for scan in scans)  # the condition on the path prunes the listing


def test_hidden_data_files_are_refused(spark, tmp_path):
    base = tmp_path / "hidden"
    _parquet(str(base / "a.parquet"), pa.table({"x": [1]}))
    _parquet(str(base / "_x.parquet"), pa.table({"x": [2]}))
    with pytest.raises(DatasetError, match="_x.parquet"):
        open_dataset(spark, str(base))


@pytest.mark.parametrize("names, kind, strict", [
    (("a.jsonl", "_b.jsonl"), None, True), (("a.jsonl", ".b.JSONL"), None, False), (("a.csv", "sub/.c.csv"), None, True),
    (("a.json", "_sub/b.json"), None, True), (("a.jsonl", "_b.jsonl"), "jsonl", True), (("_a.jsonl",), None, True),
])
def test_hidden_files_of_any_kind_are_refused(spark, tmp_path, names, kind, strict):
    """Spark would leave them out without a word."""
    for name in names:
        _write(str(tmp_path / "h" / name), '{"a": 1}\n')
    hidden = re.escape(names[-1].split("/")[-1])
    with pytest.raises(DatasetError, match=hidden):
        open_dataset(spark, str(tmp_path / "h"), strict=strict, kind=kind)
    with pytest.raises(DatasetError, match="_a.jsonl"):
        _write(str(tmp_path / "_a.jsonl"), "{}\n")
        open_dataset(spark, str(tmp_path / "_a.jsonl"))


def test_bookkeeping_of_writers_is_not_data(spark, tmp_path):
    spark.range(3).write.json(str(tmp_path / "w"))
    _write(str(tmp_path / "w" / "_temporary" / "0" / "part-9.json"), "{}\n")
    assert open_dataset(spark, str(tmp_path / "w")).count() == 3


def test_nested_folders_of_one_kind_are_read_whole(spark, tmp_path):
    for i, name in enumerate(("a.jsonl", "x/b.JSONL", "x/y/c.jsonl")):
        _write(str(tmp_path / "n" / name), json.dumps({"i": i}) + "\n")
    _write(str(tmp_path / "n" / "README.md"), "no data\n")
    ds = open_dataset(spark, str(tmp_path / "n"), strict=False)
    assert sorted(r["i"] for r in ds.df.collect()) == [0, 1, 2]


def test_walk_of_many_files(spark, tmp_path):
    """Tasks list the folders; the driver makes no call a file."""
    import time

    from shardlens.sources.files import hidden_files, walk

    for i in range(3000):
        path = tmp_path / "many" / f"d{i % 30}" / f"f{i}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.touch()
    (tmp_path / "many" / "d7" / ".h.jsonl").touch()
    found = walk(spark, str(tmp_path / "many"))
    assert found.filter("NOT folder").count() == 3001 and found.filter("folder").count() == 30
    start = time.time()
    assert hidden_files(spark, str(tmp_path / "many"), (".jsonl",)) == [str(tmp_path / "many" / "d7" / ".h.jsonl")]
    assert time.time() - start < 10


def test_sorted_frame_keeps_its_rows_and_order(spark):
    from shardlens.sources.dataset import from_frame

    frame = spark.range(60000).repartition(40).withColumnRenamed("id", "n").orderBy("n")
    ds = from_frame(spark, frame)
    assert ds.positioned().filter("__row_no = n + 1").count() == 60000 == ds.count()


def test_text_pages_across_many_splits(spark, tmp_path):
    """A JSONL file cut into many scan splits: pages and positions follow line order."""
    p = str(tmp_path / "big.jsonl")
    _write(p, "".join(json.dumps({"i": i, "text": "w" * (i % 37)}) + "\n" for i in range(300)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        ds = open_dataset(spark, p)
        assert ds.ranges().count() > 5  # several splits
        for page in (0, 3, 7, 11):
            got = [r["i"] for r in ds.page(page, 25).orderBy("__row_no").collect()]
            assert got == list(range(page * 25, min(300, page * 25 + 25)))
        full = sorted((r["__row_no"], r["i"]) for r in ds.positioned().collect())
        assert full == [(i + 1, i) for i in range(300)]
        csv_path = str(tmp_path / "big.csv")
        _write(csv_path, "i,t\n" + "".join(f"{i},x{i}\n" for i in range(300)))
        cds = open_dataset(spark, csv_path)
        assert [r["i"] for r in cds.page(5, 25).orderBy("__row_no").collect()] == [str(i) for i in range(125, 150)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pages_with_glob_characters_in_file_names(spark, tmp_path):
    base = tmp_path / "glob"
    _parquet(str(base / "a[1].parquet"), pa.table({"x": [1, 2]}))
    _parquet(str(base / "b{2}*.parquet"), pa.table({"x": [3]}))
    ds = open_dataset(spark, str(base))
    assert [r["x"] for r in ds.page(0, 25).orderBy("__row_no").collect()] == [1, 2, 3]
    assert [r["x"] for r in ds.rows_between(3, 3).collect()] == [3]


def test_csv_header_names_as_written(spark, tmp_path):
    p = str(tmp_path / "h.csv")
    _write(p, "a,a1,b\n1,2,3\n")
    ds = open_dataset(spark, p)
    assert ds.columns == ["a", "a1", "b"]
    assert [tuple(r) for r in ds.df.collect()] == [("1", "2", "3")]


def test_csv_files_with_other_headers_fail(spark, tmp_path):
    _write(str(tmp_path / "c" / "a.csv"), "id,text\n1,hello\n")
    _write(str(tmp_path / "c" / "b.csv"), "text,id\nworld,2\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|header"):
        open_dataset(spark, str(tmp_path / "c"), strict=False).df.collect()


def test_csv_with_byte_order_mark(spark, tmp_path):
    p = str(tmp_path / "bom.csv")
    with open(p, "w", encoding="utf-8-sig") as fh:
        fh.write("id,text\n1,x\n")
    ds = open_dataset(spark, p)
    assert ds.columns == ["id", "text"]
    assert [tuple(r) for r in ds.df.collect()] == [("1", "x")]


def test_schema_drift_with_spaces_in_paths(spark, tmp_path):
    base = tmp_path / "with space"
    _parquet(str(base / "a b.parquet"), pa.table({"id": [1]}))
    _parquet(str(base / "c d.parquet"), pa.table({"id": [2]}))
    rows = {r["column"]: (r["n_types"], r["files"], r["consistent"]) for r in schema.schema_drift(spark, str(base)).collect()}
    assert rows == {"id": (1, 2, True)}
    assert open_dataset(spark, str(base)).count() == 2


def test_text_positions_over_several_files(spark, tmp_path):
    jl, cs, js = tmp_path / "jl", tmp_path / "cs", tmp_path / "js"
    for i in range(5):
        _write(str(jl / f"part-{i}.jsonl"), "".join(json.dumps({"i": i * 10 + k}) + "\n" for k in range(10)))
        _write(str(cs / f"part-{i}.csv"), "i\n" + "".join(f"{i * 10 + k}\n" for k in range(10)))
        _write(str(js / f"part-{i}.json"), json.dumps([{"i": i * 10 + k} for k in range(10)]))
    for folder, kind in ((jl, "jsonl"), (cs, None), (js, "json")):
        ds = open_dataset(spark, str(folder), strict=False, kind=kind)
        got = sorted((r["__row_no"], int(r["i"])) for r in ds.positioned().collect())
        assert got == [(n + 1, n) for n in range(50)], folder
