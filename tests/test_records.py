"""Records of JSON documents and CSV files cut over many splits, against Python's own parsers."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from shardlens import open_dataset
from shardlens.sources.records import _CLOSED, csv_after, csv_lines, csv_records, json_records, pieces


@pytest.fixture()
def splits(spark):
    """Cut files into splits of so many bytes."""
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    old = {k: spark.conf.get(k) for k in names}

    def of(size):
        spark.conf.set(names[0], "1")
        spark.conf.set(names[1], str(size))
    yield of
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def in_order(frame, column):
    return [r[column] for r in frame.orderBy("__path", "__block", "__local").collect()]


def some_value(r, depth=0):
    kind = r.randrange(9 if depth < 3 else 6)
    if kind < 3:
        return "".join(r.choice(['a', 'b', ',', '"', '\\', '[', ']', '{', '}', ' ', 'é', '漢', '\n', ':', '\\"', "data"]) for _ in range(r.randrange(12)))
    if kind < 6:
        return r.choice([0, 1.5, -3, True, False, None, 10 ** 20])
    if kind < 8:
        return {r.choice(["a", "b,c", "data", "rows", 'q"', "x\\"]): some_value(r, depth + 1) for _ in range(r.randrange(4))}
    return [some_value(r, depth + 1) for _ in range(r.randrange(4))]


def documents():
    r = random.Random(7)
    rows = [some_value(r) for _ in range(60)]
    lists = [some_value(r) for _ in range(25)]
    yield rows, json.dumps(rows)
    yield rows, "\n " + json.dumps(rows, indent=2, ensure_ascii=False) + " \n"
    yield lists, json.dumps({"x": [1, [2], {"data": [9, 9]}], "data": lists, "rows": [5], "z": [[1, 2], [3, "]"]]}, ensure_ascii=False)
    yield lists, json.dumps({"rows": lists, "data": 5, "after": "data"}, indent=1)
    yield lists, '{"data": [1, 2], "\\u0064ata" : ' + json.dumps(lists) + "}"  # the last of repeated keys counts
    yield [{"data": {"a": [1, 2]}, "other": lists}], json.dumps({"data": {"a": [1, 2]}, "other": lists})
    yield [], "[]"
    yield [], ' { "data" : [ ] , "rows": [1] } '
    yield ["a, b"], '"a, b"'
    yield [5], "5"
    yield [[]], "[[]]"
    yield [{}], "{}"


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_json_documents_against_json(spark, tmp_path, splits, size):
    splits(size)
    want = []
    for number, (rows, text) in enumerate(documents()):
        _write(tmp_path / f"d{number:02d}.json", ("\ufeff" if number % 2 else "") + text)
        want += rows
    assert [json.loads(t) for t in in_order(json_records(spark, str(tmp_path)), "__line")] == want


def test_several_documents_and_positions(spark, tmp_path, splits):
    splits(400)
    for i in range(4):
        _write(tmp_path / f"f{i}.json", json.dumps([{"i": i * 50 + k, "t": "," * (k % 9) + '"}]'} for k in range(50)]))
    ds = open_dataset(spark, str(tmp_path), strict=False)
    rows = ds.positioned().select("__row_no", "i").collect()
    assert sorted((r["__row_no"], r["i"]) for r in rows) == [(n + 1, n) for n in range(200)]
    assert [r["i"] for r in ds.page(3, 30).orderBy("__row_no").collect()] == list(range(90, 120))
    assert ds.ranges().count() > 10


def test_one_list_is_read_by_several_tasks(spark, tmp_path, splits):
    splits(40_000)
    path = _write(tmp_path / "one.json", json.dumps([{"n": i, "text": "word, " * 20} for i in range(3000)]))
    assert pieces(spark, path, ",").select(F.spark_partition_id().alias("p")).distinct().count() > 10
    ds = open_dataset(spark, path)
    assert ds.count() == 3000 and ds.df.agg(F.sum("n")).first()[0] == sum(range(3000))


@pytest.mark.parametrize("size", [150, 1000])
def test_parts_of_an_exported_array(spark, tmp_path, splits, size):
    """What stands behind a part's last comma is no record, wherever the split of it starts; an empty item is still refused."""
    splits(size)
    rows = [{"i": i, "t": 'a, "b"]' * (i % 3)} for i in range(30)]
    for n in range(3):
        items = "".join("  " + json.dumps(row) + ",\n" for row in rows[10 * n:10 * n + 10])
        _write(tmp_path / f"part-{n}.txt", ("[\n" if n == 0 else "") + (items if n < 2 else items[:-2] + "\n]\n"))
    ds = open_dataset(spark, str(tmp_path), kind="json")
    assert ds.count() == 30 and [r["i"] for r in ds.positioned().orderBy("__row_no").collect()] == list(range(30))
    _write(tmp_path / "part-1.txt", '  {"i": 1},\n,\n  {"i": 2},\n')
    with pytest.raises(Exception):
        open_dataset(spark, str(tmp_path), kind="json").df.collect()


@pytest.mark.parametrize("text, size", [("[1, 2", 1000), ("[1, 2] 3", 4), ("[1,, 2]", 1000), ("[1, ]", 1000), ('{"a": 1} x', 1000), ('[{"a": 1}}', 6), ("[1 2]", 1000)])
def test_broken_documents_fail(spark, tmp_path, splits, text, size):
    splits(size)
    with pytest.raises(Exception):
        open_dataset(spark, _write(tmp_path / "b.json", text)).df.collect()


def some_csv(r, rows):
    field = lambda: r.choice(["", "a", "long field", '"q"', '"a,b"', '"multi\nline"', '"say ""hi"""', '"\r\n"', 'in"ner', '"x"tail', "é漢", '""', ' "no quote"'])
    end = r.choice(["\n", "\r\n"])
    lines = ["id,text,id"] + [",".join(field() for _ in range(r.choice([3, 3, 3, 1, 2, 5]))) for _ in range(rows)]
    return end.join(lines) + r.choice(["", end, end + end])


@pytest.mark.parametrize("size", [120, 1 << 20])
def test_csv_against_csv(spark, tmp_path, splits, size):
    splits(size)
    r, want = random.Random(size), []
    for number in range(4):
        text = ("\ufeff" if number == 1 else "") + some_csv(r, 60) + ('\n"open to the end, \n really' if number == 2 else "")
        path = _write(tmp_path / f"c{number}.csv", text)
        with open(path, encoding="utf-8-sig", newline="") as fh:
            want += [row for row in csv.reader(fh) if row]
    got = in_order(csv_records(spark, str(tmp_path)), "fields")
    # At the end of a file a quote may still be open; what the last line feed adds to its field is not compared.
    assert [[f.rstrip("\n") for f in row] for row in got] == [[f.rstrip("\n") for f in row] for row in want]


def test_csv_rows_like_the_dict_reader(spark, tmp_path, splits):
    splits(50)
    path = _write(tmp_path / "d.csv", 'id,text,id\n1,"multi\nline",x\n\n2,,y,more,"and, more"\n3\n')
    ds = open_dataset(spark, path)
    with open(path, newline="") as fh:
        want = [{str(k): v for k, v in row.items()} for row in csv.DictReader(fh)]
    assert ds.columns == ["id", "text", "None"]
    got = [r.asDict() for r in ds.positioned().orderBy("__row_no").select("id", "text", "`None`").collect()]
    assert got == [{"id": w["id"], "text": w["text"], "None": w.get("None")} for w in want]


def test_csv_states_line_by_line():
    """A line leaves a quote open or not just as Python's reader sees it, from either state."""
    r = random.Random(3)
    for _ in range(3000):
        line = "".join(r.choice(['"', '"', ",", "a", " "]) for _ in range(r.randrange(9)))
        for quoted in (0, 1):
            rows = list(csv.reader([('"' if quoted else "") + line + "\n", "z\n", "z\n"])) if quoted or line else [[], ["z"], ["z"]]
            assert csv_after(line.encode() + b"\n", quoted) == (0 if len(rows) == 3 else 1), (line, quoted)
    assert _CLOSED(b'"' + b'a""' * 200_000 + b'"') and list(csv_lines([b"a\rb", b"c\r"])) == [b"a\r", b"b\n", b"c\r\n"]


def test_empty_files(spark, tmp_path):
    ds = open_dataset(spark, _write(tmp_path / "e.csv", ""))
    assert ds.columns == [] and ds.count() == 0
    ds = open_dataset(spark, _write(tmp_path / "h.csv", "a,b\n"))
    assert ds.columns == ["a", "b"] and ds.count() == 0
    ds = open_dataset(spark, _write(tmp_path / "e.json", "[]"))
    assert ds.columns == [] and ds.count() == 0
