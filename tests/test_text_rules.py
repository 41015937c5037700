"""Rule tests for the text semantics (whitespace, previews, markers, str/JSON forms)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.functions.render import py_float_repr, py_json, py_str, render
from shardlens.functions.text import PY_WHITESPACE, collapse_ws, has_no_markers, py_strip, role_markers
from shardlens.operators.paging import short_text


def test_whitespace_set_is_pythons():
    assert sorted(PY_WHITESPACE) == sorted(c for c in map(chr, range(0x3001)) if c.isspace())


def test_strip_all_python_whitespace(one):
    s = "　\x1c a b   \t"
    assert one(py_strip(F.col("s")), (s,), "s string") == s.strip()


def test_collapse_and_preview(one):
    s = "  a\t\tb\n  c  "
    assert one(py_strip(collapse_ws(F.col("s"))), (s,), "s string") == "a b c"
    long = "x" * 300
    got = one(short_text(F.col("s"), T.StringType(), 260), (long,), "s string")
    assert got == "x" * 259 + "…" and len(got) == 260
    assert one(short_text(F.col("s"), T.StringType(), 260), ("y" * 260,), "s string") == "y" * 260
    assert one(short_text(F.col("s"), T.StringType(), 260), (None,), "s string") == ""


def test_preview_of_list_is_json(one):
    got = one(short_text(F.col("t"), T.ArrayType(T.IntegerType()), 180), ([1, 2, 3],), "t array<int>")
    assert got == "[1, 2, 3]"


def test_role_markers_edge_cases(one):
    text = ("USER: a\nUser : b\n  assistant: c\r\nSYSTEM: d GPT: e\n"
            " HUMAN: f\n\x1cgpt: g\nfooUSER: h")
    got = one(role_markers(F.col("s")), (text,), "s string")
    assert got == ["USER", "User", "assistant", "SYSTEM", "HUMAN", "gpt"]


@pytest.mark.parametrize("text,expected", [
    ("hello", True), ("", False), ("   ", True), ("say user: hi", False), ("Assistant:x", False),
])
def test_no_markers(one, text, expected):
    assert one(has_no_markers(F.col("s")), (text,), "s string") is expected


@pytest.mark.parametrize("value", [1e7, 1e16, 1e15, 1e-5, 1e-4, 123.456, -0.0, 0.0, 1.5e300, 12345678.9,
                                   1.2345678901234568e17, 2.5e-10, 0.1, 100.0, -2.5])
def test_float_repr_matches_python(one, value):
    assert one(py_float_repr(F.col("d")), (value,), "d double") == repr(value)


def test_special_floats_and_scalars(one):
    assert one(py_float_repr(F.col("d")), (float("nan"),), "d double") == "nan"
    assert one(py_float_repr(F.col("d")), (float("-inf"),), "d double") == "-inf"
    assert one(py_str(F.col("b"), T.BooleanType()), (True,), "b boolean") == "True"
    f32 = one(py_str(F.col("f"), T.FloatType()), (0.1,), "f float")
    assert f32 == "0.10000000149011612"


def test_json_indent_two(one):
    st = T.StructType([T.StructField("a", T.ArrayType(T.LongType())), T.StructField("b", T.StringType()),
                       T.StructField("c", T.ArrayType(T.LongType()))])
    got = one(py_json(F.col("x"), st, indent=2), (([1, 2], None, []),), T.StructType([T.StructField("x", st)]))
    assert got == '{\n  "a": [\n    1,\n    2\n  ],\n  "b": null,\n  "c": []\n}'


def test_json_compact_escapes(one):
    st = T.StructType([T.StructField("k", T.StringType())])
    got = one(py_json(F.col("x"), st), (('x"y\\\n\x1cé',),), T.StructType([T.StructField("x", st)]))
    import json
    assert got == json.dumps({"k": 'x"y\\\n\x1cé'}, ensure_ascii=False)


MSG = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
FVC = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType()),
                    T.StructField("content", T.StringType())])


def _render(one, value, dtype):
    return one(render(F.col("x"), dtype), (value,), T.StructType([T.StructField("x", dtype)]))


def test_render_message_without_content_uses_item_json(one):
    got = _render(one, [("user", "hi")], T.ArrayType(MSG))
    assert got == 'user: {\n  "role": "user",\n  "text": "hi"\n}'


def test_render_value_key_present_but_null(one):
    assert _render(one, [("a", None, "x")], T.ArrayType(FVC)) == "a: a: x"


def test_render_lists_and_scalars(one):
    assert _render(one, [1, 2, 3], T.ArrayType(T.IntegerType())) == "1\n\n2\n\n3"
    assert _render(one, ["a", None], T.ArrayType(T.StringType())) == "a\n\nNone"
    assert _render(one, None, T.StringType()) == ""
    assert _render(one, None, T.ArrayType(MSG)) == ""
    assert _render(one, [None], T.ArrayType(MSG)) == "None"


def test_render_role_fallbacks(one):
    sp = T.StructType([T.StructField("speaker", T.StringType()), T.StructField("content", T.StringType())])
    assert _render(one, [("S", "hey")], T.ArrayType(sp)) == "S: hey"
    fv = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
    assert _render(one, [("", "v")], T.ArrayType(fv)) == "message: v"
    assert _render(one, [("u", "one"), ("a", "two")], T.ArrayType(fv)) == "u: one\n\na: two"


def test_render_dict_rule(one):
    d = T.StructType([T.StructField("role", T.StringType()), T.StructField("from", T.StringType()),
                      T.StructField("content", T.StringType())])
    assert _render(one, ("", "bot", "c"), d) == "bot: c"
    assert _render(one, ("assistant", None, "ok"), d) == "assistant: ok"
    assert _render(one, (None, None, "c"), d) == '{\n  "role": null,\n  "from": null,\n  "content": "c"\n}'


def test_render_nested_content_list(one):
    nested = T.StructType([T.StructField("from", T.StringType()),
                           T.StructField("value", T.ArrayType(T.LongType()))])
    assert _render(one, [("u", [1, 2])], T.ArrayType(nested)) == "u: 1\n\n2"


def test_timestamps_print_like_python(spark, one):
    import datetime as dt
    ntz = dt.datetime(2024, 1, 2, 3, 4, 5, 120)
    assert one(py_str(F.col("t"), T.TimestampNTZType()), (ntz,), "t timestamp_ntz") == str(ntz)
    assert one(py_str(F.col("t"), T.TimestampNTZType()), (ntz.replace(microsecond=0),), "t timestamp_ntz") == \
        "2024-01-02 03:04:05"
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        aware = dt.datetime(2024, 6, 1, 12, 0, 0, tzinfo=dt.timezone.utc)
        got = spark.createDataFrame([(aware,)], "t timestamp").select(py_str(F.col("t"), T.TimestampType()).alias("x"))
        assert got.first()["x"] == "2024-06-01 12:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
