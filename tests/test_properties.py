"""Property tests: the Column rules against Python's own string semantics.

Each example is a batch of generated values evaluated in one DataFrame, compared
value by value with what Python computes for the same input.
"""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.functions.render import py_float_repr, render
from shardlens.functions.text import PY_WHITESPACE, ROLE_WORDS, collapse_ws, cut, py_strip, role_markers

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

# Text built from whitespace of every kind, role words in mixed case, colons and letters.
pieces = st.sampled_from(list(PY_WHITESPACE) + ["USER", "user", "Assistant", "gpt", "HUMAN", "system", ":",
                                                  "\r\n", "a", "é", "x y", "ſ", " "])
texts = st.lists(st.lists(pieces, max_size=12).map("".join), min_size=1, max_size=40)

# Python's marker pattern for the same role words (a fixed value of the rule).
PY_ROLES = re.compile(r"(?im)^\s*(" + "|".join(ROLE_WORDS) + r")\s*:")


def _eval(spark, values, dtype, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)],
                               T.StructType([T.StructField("i", T.LongType()), T.StructField("v", dtype)]))
    rows = df.select("i", *[e.alias(f"e{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()
    return [tuple(r[f"e{k}"] for k in range(len(exprs))) for r in rows]


@SETTINGS
@given(texts)
def test_strip_collapse_cut_markers_match_python(spark, values):
    v = F.col("v")
    got = _eval(spark, values, T.StringType(), py_strip(v), py_strip(collapse_ws(v)), cut(v, 7), role_markers(v))
    for s, (stripped, collapsed, short, roles) in zip(values, got):
        assert stripped == s.strip()
        assert collapsed == re.sub(r"\s+", " ", s).strip()
        assert short == (s if len(s) <= 7 else s[:6] + "…")
        # ``ſ`` folds to ``s`` and U+2028 is no line start in Python; Java (?iu) with (?d) agrees.
        assert roles == PY_ROLES.findall(s)


floats = st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300)
                  .filter(lambda x: x == 0 or abs(x) > 1e-300), min_size=1, max_size=60)


@SETTINGS
@given(floats)
def test_float_repr_matches_python(spark, values):
    got = _eval(spark, values, T.DoubleType(), py_float_repr(F.col("v")))
    for x, (r,) in zip(values, got):
        assert r == repr(x) or float(r) == x and not math.isnan(x)


msg = st.fixed_dictionaries({"from": st.one_of(st.none(), st.sampled_from(["", "user", "gpt"])), "value": st.text(max_size=5)})
convs = st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), msg), max_size=4)), min_size=1, max_size=30)
MSG_T = T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]))


@SETTINGS
@given(convs)
def test_typed_rendering_of_messages(spark, values):
    """Messages with a text print as ``who: text``, one block each; a null message as ``None``."""
    got = _eval(spark, values, MSG_T, render(F.col("v"), MSG_T))
    for conv, (text,) in zip(values, got):
        assert text == "\n\n".join("None" if m is None else f"{m['from'] or 'message'}: {m['value']}" for m in conv or [])
