"""Schema-directed text builders.

Python decides how to print a value by looking at its type per row; here the
decision is taken once, from the column's ``DataType``, when the expression is
built. The result is a plain ``Column`` (no UDF), so rendering a conversation
column runs vectorised inside Spark like any other projection.

* ``py_str``   – ``str(value)`` (numbers, booleans, timestamps as Python prints them)
* ``py_repr``  – ``repr(value)`` for items of nested lists
* ``py_json``  – ``json.dumps(value, ensure_ascii=False[, indent=2])``
* ``render``   – conversation rendering (messages → ``role: text`` blocks)
* ``value_text`` – the text a search looks in for one value
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixed import Ragged, bound, field_type, item_texts, mixed_text, own_keys, raw_of, with_raw, written_number

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def _lit(s: str) -> Column:
    return F.lit(s)


# --------------------------------------------------------------------------- str()

def py_float_repr(c: Column) -> Column:
    """Python ``repr(float)`` from Spark's shortest round-trip digits.

    Spark (Java) prints plain decimals for 1e-3 <= |x| < 1e7 — exactly what Python
    prints there — and ``d.dddE±n`` elsewhere. Only the ``E`` form is rewritten:
    Python keeps plain decimals up to 1e16 and down to 1e-4 and otherwise writes
    ``1e+16``, ``1.5e-05``. Plain column expressions, so it stays in codegen.
    """
    d = c.cast("double")
    s = d.cast("string")
    n = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int")
    dig = F.regexp_replace(F.replace(F.regexp_extract(s, r"^-?([0-9.]+)E", 1), _lit("."), _lit("")), "0+$", "")
    sign = F.when(s.startswith("-"), _lit("-")).otherwise(_lit(""))
    an = F.abs(n).cast("string")
    sci = F.concat(
        sign, F.substring(dig, 1, 1),
        F.when(F.length(dig) > 1, F.concat(_lit("."), F.substring(dig, 2, 1 << 30))).otherwise(_lit("")),
        _lit("e"), F.when(n < 0, _lit("-")).otherwise(_lit("+")),
        F.when(F.length(an) < 2, F.concat(_lit("0"), an)).otherwise(an),
    )
    frac = F.substring(dig, n + 2, 1 << 30)
    big = F.concat(sign, F.substring(F.rpad(dig, F.greatest(F.length(dig), n + 1), "0"), 1, n + 1), _lit("."),
                   F.when(frac == "", _lit("0")).otherwise(frac))
    small = F.concat(sign, _lit("0.000"), dig)
    rewritten = F.when((n >= 7) & (n < 16), big).when(n == -4, small).otherwise(sci)
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(d), _lit("nan"))
        .when(d == float("inf"), _lit("inf"))
        .when(d == float("-inf"), _lit("-inf"))
        .when(~F.contains(s, _lit("E")), s)
        .otherwise(rewritten)
    )


def py_str(c: Column, dt: T.DataType) -> Column:
    """``str(value)``; null stays null (callers decide between ``''`` and ``'None'``)."""
    if isinstance(dt, T.VariantType):
        return mixed_text(c, dt, py_repr, "None")
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, T.BooleanType):
        return F.when(c, _lit("True")).when(~c, _lit("False"))
    if isinstance(dt, _INTEGRAL):
        return c.cast("string")
    if isinstance(dt, (T.DoubleType, T.DecimalType)) and raw_of(dt) is not None:
        return F.when(c.isNotNull(), written_number(raw_of(dt)))
    if isinstance(dt, _FLOATING):
        return py_float_repr(c)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        # An instant prints as its UTC wall clock (Python gets it as an aware UTC
        # datetime); ``date_format`` uses the session zone, so shift by it first.
        wall = F.to_utc_timestamp(c, F.current_timezone()) if isinstance(dt, T.TimestampType) else c
        base = F.date_format(wall, "yyyy-MM-dd HH:mm:ss")
        frac = F.date_format(wall, "SSSSSS")
        out = F.concat(base, F.when(frac != "000000", F.concat(_lit("."), frac)).otherwise(_lit("")))
        if isinstance(dt, T.TimestampType):
            out = F.concat(out, _lit("+00:00"))
        return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(out)
    if isinstance(dt, (T.ArrayType, T.StructType, T.MapType)):
        return py_repr(c, dt)
    return c.cast("string")


def _py_str_repr(s: Column) -> Column:
    """``repr(str)``: single quotes unless the text has a ``'`` and no ``"``."""
    esc = F.replace(F.replace(F.replace(F.replace(s, _lit("\\"), _lit("\\\\")), _lit("\n"), _lit("\\n")),
                              _lit("\r"), _lit("\\r")), _lit("\t"), _lit("\\t"))
    use_double = F.contains(s, _lit("'")) & ~F.contains(s, _lit('"'))
    single = F.concat(_lit("'"), F.replace(esc, _lit("'"), _lit("\\'")), _lit("'"))
    return F.when(use_double, F.concat(_lit('"'), esc, _lit('"'))).otherwise(single)


def _items(c: Column, dt: T.ArrayType, text) -> Column:
    """``text(item, type)`` of each item of a list."""
    texts = item_texts(dt)
    if texts is None:
        return F.transform(c, lambda x: text(x, dt.elementType))
    return bound(texts, lambda found: F.transform(c, lambda x, i: text(x, with_raw(dt.elementType, F.get(found, i)))))


def _own_pairs(c: Column, dt: T.StructType, pair) -> Column:
    """``pair(field, type)`` of the fields an object has, null ones too, in the order written."""
    def of(keys: Column) -> Column:
        each = F.array(*[F.struct(F.array_position(keys, _lit(f.name)).alias("at"), pair(f, field_type(dt, f)).alias("pair")) for f in dt.fields])
        return F.transform(F.array_sort(F.filter(each, lambda p: p["at"] > 0)), lambda p: p["pair"])
    if not dt.fields:
        return F.array().cast("array<string>")
    return bound(own_keys(raw_of(dt)), of)


def py_repr(c: Column, dt: T.DataType) -> Column:
    """``repr(value)``; null → ``None``."""
    if isinstance(dt, T.StringType):
        out = _py_str_repr(c)
    elif isinstance(dt, T.ArrayType):
        inner = _items(c, dt, py_repr)
        out = F.concat(_lit("["), F.array_join(inner, ", "), _lit("]"))
    elif isinstance(dt, T.StructType) and raw_of(dt) is not None:
        pairs = _own_pairs(c, dt, lambda f, t: F.concat(_lit(repr(f.name) + ": "), py_repr(c[f.name], t)))
        out = F.concat(_lit("{"), F.array_join(pairs, ", "), _lit("}"))
    elif isinstance(dt, T.StructType):
        parts = [F.concat(_lit(repr(f.name) + ": "), py_repr(c[f.name], f.dataType)) for f in dt.fields]
        if isinstance(dt, Ragged):
            parts = [F.when(c[f.name].isNotNull(), part) for f, part in zip(dt.fields, parts)]
        out = F.concat(_lit("{"), F.concat_ws(", ", *parts), _lit("}")) if parts else _lit("{}")
    elif isinstance(dt, T.MapType):
        inner = F.transform(F.map_entries(c), lambda e: F.concat(
            _lit("("), py_repr(e["key"], dt.keyType), _lit(", "), py_repr(e["value"], dt.valueType), _lit(")")))
        out = F.concat(_lit("["), F.array_join(inner, ", "), _lit("]"))
    else:
        out = py_str(c, dt)
    return F.when(c.isNull(), _lit("None")).otherwise(out)


# --------------------------------------------------------------------------- json.dumps

# Jackson writes control characters as ``\u00XX`` with upper-case hex,
# Python with lower-case; these are the escapes that contain a letter.
_UPPER_HEX_ESCAPES = ["\\u000B", "\\u000E", "\\u000F", "\\u001A", "\\u001B", "\\u001C", "\\u001D", "\\u001E", "\\u001F"]


def _json_string(s: Column) -> Column:
    arr = F.to_json(F.array(s))
    body = F.regexp_extract(arr, r"(?s)^\[(.*)\]$", 1)
    for esc in _UPPER_HEX_ESCAPES:
        body = F.replace(body, _lit(esc), _lit(esc.lower()))
    return body


def py_json(c: Column, dt: T.DataType, indent: int | None = None, level: int = 0) -> Column:
    """``json.dumps(value, ensure_ascii=False, indent=indent)``; null → ``null``."""
    if indent is None:
        item_sep, key_sep, open_pad, close_pad = ", ", ": ", "", ""
    else:
        pad_in = "\n" + " " * (indent * (level + 1))
        pad_out = "\n" + " " * (indent * level)
        item_sep, key_sep, open_pad, close_pad = "," + pad_in, ": ", pad_in, pad_out
    if isinstance(dt, T.VariantType):
        inner = mixed_text(c, dt, lambda x, t: py_json(x, t, indent, level), "null")
        plain = F.schema_of_variant(c).isin("STRING", "BOOLEAN")  # Spark writes these two as Python does
        out = F.when(plain, F.when(F.schema_of_variant(c) == "STRING", _json_string(F.try_variant_get(c, "$", "string"))).otherwise(F.to_json(c))).otherwise(inner)
    elif isinstance(dt, T.StringType):
        out = _json_string(c)
    elif isinstance(dt, T.BooleanType):
        out = F.when(c, _lit("true")).otherwise(_lit("false"))
    elif isinstance(dt, (T.DoubleType, T.DecimalType)) and raw_of(dt) is not None:
        out = written_number(raw_of(dt))
    elif isinstance(dt, _INTEGRAL) or isinstance(dt, T.DecimalType) and dt.scale == 0:
        out = c.cast("string")
    elif isinstance(dt, _FLOATING):
        d = c.cast("double")
        out = (F.when(F.isnan(d), _lit("NaN")).when(d == float("inf"), _lit("Infinity"))
               .when(d == float("-inf"), _lit("-Infinity")).otherwise(py_float_repr(d)))
    elif isinstance(dt, T.ArrayType):
        inner = _items(c, dt, lambda x, t: py_json(x, t, indent, level + 1))
        out = F.when(F.size(c) == 0, _lit("[]")).otherwise(
            F.concat(_lit("[" + open_pad), F.array_join(inner, item_sep), _lit(close_pad + "]")))
    elif isinstance(dt, T.MapType):
        inner = F.transform(F.map_entries(c), lambda e: _json_pair(e, dt, indent, level + 1))
        out = F.when(F.size(c) == 0, _lit("[]")).otherwise(
            F.concat(_lit("[" + open_pad), F.array_join(inner, item_sep), _lit(close_pad + "]")))
    elif isinstance(dt, T.StructType):
        if not dt.fields:
            out = _lit("{}")
        elif raw_of(dt) is not None:
            pairs = _own_pairs(c, dt, lambda f, t: F.concat(_json_string(_lit(f.name)), _lit(key_sep), py_json(c[f.name], t, indent, level + 1)))
            out = bound(pairs, lambda own: F.when(F.size(own) == 0, _lit("{}")).otherwise(
                F.concat(_lit("{" + open_pad), F.array_join(own, item_sep), _lit(close_pad + "}"))))
        else:
            parts = [F.concat(_json_string(_lit(f.name)), _lit(key_sep), py_json(c[f.name], f.dataType, indent, level + 1))
                     for f in dt.fields]
            if isinstance(dt, Ragged):  # ``concat_ws`` passes over null parts
                parts = [F.when(c[f.name].isNotNull(), part) for f, part in zip(dt.fields, parts)]
            body = F.concat_ws(item_sep, *parts)
            out = F.when(body == "", _lit("{}")).otherwise(F.concat(_lit("{" + open_pad), body, _lit(close_pad + "}")))
    else:
        # Dates, timestamps, decimals, binary: Python's encoder rejects them; keep their text.
        out = _json_string(py_str(c, dt))
    return F.when(c.isNull(), _lit("null")).otherwise(out)


def _json_pair(e: Column, dt: T.MapType, indent: int | None, level: int) -> Column:
    """A map entry as Arrow hands it to Python: a 2-tuple, which JSON writes as a list."""
    if indent is None:
        return F.concat(_lit("["), py_json(e["key"], dt.keyType), _lit(", "), py_json(e["value"], dt.valueType), _lit("]"))
    pad_in = "\n" + " " * (indent * (level + 1))
    pad_out = "\n" + " " * (indent * level)
    return F.concat(_lit("[" + pad_in), py_json(e["key"], dt.keyType, indent, level + 1), _lit("," + pad_in),
                    py_json(e["value"], dt.valueType, indent, level + 1), _lit(pad_out + "]"))


# --------------------------------------------------------------------------- conversations

def _truthy(c: Column, dt: T.DataType) -> Column:
    """Python truthiness of a non-null value (null → false)."""
    if isinstance(dt, T.StringType):
        cond = c != ""
    elif isinstance(dt, T.BooleanType):
        cond = c
    elif isinstance(dt, (_INTEGRAL, _FLOATING, T.DecimalType)):
        cond = c != 0
    elif isinstance(dt, (T.ArrayType, T.MapType)):
        cond = F.size(c) > 0
    elif isinstance(dt, T.StructType):
        cond = F.lit(len(dt.fields) > 0)
    else:
        cond = F.lit(True)
    return c.isNotNull() & F.coalesce(cond, F.lit(False))


def _field(dt: T.StructType, name: str) -> T.StructField | None:
    """Key lookups in messages are case-sensitive."""
    return next((f for f in dt.fields if f.name == name), None)


def _first_truthy(c: Column, dt: T.StructType, names: list[str]) -> Column | None:
    picks = []
    for name in names:
        f = _field(dt, name)
        if f is not None:
            picks.append(F.when(_truthy(c[name], f.dataType), py_str(c[name], field_type(dt, f))))
    return F.coalesce(*picks) if picks else None


def _dict_rule(c: Column, dt: T.StructType) -> Column:
    """A dict: ``role: text`` when it has a truthy ``role``/``from`` and a non-null
    ``content`` (else ``value``); otherwise the dict as indented JSON."""
    as_json = py_json(c, dt, indent=2)
    role = _first_truthy(c, dt, ["role", "from"])
    text = _first_body(c, dt, ["content", "value"])
    if role is None or text is None:
        return as_json
    return F.when(role.isNotNull() & text.isNotNull(), F.concat(role, _lit(": "), text)).otherwise(as_json)


def _first_body(c: Column, dt: T.StructType, names: list[str]) -> Column | None:
    """Text of the first of the fields that the object has; null if that field is null. The object's text is looked at
    only where a field is null; without a text, a null field of a ragged object is an absent one."""
    found = [f for n in names if (f := _field(dt, n)) is not None]
    texts = [F.when(c[f.name].isNotNull(), render(c[f.name], field_type(dt, f))) for f in found]
    if not texts:
        return None
    if not isinstance(dt, Ragged):
        return texts[0]
    if raw_of(dt) is None:
        return F.coalesce(*texts)
    out = F.lit(None).cast("string")
    for f in reversed(found):
        there = F.array_contains(own_keys(raw_of(dt)), _lit(f.name))
        out = F.when(c[f.name].isNotNull(), render(c[f.name], field_type(dt, f))).when(there, F.lit(None).cast("string")).otherwise(out)
    return out


def _list_item(m: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.VariantType):
        return F.coalesce(mixed_text(m, dt, lambda x, t: _list_item(x, t) if isinstance(t, T.StructType) else py_str(x, t), "None"), _lit("None"))
    if not isinstance(dt, T.StructType):
        return F.coalesce(py_str(m, dt), _lit("None"))
    role = _first_truthy(m, dt, ["from", "role", "speaker"])
    role = F.coalesce(role, _lit("message")) if role is not None else _lit("message")
    text = _first_body(m, dt, ["value", "content"])
    body = _dict_rule(m, dt) if text is None else F.coalesce(text, _dict_rule(m, dt))
    return F.when(m.isNull(), _lit("None")).otherwise(F.concat(role, _lit(": "), body))


def render(c: Column, dt: T.DataType) -> Column:
    """Conversation rendering; never null (null renders as ``''``)."""
    if isinstance(dt, T.VariantType):
        return F.coalesce(mixed_text(c, dt, render, ""), _lit(""))
    if isinstance(dt, T.StringType):
        return F.coalesce(c, _lit(""))
    if isinstance(dt, T.ArrayType):
        texts = item_texts(dt)
        if texts is None:
            parts = F.transform(c, lambda m: _list_item(m, dt.elementType))
        else:  # not computed unless an item needs its text
            parts = F.transform(c, lambda m, i: _list_item(m, with_raw(dt.elementType, F.get(texts, i))))
        return F.coalesce(F.array_join(parts, "\n\n"), _lit(""))
    if isinstance(dt, T.MapType):
        # Arrow hands a map to Python as a list of (key, value) tuples.
        parts = F.transform(F.map_entries(c), lambda e: F.concat(
            _lit("("), py_repr(e["key"], dt.keyType), _lit(", "), py_repr(e["value"], dt.valueType), _lit(")")))
        return F.coalesce(F.array_join(parts, "\n\n"), _lit(""))
    if isinstance(dt, T.StructType):
        return F.when(c.isNull(), _lit("")).otherwise(_dict_rule(c, dt))
    return F.coalesce(py_str(c, dt), _lit(""))


def is_container(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.StructType, T.MapType))


def value_text(c: Column, dt: T.DataType, null_text: str | None = "None") -> Column:
    """Text a search sees for one value: lists/dicts rendered, scalars ``str``-ed."""
    if isinstance(dt, T.VariantType):
        body = mixed_text(c, dt, render, "None")
    else:
        body = render(c, dt) if is_container(dt) else py_str(c, dt)
    if null_text is None:
        return F.when(c.isNotNull(), body)
    return F.when(c.isNull(), _lit(null_text)).otherwise(body)


def preview_source(c: Column, dt: T.DataType) -> Column:
    """What a preview starts from: lists/dicts as JSON, scalars as ``str``, null as ''."""
    if isinstance(dt, T.VariantType):
        return F.when(c.isNull(), _lit("")).otherwise(mixed_text(c, dt, py_json, ""))
    body = py_json(c, dt) if is_container(dt) else py_str(c, dt)
    return F.when(c.isNull(), _lit("")).otherwise(body)
