"""Columns whose JSON type differs between rows (``VARIANT``), and objects whose keys do.

One pass over a mixed column finds the merged type of its lists and that of its objects
(``schema_of_variant_agg`` over the rows of each shape); where elements or fields are mixed again, so does one pass
over those, as deep as the data goes. A value is then read as the type of its own shape and goes through the
schema-directed builders like any other; scalars print by their own kind. Everything is a Spark expression.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHAPES = ("ARRAY", "OBJECT")


class Mixed(T.VariantType):
    """``VARIANT`` with the types its lists and objects have."""

    def __init__(self, types: dict[str, T.DataType]):
        self.types = types

    @classmethod
    def typeName(cls) -> str:
        return T.VariantType.typeName()

    def simpleString(self) -> str:
        return "variant"


class Ragged(T.StructType):
    """The merged type of JSON objects that need not all have its keys. Which keys an object has, and in what order, its
    text says (:func:`with_raw`); where no text is known, a null field counts as an absent key."""

    @classmethod
    def typeName(cls) -> str:
        return "struct"


def ragged(dt: T.DataType) -> T.DataType:
    """``dt`` with every struct in it marked as ``Ragged``."""
    if isinstance(dt, T.StructType):
        return Ragged([T.StructField(f.name, ragged(f.dataType), f.nullable) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(ragged(dt.elementType), dt.containsNull)
    return dt


# ------------------------------------------------------------------ the text a value was read from

def with_raw(dt: T.DataType, raw: Column | None) -> T.DataType:
    """``dt`` for values read from these JSON texts, if the text tells more than the value: the keys of objects, and
    whether a number was written as a whole one."""
    if raw is None or not _tells_more(dt):
        return dt
    out = copy.copy(dt)
    out.raw = raw
    return out


def raw_of(dt: T.DataType) -> Column | None:
    return getattr(dt, "raw", None)


def without_raw(dt: T.DataType) -> T.DataType:
    """``dt`` for frames that do not carry the texts."""
    out = copy.copy(dt)
    out.__dict__.pop("raw", None)
    return out


def _tells_more(dt: T.DataType) -> bool:
    if isinstance(dt, T.ArrayType):
        return _tells_more(dt.elementType)
    return isinstance(dt, (Ragged, T.VariantType, T.DoubleType, T.DecimalType))


def own_keys(raw: Column) -> Column:
    """The keys of an object in the order written; a repeated one counts once, at its first place."""
    return F.array_distinct(F.json_object_keys(raw))


def field_type(dt: T.StructType, f: T.StructField) -> T.DataType:
    raw = raw_of(dt)
    return f.dataType if raw is None else with_raw(f.dataType, F.try_element_at(F.from_json(raw, "map<string,string>"), F.lit(f.name)))


def item_texts(dt: T.ArrayType) -> Column | None:
    """The texts of the items of a list, if they tell more than the items."""
    raw = raw_of(dt)
    return None if raw is None else F.from_json(raw, "array<string>")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def written_number(raw: Column) -> Column:
    """A JSON number as Python prints it: whole as written, else as a float."""
    from .render import py_float_repr

    return (F.when(raw == "-0", F.lit("0")).when(raw.rlike(r"^-?[0-9]+$"), raw)
            .otherwise(py_float_repr(raw.try_cast("double"))))


def mixed_types(frame: DataFrame) -> dict[str, Mixed]:
    """The ``Mixed`` type of every ``VARIANT`` column of ``frame``, from one aggregate over all rows and a level."""
    names = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.VariantType)]
    if not names:
        return {}
    found = frame.agg(*[F.schema_of_variant_agg(F.when(_shape(F.col(f"`{n}`")).startswith(s), F.col(f"`{n}`"))).alias(f"{i}{s}")
                        for i, n in enumerate(names) for s in SHAPES]).first()
    out = {}
    for i, n in enumerate(names):
        types = {s: t for s in SHAPES if (t := _container(found[f"{i}{s}"])) is not None}
        out[n] = Mixed({s: _deeper(frame, F.try_variant_get(f"`{n}`", "$", t.simpleString()), t) for s, t in types.items()})
    return out


def _deeper(frame: DataFrame, value: Column, dt: T.DataType) -> T.DataType:
    """``dt`` with the types of the variants inside it, each level read from the data."""
    if "variant" not in dt.simpleString():
        return ragged(dt)
    if isinstance(dt, T.ArrayType):
        items = frame.select(F.explode(value).alias("item"))
        inner = mixed_types(items)["item"] if isinstance(dt.elementType, T.VariantType) else _deeper(items, F.col("item"), dt.elementType)
        return T.ArrayType(inner)
    if isinstance(dt, T.StructType):
        row = frame.select(value.alias("row"))
        return Ragged([T.StructField(f.name, mixed_types(row.select(F.col("row")[f.name].alias("field")))["field"]
                                     if isinstance(f.dataType, T.VariantType) else _deeper(row, F.col("row")[f.name], f.dataType)) for f in dt.fields])
    return dt


def _container(text: str | None) -> T.DataType | None:
    """The type of a list or object from its description; none if a key's name has no place in a type name."""
    if text is None or not text.startswith(SHAPES):
        return None
    ddl = re.sub(r"DECIMAL\(\d+,\s*[1-9]\d*\)", "DOUBLE", text.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))
    try:
        dt = T.DataType.fromDDL(ddl)
        return dt if T.DataType.fromDDL(dt.simpleString()) == dt else None
    except Exception:  # what Spark's parser raises for such a name
        return None


def _shape(c: Column) -> Column:
    return F.schema_of_variant(c)


def mixed_text(c: Column, dt: T.DataType, container: Callable[[Column, T.DataType], Column], null: str | None) -> Column:
    """Text of a variant: ``container(value, type)`` for lists and objects, the plain text of scalars, ``null`` for a
    JSON null; a missing value stays null."""
    from .render import py_float_repr

    shape, types, raw = _shape(c), getattr(dt, "types", {}), raw_of(dt)
    out = F.when(shape == "VOID", F.lit(null).cast("string"))
    for s in SHAPES:
        value = F.to_json(c) if s not in types else container(F.try_variant_get(c, "$", types[s].simpleString()), with_raw(types[s], raw))
        out = out.when(shape.startswith(s), value)
    if raw is not None:
        out = out.when(shape.rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), written_number(raw))
    truth = F.try_variant_get(c, "$", "boolean")
    fraction = shape.startswith("DOUBLE") | shape.startswith("FLOAT") | shape.rlike(r"^DECIMAL\(\d+, ?[1-9]")
    return (out.when(shape == "BOOLEAN", F.when(truth, F.lit("True")).otherwise(F.lit("False")))
            .when(fraction, py_float_repr(F.try_variant_get(c, "$", "double")))
            .when(shape.isNotNull(), F.try_variant_get(c, "$", "string")))
