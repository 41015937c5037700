"""Field resolution (P1) against a dataset.

For typed sources (Parquet, CSV) an alias list resolves once, against the column
names, to one plain column. For JSON sources rows may carry different keys, so the
choice is made per row: the first alias whose key is *present* in that row wins,
even when its value is null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import resolve
from ..sources.dataset import Dataset
from ..sources.readers import KEYS_COL


def resolve_apply(ds: Dataset, aliases: Sequence[str], fn: Callable[[Column, T.DataType], Column],
                  missing: Column) -> Column:
    """``fn(value, type)`` of the resolved field; ``missing`` when no alias matches."""
    schema = {f.name: f.dataType for f in ds.schema.fields}
    if not ds.has_presence:
        name = resolve(ds.columns, aliases)
        if name is None:
            return missing
        return fn(F.col(f"`{name}`"), schema[name])
    # Per-row: which alias is present (keys compared ignoring case).
    lower_keys = F.transform(F.col(KEYS_COL), lambda k: F.lower(k))
    out = None
    for a in aliases:
        name = resolve(ds.columns, [a])
        if name is None:
            continue
        branch = fn(F.col(f"`{name}`"), schema[name])
        cond = F.array_contains(lower_keys, F.lit(a.lower()))
        out = F.when(cond, branch) if out is None else out.when(cond, branch)
    return missing if out is None else out.otherwise(missing)

