"""SQL fragments for the DuckDB oracle queries.

The oracles restate each rule in plain SQL so that the Spark plans can be checked
against an independent engine. The whitespace set and the role pattern are the
same fixed values the Spark side uses.
"""

from __future__ import annotations

from ..functions.text import PY_WHITESPACE_CODEPOINTS, ROLE_PATTERN_RE2, WS_CLASS

WS_CHARS = "(" + " || ".join(f"chr({c})" for c in PY_WHITESPACE_CODEPOINTS) + ")"
NL2 = "(chr(10) || chr(10))"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def preview(x: str, n: int) -> str:
    t = strip(f"regexp_replace(coalesce({x}, ''), '{WS_CLASS}+', ' ', 'g')")
    return f"(CASE WHEN length({t}) <= {n} THEN {t} ELSE substr({t}, 1, {n - 1}) || '…' END)"


def roles(x: str) -> str:
    return f"regexp_extract_all({x}, '{ROLE_PATTERN_RE2}', 1)"


def no_markers(s: str) -> str:
    return f"({s} <> '' AND NOT contains(upper({s}), 'USER:') AND NOT contains(upper({s}), 'ASSISTANT:'))"


def doc_haystack(match_names: bool = True, match_nulls: bool = True) -> str:
    """All-column search text of a ``documents`` row."""
    parts = []
    for name, expr in (("doc_id", "CAST(doc_id AS VARCHAR)"), ("text", "text"), ("lang", "lang"),
                       ("source", "source"), ("n_chars", "CAST(n_chars AS VARCHAR)")):
        if match_names:
            parts.append(f"'{name}'")
        parts.append(f"coalesce({expr}, 'None')" if match_nulls else expr)
    return "lower(concat_ws(' ', " + ", ".join(parts) + "))"


TOKENS = "list_transform(string_split(text, ' '), lambda w: length(w))"

CONVERSATION_TEXT = (
    "SELECT conv_id, string_agg(coalesce(nullif(role, ''), 'message') || ': ' || text, "
    f"{NL2} ORDER BY turn) AS s FROM conversations GROUP BY conv_id"
)

NUMBERED_DOCS = "SELECT *, row_number() OVER (ORDER BY doc_id) AS row_no FROM documents"


def py_timestamp(x: str) -> str:
    """``str(datetime)``: six fraction digits unless the microseconds are zero."""
    us = f"(epoch_us({x}) % 1000000)"
    return (f"(strftime({x}, '%Y-%m-%d %H:%M:%S') || "
            f"CASE WHEN {us} = 0 THEN '' ELSE '.' || lpad(CAST({us} AS VARCHAR), 6, '0') END)")
