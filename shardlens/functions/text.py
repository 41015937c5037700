"""Text rules as Spark ``Column`` expressions.

Everything here is built from JVM-side built-in functions so it stays inside
whole-stage codegen. The rules reproduce Python's string semantics (``str.strip``,
``re.sub(r"\\s+", ...)``, ``str(value)``) that the profiling jobs are defined by.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's ``str.isspace()`` accepts, which is also
# what Python's ``re`` matches with ``\s`` in a str pattern (29 characters).
PY_WHITESPACE_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
PY_WHITESPACE = "".join(chr(c) for c in PY_WHITESPACE_CODEPOINTS)

# The role words counted by the marker report, and the two markers the
# quality scan looks for.
ROLE_WORDS = ["USER", "ASSISTANT", "SYSTEM", "HUMAN", "GPT"]
QUALITY_MARKERS = ["USER:", "ASSISTANT:"]

# The ellipsis appended to cut previews.
ELLIPSIS = "…"


def _regex_class(codepoints: list[int]) -> str:
    """A character class valid in both Java regex and RE2 (``\\x{h}`` escapes)."""
    return "[" + "".join(f"\\x{{{c:X}}}" for c in codepoints) + "]"


WS_CLASS = _regex_class(PY_WHITESPACE_CODEPOINTS)

# Role markers at the start of a line: Python ``(?im)^\s*(WORD)\s*:``. ``d`` makes only
# ``\n`` end a line (as in Python), ``u`` turns on Unicode case folding.
ROLE_PATTERN_BODY = "^" + WS_CLASS + "*(" + "|".join(ROLE_WORDS) + ")" + WS_CLASS + "*:"
ROLE_PATTERN_JAVA = "(?imdu)" + ROLE_PATTERN_BODY
ROLE_PATTERN_RE2 = "(?im)" + ROLE_PATTERN_BODY


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove Python whitespace at both ends (Spark ``trim`` only
    removes U+0020)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def collapse_ws(c: Column) -> Column:
    """``re.sub(r"\\s+", " ", s)``."""
    return F.regexp_replace(c, WS_CLASS + "+", " ")


def cut(c: Column, limit: int) -> Column:
    """Keep ``limit`` characters; longer text keeps ``limit-1`` and gets an ellipsis.

    One anchored regex (``.`` is a code point in Java regex), so the text expression
    is referenced once and computed once.
    """
    keep = max(limit - 1, 0)
    return F.regexp_replace(c, "(?s)\\A(.{" + str(keep) + "}).{2,}\\z", "$1" + ELLIPSIS)


def role_markers(c: Column) -> Column:
    """Array of role words found at line starts, spelled as written."""
    return F.regexp_extract_all(c, F.lit(ROLE_PATTERN_JAVA), F.lit(1))


def has_no_markers(s: Column, upper: Column | None = None) -> Column:
    """Text is non-empty and holds neither marker anywhere (case-insensitive via upper).

    ``upper`` may pass an already computed ``upper(s)``."""
    up = F.upper(s) if upper is None else upper
    cond = s != F.lit("")
    for m in QUALITY_MARKERS:
        cond = cond & ~F.contains(up, F.lit(m))
    return cond
