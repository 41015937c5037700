"""Semantic column roles resolved by name (case-insensitive alias lists)."""

from __future__ import annotations

from collections.abc import Sequence

# The alias lists, in lookup order, for each role and each view.
TEXT_ALIASES_DASHBOARD = ["text", "content", "prompt", "conversation", "chat_string"]
TEXT_ALIASES_BROWSER = ["text", "chat_string", "conversation", "messages", "content", "prompt"]
TEXT_ALIASES_PROFILE = ["text", "content", "conversation", "chat_string", "prompt"]
TOKEN_ALIASES = ["tokens", "input_ids", "token_ids"]
MODEL_ALIASES = ["model", "model_name", "model_id", "role"]
FLAG_ALIASES = ["contains_banned", "banned", "is_banned"]

# Default for reports: the profile list, then ``messages`` so a messages-only dataset
# is still profiled (the exact per-view lists stay selectable).
TEXT_ALIASES_REPORT = TEXT_ALIASES_PROFILE + ["messages"]

ALIAS_SETS = {
    "dashboard": TEXT_ALIASES_DASHBOARD,
    "browser": TEXT_ALIASES_BROWSER,
    "profile": TEXT_ALIASES_PROFILE,
    "report": TEXT_ALIASES_REPORT,
}


def text_aliases(which: str | Sequence[str]) -> list[str]:
    if isinstance(which, str):
        return list(ALIAS_SETS[which])
    return list(which)


def _by_name(columns: Sequence[str]) -> dict[str, str]:
    """Columns by lower-cased name; of two that differ only by case the later one is meant."""
    return {c.lower(): c for c in columns}


def resolve(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First alias (in list order) naming a column, ignoring case."""
    index = _by_name(columns)
    return next((index[a.lower()] for a in aliases if a.lower() in index), None)


def token_column(columns: Sequence[str]) -> str | None:
    """Token column of a summary: of the columns that token aliases name, the one that stands first."""
    index = _by_name(columns)
    return min((index[a] for a in TOKEN_ALIASES if a in index), key=list(columns).index, default=None)
