"""Pieces of SQL text. A large expression is one call as a text, and a call for each of its parts as columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Iterable[str]) -> str:
    """An array of texts."""
    return f"cast(array({', '.join(map(quoted, values))}) as array<string>)"


def text_map(pairs: Mapping[str, str]) -> str:
    return f"map({', '.join(f'{quoted(k)}, {quoted(v)}' for k, v in pairs.items())})"


def struct(fields: Mapping[str, str]) -> str:
    """A struct of expressions by name."""
    return f"named_struct({', '.join(f'{quoted(k)}, {v}' for k, v in fields.items())})"


def entries(fields: Mapping[str, str]) -> str:
    """A map of expressions by text key."""
    return f"map_from_arrays(array({', '.join(map(quoted, fields))}), array({', '.join(fields.values())}))"


def stripped(text: str) -> str:
    """Without white space at either end."""
    return f"regexp_replace({text}, r'(?U)^\\s+|\\s+$', '')"


def filled(text: str) -> str:
    """Whether there is more than white space."""
    return f"coalesce({stripped(text)} <> '', false)"


def truthy(text: str) -> str:
    """Neither null nor empty; blanks count."""
    return f"coalesce({text} <> '', false)"


def case(*pairs: tuple[str, str], other: str | None = None) -> str:
    return "case " + " ".join(f"when {c} then {x}" for c, x in pairs) + (f" else {other}" if other else "") + " end"
