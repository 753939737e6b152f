"""Columns by position or header name."""

from __future__ import annotations

from .errors import Kind, QuillError


def header_index(names: list[str], name: str) -> int | None:
    """The first position of a header, None if there is none."""
    return names.index(name) if name in names else None


def header_indices(names: list[str], name: str) -> list[int]:
    return [i for i, n in enumerate(names) if n == name]


def resolve(columns: list[int | str], names: list[str] | None) -> list[int]:
    """Positions of a projection; order and repeats are kept.  A name must stand exactly once."""
    found = []
    for c in columns:
        if isinstance(c, int):
            found.append(c)
            continue
        at = header_indices(names or [], c)
        if not at:
            raise QuillError(Kind.MISSING_HEADER, name=c)
        if len(at) > 1:
            raise QuillError(Kind.DUPLICATE_HEADER, name=c)
        found.append(at[0])
    return found
