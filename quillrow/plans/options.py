"""How documents are read and written, apart from their dialect."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import configuration


@dataclass(frozen=True)
class Limits:
    """Bounds on raw bytes and fields, checked before anything is allocated."""

    record_bytes: int = 16 << 20
    field_bytes: int = 4 << 20
    fields: int = 16_384


FLEXIBLE, MATCH_FIRST = "flexible", "match_first"


@dataclass(frozen=True)
class ParseOptions:
    """``headers``: True (the first record), False, or the names.  ``field_count``: flexible,
    match_first (headers count as the first record), or a number."""

    headers: bool | tuple[str, ...] = True
    field_count: str | int = FLEXIBLE
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self) -> None:
        if isinstance(self.field_count, str) and self.field_count not in (FLEXIBLE, MATCH_FIRST):
            raise configuration(f"no such field count rule: {self.field_count}")

    def expected(self) -> int | None:
        """The width that is required before any record is read."""
        if isinstance(self.field_count, int):
            return self.field_count
        if self.field_count == MATCH_FIRST and isinstance(self.headers, tuple):
            return len(self.headers)
        return None


@dataclass(frozen=True)
class EmitOptions:
    headers: bool = True
    field_count: str | int = MATCH_FIRST
