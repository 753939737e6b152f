"""Whole blocks of records at once, in numpy.

Quote parity tells which separators are structural; one mask then drops separators, outer quotes
and one of each doubled pair, so all field values are a single gather.  Where a block breaks a rule,
or its format has rules that need a scan from the left, ``None`` is returned and ``parser.Parser``
reads the block instead and names the error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..plans.formats import CRLF, NEWLINE, Format, Nulls
from ..plans.options import MATCH_FIRST, ParseOptions


@dataclass
class Block:
    """Records of a block: field values end to end, and where fields and records begin."""

    values: np.ndarray  # uint8
    offsets: np.ndarray  # of fields within values, fields + 1
    null: np.ndarray | None  # explicit NULLs
    records: np.ndarray  # of records within fields, records + 1
    start: np.ndarray  # of records within the block's bytes
    line: np.ndarray  # line feeds before each record

    @property
    def n(self) -> int:
        return len(self.records) - 1


def supported(fmt: Format) -> bool:
    return (
        len(fmt.delimiter) == 1
        and (fmt.record_ending in (NEWLINE, CRLF) or len(fmt.record_ending) == 1)
        and not fmt.comment
        and not fmt.skip_blank_records
        and not fmt.skip_initial_space
        and not (fmt.trim.fields or fmt.trim.headers)
        and (fmt.escape.style == "double_quote" or bool(fmt.escape.byte))
        and not fmt.syntax.unquoted_quotes
        and not fmt.syntax.trailing_whitespace_after_quote
    )


def parse(data: np.ndarray, fmt: Format, options: ParseOptions, expected: int | None = None) -> Block | None:
    """``data`` begins at a record and ends at a record's end or at the document's."""
    n = len(data)
    if not supported(fmt):
        return None
    if fmt.escape.style != "double_quote" and (data == fmt.escape.byte[0]).any():
        return None
    if not n:
        none = np.zeros(0, np.int64)
        return Block(data, np.zeros(1, np.int64), None, np.zeros(1, np.int64), none, none)
    lead, quote = fmt.lead[0], fmt.quote[0]
    is_lead = data == lead
    structural = (data == fmt.delimiter[0]) | is_lead
    quotes = np.flatnonzero(data == quote) if fmt.syntax.quoting else np.zeros(0, np.int64)
    parity = None
    if len(quotes):
        if len(quotes) % 2:
            return None
        step = np.zeros(n, np.int8)
        step[quotes] = 1
        parity = np.bitwise_xor.accumulate(step)  # 1 from an opening quote up to its closing one
        structural &= parity == 0
    at = np.flatnonzero(structural)
    ends_record = is_lead[at]
    if fmt.record_ending == CRLF:
        carriage = data == 13
        if parity is not None:
            carriage &= parity == 0
        carriage = np.flatnonzero(carriage)
        lf = at[ends_record]
        if len(carriage) != len(lf) or (len(lf) and (carriage + 1 != lf).any()):
            return None
    start = np.concatenate([[0], at + 1])
    end = np.append(at, n)
    last = np.append(ends_record, False)
    if ends_record.size and ends_record[-1] and at[-1] == n - 1:
        start, end, last = start[:-1], end[:-1], last[:-1]
    keep = ~structural
    gone = []  # sorted places of what else is dropped
    if fmt.record_ending in (NEWLINE, CRLF):
        at_end = np.flatnonzero(last & (end > start))
        at_end = at_end[data[end[at_end] - 1] == 13]
        if len(at_end):
            end = end.copy()
            end[at_end] -= 1
            gone.append(end[at_end])
            keep[end[at_end]] = False
    if parity is not None:
        begins = np.zeros(n + 1, bool)
        begins[start] = True
        finishes = np.zeros(n + 1, bool)
        finishes[end] = True
        following = np.append(data, 0)
        opening = parity[quotes] == 1
        opens, closes = quotes[opening], quotes[~opening]
        doubled = following[closes + 1] == quote
        if fmt.escape.style != "double_quote" and doubled.any():
            return None
        if not (doubled | finishes[closes + 1]).all():
            return None
        again = np.append(False, data[:-1] == quote)[opens]
        if not (begins[opens] | again).all():
            return None
        for dropped in (opens[begins[opens]], closes):
            gone.append(dropped)
            keep[dropped] = False
    if (np.diff(np.append(start, n)).max(initial=0)) > options.limits.field_bytes:
        return None
    values = data[keep]
    # a field begins where it stood less what was dropped before: a separator a field, and the rest
    offsets = start - np.arange(len(start))
    for dropped in gone:
        many = np.bincount(np.searchsorted(start, dropped, "right") - 1, minlength=len(start))
        offsets[1:] -= np.cumsum(many)[:-1]
    offsets = np.append(offsets, len(values))
    records = np.append(0, np.flatnonzero(last) + 1)
    if not len(last) or not last[-1]:
        records = np.append(records, len(start))
    width = np.diff(records)
    first = start[records[:-1]]
    if width.max() > options.limits.fields or np.diff(np.append(first, n)).max() > options.limits.record_bytes:
        return None
    if options.field_count == MATCH_FIRST and expected is None:
        expected = int(width[0])
    if expected is not None and (width != expected).any():
        return None
    null = None
    if fmt.nulls is Nulls.POSTGRES_CSV:
        null = start == end
    feeds = np.flatnonzero(data == 10) if lead != 10 or parity is not None else at[ends_record]
    lines = np.arange(len(first)) if len(feeds) in (len(first), len(first) - 1) and lead == 10 and parity is None else np.searchsorted(feeds, first)
    return Block(values, offsets, null, records, first, lines)
