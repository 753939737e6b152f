import random

import numpy as np
import pytest

from quillrow.plans import formats as fm
from quillrow.plans.errors import Kind, QuillError
from quillrow.plans.options import Limits, ParseOptions
from quillrow.sources import vector
from quillrow.sources.blocks import read_block
from quillrow.sources.parser import Parser
from quillrow.streaming.push import PushParser

RAW = ParseOptions(headers=False)


def parse(data, fmt=fm.CSV, options=RAW):
    return [r.fields for r in Parser(data, fmt, options)]


def failure(data, fmt=fm.CSV, options=RAW):
    with pytest.raises(QuillError) as e:
        parse(data, fmt, options)
    at = e.value.location
    return e.value.kind, at.byte, at.line, at.record, at.field


@pytest.mark.parametrize(
    "data,fmt,want",
    [
        (b"", fm.CSV, []),
        (b"a,b", fm.CSV, [[b"a", b"b"]]),
        (b"a,b\n", fm.CSV, [[b"a", b"b"]]),
        (b"a\r\nb\n", fm.CSV, [[b"a"], [b"b"]]),
        (b"\n\n", fm.CSV, [[b""], [b""]]),
        (b'"x\r\ny",1\n', fm.CSV, [[b"x\r\ny", b"1"]]),
        (b'"a""b"\n', fm.CSV, [[b'a"b']]),
        (b"a\r", fm.CSV, [[b"a\r"]]),
        (b"\xef\xbb\xbfa\n", fm.CSV, [[b"a"]]),
        (b"\xef\xbb\xbfa\n", fm.CSV.but(read_bom=fm.ReadBom.PRESERVE), [[b"\xef\xbb\xbfa"]]),
        (b"\xff,\xfe\n", fm.CSV, [[b"\xff", b"\xfe"]]),
        (b"a\\,b,c\n", fm.PYTHON_ESCAPED, [[b"a,b", b"c"]]),
        (b"a|b||c\n", fm.CSV.but(delimiter=b"||"), [[b"a|b", b"c"]]),
        (b"a;b~~;c~;d", fm.CSV.but(delimiter=b";", record_ending=b"~;"), [[b"a", b"b~"], [b"c"], [b"d"]]),
        (b'  a  ,"  b  "\n', fm.CSV.but(trim=fm.TRIM_ALL.unquoted_only()), [[b"a", b"  b  "]]),
        (b'  a  ,"  b  "\n', fm.TRIMMED_CSV, [[b"a", b"b"]]),
        (b" a,  b\n", fm.PYTHON_CSV, [[b" a", b"b"]]),
        (b"#no\n\n#x\na#b\n", fm.COMMENTED_CSV, [[b"a#b"]]),
        (b',""\n', fm.POSTGRES_COPY_CSV, [[None, b""]]),
        (b"\\N\t\\\\N\ta\\tb\\0\\Z\\q\n", fm.MYSQL, [[None, b"\\N", b"a\tb\0\x1aq"]]),
        (b'a"b\t"c"\n', fm.MYSQL, [[b'a"b', b'"c"']]),
        (b"a\\", fm.MYSQL, [[b"a\\"]]),
        (b'"a\\"b\\\\"\n', fm.BACKSLASH_CSV, [[b'a"b\\']]),
        (b'a"b\n', fm.CSV.but(syntax=fm.Recovery(quoting=True, unquoted_quotes=True)), [[b'a"b']]),
        (b'"a" \t,b\n', fm.CSV.but(syntax=fm.Recovery(quoting=True, trailing_whitespace_after_quote=True)), [[b"a", b"b"]]),
        (b'"a\\x"\n', fm.BACKSLASH_CSV.but(syntax=fm.Recovery(quoting=True, any_backslash_escape=True)), [[b"ax"]]),
        (b'"a"\r\nb\r\n', fm.RFC4180, [[b"a"], [b"b"]]),
    ],
)
def test_records(data, fmt, want):
    assert parse(data, fmt) == want


@pytest.mark.parametrize(
    "data,fmt,options,want",
    [
        (b'a,b"c\n', fm.CSV, RAW, (Kind.UNEXPECTED_QUOTE, 3, 1, 0, 1)),
        (b'"closed"x\n', fm.CSV, RAW, (Kind.UNEXPECTED_BYTE_AFTER_QUOTE, 8, 1, 0, 1)),
        (b'"unterminated', fm.CSV, RAW, (Kind.UNTERMINATED_QUOTED_FIELD, 13, 1, 0, 0)),
        (b"a,b,c\n1,2\n", fm.CSV, ParseOptions(headers=False, field_count="match_first"), (Kind.FIELD_COUNT_MISMATCH, 10, 3, 1, 2)),
        (b"aaaaaaaaaaaaaaaaaaaa,b\n", fm.CSV, ParseOptions(headers=False, limits=Limits(field_bytes=8)), (Kind.FIELD_TOO_LARGE, 8, 1, 0, 0)),
        (b"aaaa,bbbb\n", fm.CSV, ParseOptions(headers=False, limits=Limits(record_bytes=6)), (Kind.RECORD_TOO_LARGE, 6, 1, 0, 1)),
        (b"a,b,c\n", fm.CSV, ParseOptions(headers=False, limits=Limits(fields=2)), (Kind.TOO_MANY_FIELDS, 4, 1, 0, 2)),
        (b"x\n\"1\n2\n3\"\nbad\"record\n", fm.CSV, RAW, (Kind.UNEXPECTED_QUOTE, 13, 5, 2, 0)),
        (b"a\nb\r\n", fm.RFC4180, RAW, (Kind.INVALID_RECORD_ENDING, 1, 1, 0, 0)),
        (b"\xef\xbb\xbfa\r\n", fm.RFC4180, RAW, (Kind.REJECTED_BOM, 0, 1, 0, 0)),
        (b'"a\\x"', fm.BACKSLASH_CSV, RAW, (Kind.INVALID_ESCAPE, 3, 1, 0, 0)),
    ],
)
def test_errors(data, fmt, options, want):
    assert failure(data, fmt, options) == want


def test_an_error_ends_the_parser():
    p = Parser(b'a\nb"\nc\n', fm.CSV, RAW)
    assert p.next().fields == [b"a"]
    for kind in (Kind.UNEXPECTED_QUOTE, Kind.PARSER_FAILED):
        with pytest.raises(QuillError) as e:
            p.next()
        assert e.value.kind == kind


@pytest.mark.parametrize(
    "changes",
    [
        {"delimiter": b'"'},
        {"record_ending": b","},
        {"escape": fm.backslash(b",")},
        {"comment": b","},
        {"delimiter": b"12345"},
        {"escape": fm.unquoted()},
        {"syntax": fm.Recovery()},
        {"nulls": fm.Nulls.POSTGRES_CSV, "quoting": fm.Quoting.NEVER},
        {"nulls": fm.Nulls.MYSQL, "quoting": fm.Quoting.RAW},
        {"delimiter": b'|"'},
    ],
)
def test_formats_that_contradict_themselves(changes):
    with pytest.raises(QuillError):
        fm.CSV.but(**changes)


def test_unsplittable_formats():
    bad = [n for n, f in fm.PRESETS.items() if f.unsplittable()]
    assert sorted(bad) == ["backslash_csv", "backslash_tsv", "commented_csv", "python_escaped"]  # mysql has no quotes: it is cut by its escapes


PIECES = [b"a", b"b", b",", b'"', b'"', b"\n", b"\r", b"\r\n", b'""', b"\xc3\xa9", b"|", b"\t", b"#", b"\\", b" ", b"\\N"]


def documents(r, n):
    for _ in range(n):
        fmt = r.choice(list(fm.PRESETS.values()))
        if r.random() < 0.5:
            yield fmt, b"".join(r.choice(PIECES) for _ in range(r.randrange(14)))
        else:
            field = lambda: r.choice([b'"a' + fmt.delimiter + b'b"', b'""', b'"x""y"', b"", b"abc", b'"\r\n"', b"z"])
            yield fmt, fmt.ending.join(fmt.delimiter.join(field() for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4))) + r.choice([b"", fmt.ending])


def outcome(data, fmt, options=RAW):
    rows = []
    try:
        rows.extend((r.fields, r.start, r.line) for r in Parser(data, fmt, options))
    except QuillError as e:
        return rows, (e.kind, e.location)
    return rows, None


def test_vectorised_blocks_equal_the_record_parser():
    r, taken = random.Random(1), 0
    for fmt, data in documents(r, 20_000):
        options = ParseOptions(headers=False, field_count=r.choice(["flexible", "match_first", 2]))
        block = vector.parse(np.frombuffer(data, np.uint8), fmt.but(read_bom=fm.ReadBom.PRESERVE), options, options.expected())
        rows, error = outcome(data, fmt.but(read_bom=fm.ReadBom.PRESERVE), options)
        if block is None:
            continue
        taken += 1
        assert error is None, (fmt, data)
        values = block.values.tobytes()
        fields = [values[a:b] for a, b in zip(block.offsets[:-1], block.offsets[1:])]
        if block.null is not None:
            fields = [None if n else f for f, n in zip(fields, block.null)]
        got = [(fields[a:b], s, k + 1) for a, b, s, k in zip(block.records[:-1], block.records[1:], block.start.tolist(), block.line.tolist())]
        assert got == rows, (fmt, data)
    assert taken > 4000


def test_read_block_gives_rows_before_the_error():
    r = random.Random(2)
    for fmt, data in documents(r, 5000):
        fields, error = read_block(data, fmt, RAW, first=True)
        try:
            rows, want = outcome(data, fmt)
        except QuillError as e:
            rows, want = [], (e.kind, e.location)
        assert len(fields.records) - 1 == len(rows)
        assert (error and (error.kind, error.location)) == want


def test_chunks_never_change_the_outcome():
    r = random.Random(3)
    for fmt, data in documents(r, 6000):
        try:
            want = outcome(data, fmt)
        except QuillError as e:
            want = [], (e.kind, e.location)
        cuts = sorted({0, len(data), *(r.randrange(len(data) + 1) for _ in range(r.randrange(4)))})
        push, rows, error = PushParser(fmt, RAW), [], None
        try:
            for a, b in zip(cuts, cuts[1:]):
                rows += [(x.fields, x.start, x.line) for x in push.chunk(data[a:b])]
                if push.error:
                    raise push.error
            rows += [(x.fields, x.start, x.line) for x in push.finish()]
            if push.error:
                raise push.error
        except QuillError as e:
            error = e.kind, e.location
        assert (rows, error) == want, (fmt, data, cuts)
