import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from quillrow import api
from quillrow.functions import decode as D
from quillrow.functions import encode as E
from quillrow.functions import record as R
from quillrow.operators import fold, segments
from quillrow.operators.index import RecordIndex
from quillrow.operators.scan import Document, parse_column, parse_documents
from quillrow.plans import formats as fm
from quillrow.plans import predicate as P
from quillrow.plans import projection
from quillrow.plans.errors import Kind, QuillError
from quillrow.plans.options import EmitOptions, ParseOptions
from quillrow.plans.rows import RULES, column, row
from quillrow.sources import files, split, writer
from quillrow.sources.parser import Parser

VALUES = ["", "a", "a,b", 'q"q', "x\ny", "x\r\ny", "\ttab", "é", "-1.5e3", "1", "\\N", "a\\b", "#c", "﻿m", " s ", "|", ";", None]


def kind_of(error):
    text = str(error.value)
    return next((k for k in vars(Kind).values() if isinstance(k, str) and k in text), text[:200])


@pytest.mark.parametrize("name", list(fm.PRESETS))
def test_encoded_rows_parse_to_themselves(spark, name):
    fmt = fm.PRESETS[name]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in VALUES for b in VALUES)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    lines = {r.i: bytes(r.line) for r in E.encoded(df, fmt, ["a", "b"], keep=("i",)).collect()}
    raw = lambda v: None if v is None else v.encode()
    for i, a, b in rows:
        assert lines[i] == E._record_bytes([raw(a), raw(b)], fmt), (a, b)
        got = [r.fields for r in Parser(lines[i], fmt, ParseOptions(headers=False), first=False)]
        none = None if fmt.nulls is not fm.Nulls.NONE else b""
        want = [raw(v) if v is not None else none for v in (a, b)]
        if name == "trimmed_csv":
            want = [v.strip(b" \t\n\r\x0c") for v in want]
        if name == "python_csv":
            want[1] = want[1] if set(b or "") & set(',"\n\r') else want[1].lstrip(b" ")
        assert got == [want], (a, b, lines[i])


@pytest.mark.parametrize("quoting", list(fm.Quoting))
def test_quoting_policies(spark, quoting):
    fmt = fm.CSV.but(quoting=quoting)
    ok = [v for v in VALUES if v is not None and (quoting is not fm.Quoting.NEVER or not set(v) & set(',"\n\r') and not v.startswith("﻿"))]
    df = spark.createDataFrame([(v, v) for v in ok], "k string, v string")
    for r in E.encoded(df, fmt, ["v"], keep=("k",)).collect():
        assert bytes(r.line) == E._record_bytes([r.k.encode()], fmt)
    if quoting is fm.Quoting.NEVER:
        with pytest.raises(Exception, match="Encode"):
            E.encoded(spark.createDataFrame([("a,b",)], "v string"), fmt).collect()


@pytest.mark.parametrize("name", list(fm.PRESETS))
def test_typed_columns_are_written_as_their_text(spark, name):
    fmt = fm.PRESETS[name]
    df = spark.sql("SELECT 1 a, CAST(-2.50 AS DECIMAL(9,2)) b, true c, DATE'2020-01-02' d, TIMESTAMP_NTZ'2020-01-02 03:04:05' e, CAST(NULL AS INT) f, CAST(1e300 AS DOUBLE) g")
    one = df.first()
    values = [b"1", b"-2.50", b"true", b"2020-01-02", b"2020-01-02 03:04:05", None, ("1" + "0" * 300).encode()]
    assert bytes(E.encoded(df, fmt).first().line) == E._record_bytes(values, fmt) and one.a == 1
    for strange in (fmt.but(delimiter=b"-"), fmt.but(delimiter=b"5")):
        got = list(Parser(bytes(E.encoded(df, strange).first().line), strange, ParseOptions(headers=False)))
        assert [v or None for v in got[0].fields] == values


def test_bytes_pass_unchanged(spark):
    body = bytes(range(256))
    df = spark.createDataFrame([(bytearray(body), "é")], "b binary, s string")
    line = bytes(E.encoded(df, fm.CSV).first().line)
    assert [r.fields for r in Parser(line, fm.CSV, ParseOptions(headers=False))] == [[body, "é".encode()]]
    rows = parse_column(E.encoded(df, fm.CSV), "line", fm.CSV, text=False).first()
    assert bytes(rows.fields[0]) == body
    with pytest.raises(Exception, match="InvalidUtf8"):
        parse_column(E.encoded(df, fm.CSV), "line", fm.CSV).collect()


def test_numbers_as_text(spark):
    xs = [0.0, -0.0, 1.0, 1.5, 1e7, 1.25e10, 1e21, 123456789012345680.0, 1e-5, 1.5e-7, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, r in zip(xs, df.select(E.shortest(F.col("x")).alias("t")).collect()):
        assert "e" not in r.t.lower() or r.t == "inf"
        assert float(r.t) == x or x != x and r.t == "NaN"


@pytest.mark.parametrize(
    "text,kind,want",
    [
        ("12", "int", 12), ("+7", "int", 7), ("-3", "int", -3), (" 12", "int", Kind.INVALID_DIGIT), ("", "int", Kind.EMPTY_FIELD),
        ("128", "byte", Kind.OUT_OF_RANGE), ("-128", "byte", -128), ("255", "u8", 255), ("256", "u8", Kind.OUT_OF_RANGE), ("-1", "u8", Kind.INVALID_DIGIT),
        ("9223372036854775807", "long", 2**63 - 1), ("9223372036854775808", "long", Kind.OUT_OF_RANGE), ("18446744073709551615", "u64", 2**64 - 1),
        ("000000000000000000000000000000000000000000012", "int", 12), ("1" * 60, "long", Kind.OUT_OF_RANGE),
        ("1.5", "double", 1.5), ("1d", "double", Kind.INVALID_VALUE), (".5", "double", 0.5), ("5.", "double", 5.0), ("INF", "double", float("inf")), ("-infinity", "double", float("-inf")),
        ("true", "boolean", True), ("0", "boolean", False), ("t", "boolean", Kind.INVALID_VALUE), ("yes", "boolean", Kind.INVALID_VALUE),
        ("é", "char", "é"), ("ab", "char", Kind.INVALID_VALUE), ("10.0.0.255", "ip", "10.0.0.255"), ("10.0.0.256", "ip", Kind.INVALID_VALUE),
        (str(2**127 - 1), "i128", str(2**127 - 1)), (str(2**127), "i128", Kind.OUT_OF_RANGE), (str(-(2**127)), "i128", str(-(2**127))), (str(2**128 - 1), "u128", str(2**128 - 1)),
    ],
)
def test_strict_conversions(spark, text, kind, want):
    df = spark.createDataFrame([(text,)], "s string")
    known = {v for v in vars(Kind).values() if isinstance(v, str)}
    if isinstance(want, str) and want in known:
        with pytest.raises(Exception) as e:
            df.select(D.decoded(F.col("s"), kind)).collect()
        assert kind_of(e) == want
        assert df.select(D.decoded(F.col("s"), kind, on_error="null").alias("v")).first().v is None
    else:
        assert df.select(D.decoded(F.col("s"), kind).alias("v")).first().v == want


def test_utf8_modes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xff"),)], "b binary")
    assert df.select(D.utf8(F.col("b"), "lossy").alias("v")).first().v == "a�"
    assert df.select(D.utf8(F.col("b"), "null").alias("v")).first().v is None
    with pytest.raises(Exception, match="InvalidUtf8"):
        df.select(D.utf8(F.col("b")).alias("v")).collect()


# -- files --------------------------------------------------------------------------------------------

BODY = b'id,name,note\n1,"a,1","x\ny"\n2,b,"q""q"\n3,"\r\n",\n4,d,"long\nlong\nlong"\n5,e,f\n'


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 7, 11, 16, 40, 200])
def test_cut_anywhere(spark, tmp_path, chunk):
    path = tmp_path / "d.csv"
    path.write_bytes(BODY)
    parts = split.plan(spark, str(path), fm.CSV, small=0, chunk=chunk, here=0)
    assert parts == split.plan(spark, str(path), fm.CSV, small=0, chunk=chunk) == split.plan_here([(str(path), len(BODY))], fm.CSV, chunk, 0)
    assert [p.start for p in parts] == [0, *[p.end for p in parts[:-1]]] and parts[-1].end == len(BODY)
    whole = [(r.fields, r.start, r.line, r.index) for r in Parser(BODY, fm.CSV, ParseOptions(headers=False))]
    rows = Document.open(spark, str(path), fm.CSV, ParseOptions(headers=False), small=0, chunk=chunk).scan(text=False, location=True)
    got = sorted((r._loc.byte, [bytes(v) for v in r.fields], r._loc.line, r._loc.record) for r in rows.collect())
    assert got == [(s, f, li, i) for f, s, li, i in whole]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 30])
def test_cut_anywhere_between_escapes(spark, tmp_path, chunk):
    """A format without quotes is cut at line feeds that no escape protects."""
    path = tmp_path / "d.tsv"
    body = b'1\ta\\\nb\n2\t\\\\\n3\t\\\\\\\nx"\n\\N\t\\\\\\\\\n5\t\n'
    path.write_bytes(body)
    whole = [(r.start, r.fields, r.line, r.index) for r in Parser(body, fm.MYSQL, ParseOptions(headers=False))]
    assert len(whole) == 5
    for here in (0, 1 << 20):
        rows = Document.open(spark, str(path), fm.MYSQL, ParseOptions(headers=False), small=0, chunk=chunk, here=here).scan(text=False, location=True)
        assert sorted((r._loc.byte, [None if v is None else bytes(v) for v in r.fields], r._loc.line, r._loc.record) for r in rows.collect()) == whole


@pytest.mark.parametrize("read,block", [(1, 1), (3, 2), (7, 5), (16, 4), (1000, 10)])
def test_blocks_of_a_part_join_to_the_whole(tmp_path, read, block):
    from quillrow.operators.scan import _blocks

    path = tmp_path / "d.csv"
    for body in (BODY, BODY[:-1], BODY + b'"' + b"\n" * 9 + b'"', b""):
        path.write_bytes(body)
        parts = list(_blocks(split.Part(str(path), 0, len(body), 0, 1, True), fm.CSV, read, block))
        assert b"".join(parts) == body
        rows = [r.fields for p in parts for r in Parser(p, fm.CSV, ParseOptions(headers=False), first=False)]
        assert rows == [r.fields for r in Parser(body, fm.CSV, ParseOptions(headers=False), first=False)]


def test_plain_blocks_are_what_the_parser_reads():
    """Blocks that Arrow splits: the same rows, places and refusals as the rules give."""
    from quillrow.operators.scan import part_batches, wanted_of

    r = random.Random(4)
    words = ["a", "", "bb", "x y", "é", "7", "-1.5", "long" * 9, '"', "\r", "\xff"]
    for k in range(300):
        fmt = r.choice([fm.CSV, fm.RFC4180, fm.TSV, fm.POSTGRES_COPY_CSV, fm.BACKSLASH_CSV, fm.MYSQL])
        ending, width = r.choice([fmt.ending, fmt.ending, b"\n", b"\r\n"]), r.randint(1, 4)
        own = words[: r.choice([8, 8, 8, 11])]
        text = lambda w: w.encode("latin-1") if w == "\xff" else w.encode()
        rows = [fmt.delimiter.join(text(r.choice(own)) for _ in range(width + (r.random() < 0.02))) for _ in range(r.randint(1, 30))]
        body = ending.join(rows) + r.choice([ending, b""])
        options = ParseOptions(headers=False, field_count=r.choice(["flexible", "match_first"]))
        test = r.choice([None, P.contains(0, "b"), P.equals(0, "a"), P.starts_with(width - 1, "x"), P.equals(0, "")])
        wanted = wanted_of(None, [r.randrange(width), 0], test, r.random() < 0.5, True)
        part = split.Part("memory", 0, len(body), 0, 1, True)
        import quillrow.operators.scan as scan

        def run(plain: bool) -> list:
            out = []
            able, read = scan.Plain.read, scan._blocks
            scan._blocks = lambda *a: iter([body])
            if not plain:
                scan.Plain.read = lambda *a: None
            try:
                for batch, error in part_batches(part, fmt, options, None, wanted):
                    out += batch.to_pylist() if batch is not None else []
                    out += [str(error)] if error is not None else []
            except QuillError as error:
                out.append(error.kind)
            finally:
                scan.Plain.read, scan._blocks = able, read
            return out

        assert run(True) == run(False), (k, fmt, body, options, test)


@pytest.mark.parametrize("chunk", [3, 8, 64])
def test_the_first_error_wherever_the_cuts_are(spark, tmp_path, chunk):
    body = BODY + b'6,g"h,i\n7,"x"y,z\n'
    path = tmp_path / "d.csv"
    path.write_bytes(body)
    document = Document.open(spark, str(path), fm.CSV, small=0, chunk=chunk)
    error = document.errors().first()
    assert (error.kind, error.byte, error.record) == (Kind.UNEXPECTED_QUOTE, len(BODY) + 3, 6)
    assert sorted(r.id for r in document.scan(on_error="prefix").collect()) == ["1", "2", "3", "4", "5"]
    with pytest.raises(Exception, match="UnexpectedQuote"):
        document.scan().collect()


def test_read_with_predicate_and_columns(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_bytes(BODY)
    df = api.read(spark, str(path), columns=["note", "id"], predicate=P.contains("name", "a"))
    assert [tuple(r) for r in df.collect()] == [("x\ny", "1")]
    both = api.read(spark, str(path))
    assert both.where("id = '1'").count() == 1 and both.count() == 5  # one DataFrame, filtered and not
    assert api.read(spark, str(path), predicate=P.equals("none", "x")).count() == 0
    with pytest.raises(QuillError) as e:
        api.read(spark, str(path), columns=["none"])
    assert e.value.kind == Kind.MISSING_HEADER
    assert api.headers(spark, str(path)) == ["id", "name", "note"]
    assert projection.header_indices(["a", "b", "a"], "a") == [0, 2]
    with pytest.raises(QuillError) as e:
        projection.resolve(["a"], ["a", "b", "a"])
    assert e.value.kind == Kind.DUPLICATE_HEADER


def test_predicates_agree_with_columns(spark):
    rows = [("ab",), ("b",), ("",), (None,), ("abc",)]
    df = spark.createDataFrame(rows, "v string")
    lines = E.encoded(df, fm.POSTGRES_COPY_CSV)
    fields = parse_column(lines, "line", fm.POSTGRES_COPY_CSV, text=False)
    for test in (P.equals(0, "ab"), P.contains(0, "b"), P.starts_with(0, ""), P.ends_with(0, "c"), P.equals(0, ""), P.equals(3, "")):
        scan = parse_column(lines, "line", fm.POSTGRES_COPY_CSV, predicate=test, text=False).count()
        assert scan == fields.where(test.condition(F.col("fields"), test.column)).count()
        assert scan == (sum(test.matches(v.encode() if v is not None else None) for (v,) in rows) if test.column == 0 else 0)
    assert P.equals(0, "x").skippable(fm.CSV) and not P.equals(0, "a,b").skippable(fm.CSV)


@row(rename_all="kebab-case")
@dataclasses.dataclass
class Item:
    item_id: int
    unit_price: float = column(alias=("price",))
    in_stock: bool | None = None
    note: str = column(default="none")


def test_typed_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"price,item-id,in-stock,other\n1.5,7,true,x\n2,8,,y\n")
    rows = [tuple(r) for r in api.read_typed(spark, str(path), Item).collect()]
    assert rows == [(7, 1.5, True, "none"), (8, 2.0, None, "none")]
    assert Item.quill_schema.headers == ["item-id", "unit-price", "in-stock", "note"]
    path.write_bytes(b"price,unit-price,item-id\n1,2,3\n")
    with pytest.raises(QuillError) as e:
        api.read_typed(spark, str(path), Item)
    assert e.value.kind == Kind.DECODE


def test_rename_rules_and_conflicts():
    assert {k: f("one_two") for k, f in RULES.items()} == {
        "lowercase": "one_two", "UPPERCASE": "ONE_TWO", "snake_case": "one_two", "SCREAMING_SNAKE_CASE": "ONE_TWO",
        "kebab-case": "one-two", "SCREAMING-KEBAB-CASE": "ONE-TWO", "PascalCase": "OneTwo", "camelCase": "oneTwo",
    }
    with pytest.raises(QuillError):
        column(skip=True, rename="x")
    with pytest.raises(QuillError):

        @row
        class Twice:
            a: int
            b: int = column(alias=("a",))


@pytest.mark.parametrize("name", ["csv", "excel", "mysql", "pipe"])
def test_write_and_read_back(spark, tmp_path, name):
    fmt = fm.PRESETS[name]
    df = spark.range(200).select(F.col("id"), F.concat(F.lit('v,"'), "id").alias("v")).repartition(3)
    names = writer.write(df, str(tmp_path / "out"), fmt, segment_bytes=500)
    assert len(names) > 3 and all(files.size(n) <= 500 for n in names)
    got = api.read(spark, str(tmp_path / "out"), fmt)
    assert sorted((int(r.id), r.v) for r in got.collect()) == [(i, f'v,"{i}') for i in range(200)]
    with pytest.raises(QuillError):
        writer.write(df, str(tmp_path / "out"), fmt)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_append(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    writer.append(df, path)
    writer.append(df, path)
    assert files.read(path, 0, 100) == b"k,v\n1,a\n1,a\n"
    with pytest.raises(QuillError) as e:
        writer.append(df.select("k"), path)
    assert e.value.kind == Kind.FIELD_COUNT_MISMATCH
    files.write(path, b"k,v\n1,a")
    with pytest.raises(QuillError) as e:
        writer.append(df, path)
    assert e.value.kind == Kind.UNTERMINATED_RECORD
    files.write(path, b"\xef\xbb\xbf")
    writer.append(df, path, fm.EXCEL)
    assert files.read(path, 0, 100) == b"\xef\xbb\xbfk,v\r\n1,a\r\n"
    assert writer.document(df) == b"k,v\n1,a\n"
    writer.write_one(df, path, options=EmitOptions(headers=False))
    assert files.read(path, 0, 100) == b"1,a\n"


def test_offsets_are_those_of_the_document(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("v"))
    body = writer.document(df.orderBy("id"))
    for r in writer.with_offsets(df, "id").collect():
        assert body[r.byte : r.byte + len(r.line)] == bytes(r.line)


def test_segments(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("g"), F.repeat(F.lit("y"), (F.col("id") % 40).cast("int")).alias("v"))
    rows = segments.segments(df, "id", 300, group="g").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.id):
        by.setdefault((r.g, r.segment), []).append(len(r.line))
    assert len(rows) == 300 and all(sum(s) + len("id,v\n") <= 300 for s in by.values())
    for (g, s), sizes in by.items():  # the next segment's first record would not have fitted
        if (g, s + 1) in by:
            assert sum(sizes) + by[g, s + 1][0] + len("id,v\n") > 300


def test_index(spark, tmp_path):
    path = str(tmp_path / "d.csv")
    files.write(path, BODY)
    index = RecordIndex.build(spark, path, str(tmp_path / "index"))
    assert len(index) == 6 and index.record_offset(1) == 13 and index.record_line(2) == 4
    again = RecordIndex(spark, str(tmp_path / "index")).bind()
    assert [r.id for r in again.read(2, 4, per_task=1).orderBy("id").collect()] == ["2", "3"]
    assert sorted(r.id for r in again.read(3).collect()) == ["3", "4", "5"]
    assert [r.id for r in again.read(1, 6, predicate=P.equals("name", "d")).collect()] == ["4"]
    with pytest.raises(QuillError) as e:
        again.read(7)
    assert e.value.kind == Kind.RECORD_OUT_OF_RANGE
    files.write(path, BODY + b"6,x,y\n")
    with pytest.raises(QuillError) as e:
        RecordIndex(spark, str(tmp_path / "index")).read(1)
    assert e.value.kind == Kind.SOURCE_MISMATCH
    with pytest.raises(QuillError) as e:
        RecordIndex(spark, str(tmp_path / "none"))
    assert e.value.kind == Kind.INVALID_INDEX


def test_data_source(spark, tmp_path):
    api.register(spark)
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    df.coalesce(1).write.format("quillrow").option("path", str(tmp_path / "o")).option("format", "postgres_copy_csv").mode("append").save()
    back = spark.read.format("quillrow").option("format", "postgres_copy_csv").load(str(tmp_path / "o"))
    assert sorted(map(tuple, back.collect())) == [("1", "a,b"), ("2", None)]
    some = spark.read.format("quillrow").option("format", "postgres_copy_csv").option("columns", "v").option("predicate", "equals:k:1").load(str(tmp_path / "o"))
    assert [tuple(r) for r in some.collect()] == [("a,b",)]


def test_folds(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_bytes(BODY)
    document = Document.open(spark, str(path), small=0, chunk=16)
    parts = fold.fold(document.scan(), int, lambda a, r: a + int(r["id"]))
    assert sum(parts) == 15
    seen = []
    fold.for_each_batch(document, seen.append, size=2)
    assert [[r["id"] for r in b] for b in seen] == [["1", "2"], ["3", "4"], ["5"]]


def test_documents_in_a_column(spark):
    df = spark.createDataFrame([(1, "a,b\nc,d\n"), (2, ""), (3, None), (4, 'x\ny"\n')], "k int, body string")
    rows = parse_documents(df, "body", keep=("k",), on_error="prefix").collect()
    assert [(r.k, r.fields) for r in rows if r.fields] == [(1, ["a", "b"]), (1, ["c", "d"]), (4, ["x"])]
    assert [(r.k, r._error.kind) for r in rows if r._error] == [(4, Kind.UNEXPECTED_QUOTE)]
    with pytest.raises(Exception, match="UnexpectedQuote"):
        parse_documents(df, "body", keep=("k",)).collect()
    assert parse_documents(df.limit(0), "body", keep=("k",)).count() == 0


def test_stream_of_chunks(spark, tmp_path):
    from quillrow.streaming.chunks import records, records_of

    bodies = {"a": BODY, "b": b"1,2\n3", "c": b'x\ny"\nz\n'}
    r, rows = random.Random(5), []
    for stream, body in bodies.items():
        cuts = sorted({0, len(body), *(r.randrange(len(body)) for _ in range(4))})
        rows += [(stream, i, bytearray(body[s:e]), e == len(body)) for i, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    r.shuffle(rows)  # chunks that come early wait
    schema = "stream string, seq bigint, chunk binary, last boolean"
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = records(source, fm.CSV).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    plain = lambda rows: sorted((x.stream, x._loc.record if x._loc else 99, [bytes(f) for f in x.fields] if x.fields else x._error.kind) for x in rows)
    want = []
    for stream, body in bodies.items():
        parser = Parser(body, fm.CSV, ParseOptions(headers=False))
        try:
            for x in parser:
                want.append((stream, x.index, x.fields))
        except QuillError as e:
            want.append((stream, 99, e.kind))
    assert plain(spark.sql("SELECT * FROM chunks").collect()) == sorted(want)
    assert plain(records_of(spark.createDataFrame(rows, schema)).collect()) == sorted(want)


def test_record_functions(spark):
    df = spark.createDataFrame([(["a", None, "c"],)], "f array<string>")
    f = F.col("f")
    one = lambda c: df.select(c.alias("v")).first().v
    assert one(R.get(f, 5)) is None and one(R.is_null(f, 1)) and not one(R.is_null(f, 5))
    assert one(R.project(f, [2, 0, 9])) == ["c", "a", None]
    assert one(R.set_field(f, 1, F.lit("b"))) == ["a", "b", "c"] and one(R.set_null(f, 0)) == [None, None, "c"]
    assert one(R.push_null(f)) == ["a", None, "c", None] and one(R.truncate(f, 1)) == ["a"]
    assert one(R.to_text(R.to_bytes(f))) == ["a", None, "c"]
    assert one(R.same(f, f))
    assert one(R.as_map(f, ["x", "y", "z", "w"])) == {"x": "a", "y": None, "z": "c", "w": None}
    assert one(R.as_struct(f, ["x", "y"])).asDict() == {"x": "a", "y": None}


def test_nested_structs_are_flattened(spark):
    df = spark.sql("SELECT 1 a, named_struct('b', 2, 'c', named_struct('d', 'x,y')) s")
    assert bytes(E.encoded(E.flattened(df), fm.CSV).first().line) == b'1,2,"x,y"\n'
    with pytest.raises(QuillError):
        E.flattened(spark.sql("SELECT array(1) a"))
    with pytest.raises(QuillError):
        E.encoded(spark.sql("SELECT map('a', 1) m"), fm.CSV)


@pytest.mark.parametrize("name", ["csv", "excel"])
def test_an_index_generated_with_its_document(spark, tmp_path, name):
    fmt = fm.PRESETS[name]
    df = spark.range(60).select("id", F.when(F.col("id") % 3 == 0, F.lit("x\ny,z")).otherwise(F.lit("w")).alias("v")).repartition(4)
    path = str(tmp_path / "d.csv")
    made = RecordIndex.generate(df, "id", path, str(tmp_path / "one"), fmt)
    scanned = RecordIndex.build(spark, path, str(tmp_path / "two"), fmt)
    rows = lambda i: sorted(tuple(r) for r in i.table.select("record", "byte", "line").collect())
    assert len(made) == 61 and rows(made) == rows(scanned)
    assert sorted(int(r.id) for r in made.read(10, 13, fmt).collect()) == [9, 10, 11]


def test_an_index_and_offsets_of_ranges_that_are_coalesced(spark, tmp_path):
    """Ranges of rows with text are of other numbers than those of the sizes alone."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "20"}
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        text = F.concat_ws("", F.transform(F.sequence(F.lit(0), (F.col("id") % 13).cast("int")), lambda k: F.sha2((F.col("id") * 100 + k).cast("string"), 256)))
        df = spark.range(0, 4000, 1, 3).select("id", F.concat(text, F.when(F.col("id") % 5 == 0, "a\nb").otherwise("")).alias("v"))
        path, body = str(tmp_path / "d.csv"), writer.document(df.orderBy("id"))
        made = RecordIndex.generate(df, "id", path, str(tmp_path / "one"))
        rows = lambda i: sorted(tuple(r) for r in i.table.select("record", "byte", "line").collect())
        assert files.read(path, 0, len(body) + 1) == body
        assert len(made) == 4001 and rows(made) == rows(RecordIndex.build(spark, path, str(tmp_path / "two")))
        places = writer.with_offsets(df, "id").collect()
        assert len(places) == 4000 and all(body[r.byte : r.byte + len(r.line)] == bytes(r.line) for r in places)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _peak_of_a_batch(fmt: fm.Format, texts: list[bytes]) -> tuple[int, list]:
    """Bytes that the parser takes besides a batch of records with keys, and the rows it gives."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    df = SimpleNamespace(schema=[SimpleNamespace(name="k", dataType=SimpleNamespace(simpleString=lambda: "bigint"))], select=lambda *_: df, mapInArrow=lambda run, _: run)
    run = parse_column(df, "line", fmt, ParseOptions(headers=("id", "text")), keep=("k",))
    lines = [fmt.delimiter.join([b"%d" % n, b'"' + t.replace(b'"', b'""') + b'"']) + fmt.ending for n, t in enumerate(texts)]
    columns = [pa.array(lines, pa.binary()), pa.array(range(len(texts)))]
    rows = pa.RecordBatch.from_arrays([pa.concat_arrays([c, c]).slice(7, len(c)) for c in columns], ["line", "k"])  # as a slice of a longer one
    tracemalloc.start()
    try:
        got = list(run(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    return peak, [tuple(r.values()) for r in pa.Table.from_batches(got).to_pylist()]


@pytest.mark.parametrize("name", ["postgres_copy_csv", "semicolon", "csv", "commented_csv", "tsv", "python_csv", "excel"])
def test_a_batch_is_parsed_in_blocks(name):
    """What the parser takes besides a batch doesn't grow with the batch."""
    fmt, peaks = fm.PRESETS[name], []
    for many in (2000, 4000):
        texts = [b"word " * (n % 700) + b'"a", b;\tc\nd ' * (n % 3) for n in range(many)]
        peak, rows = _peak_of_a_batch(fmt, texts)
        peaks.append(peak)
        assert rows == [(n, str(n), texts[n].decode()) for n in [*range(7, many), *range(7)]]
    assert peaks[1] < 1.3 * peaks[0]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            files.shared_folder(session(master))
        assert files.shared_folder(session(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_a_folder_is_split_by_the_data_source(spark, tmp_path):
    api.register(spark)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_bytes(BODY)
    rows = spark.read.format("quillrow").option("split_bytes", 20).load(str(tmp_path / "in"))
    assert rows.rdd.getNumPartitions() > 3
    assert sorted(r.id for r in rows.collect()) == sorted("12345" * 3)
    (tmp_path / "in" / "4.csv").write_bytes(b"other,head\n1,2\n")
    with pytest.raises(Exception, match="headers of"):
        spark.read.format("quillrow").load(str(tmp_path / "in")).collect()
