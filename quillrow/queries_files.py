"""Registered queries that go through files, splits, indexes, streams and values, with their SQL."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import decode as D
from .functions import encode as E
from .functions import record as R
from .operators import fold as folds
from .operators import roundtrip
from .operators.cursor import Cursor
from .operators.index import RecordIndex
from .operators.scan import Document, parse_column, parse_documents
from .plans import formats as fm
from .plans import predicate as P
from .plans import projection
from .plans.errors import Location, QuillError
from .plans.options import EmitOptions, Limits, ParseOptions
from .plans.rows import RULES, column, row, schema_of
from .queries import _register, _sql_necessary, _t
from .sources import files, split, writer
from .sources.emitter import Emitter
from .streaming.push import PushParser

PARTS = 20


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share."""
    return files.temporary(spark, label)


def _values(rows: list[tuple], columns: str) -> str:
    """SQL for a table of constants."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"'{v}'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({columns})"


def _outcome(case: Callable[[], object]) -> str:
    """What a case gives: its value as text, or the kind of its error."""
    try:
        return str(case())
    except QuillError as error:
        return error.kind


def _outcomes(name: str, want: dict[str, str], cases: Callable[[SparkSession, str], dict[str, Callable[[], object]]]) -> None:
    """A query of rules: one row a case with what it gives, which the SQL states."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(k, _outcome(f)) for k, f in cases(spark, sf_dir).items()], "name string, outcome string")

    _register(name, _values(list(want.items()), "name, outcome"))(query)


# -- one file in parts -------------------------------------------------------------------------------

def _document_file(spark: SparkSession, sf_dir: str, fmt: fm.Format = fm.CSV) -> str:
    """Documents, whose texts have line breaks and quotes, as one file in order of doc_id."""
    path = f"{scratch(spark, 'documents')}.csv"
    writer.write_one(_t(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id"), path, fmt)
    return path


def _in_parts(spark: SparkSession, path: str, fmt: fm.Format = fm.CSV, options: ParseOptions | None = None) -> Document:
    """The file cut in about ``PARTS`` parts, however small it is."""
    return Document.open(spark, path, fmt, options, small=0, chunk=max(1, files.size(path) // PARTS), here=0)


_LINE = f"CAST(doc_id AS VARCHAR) || ',' || {_sql_necessary('text')}"
_PLACES = f"""
SELECT doc_id, text, row_number() OVER w AS record,
  CAST(12 + coalesce(sum(strlen({_LINE}) + 1) OVER before, 0) AS BIGINT) AS byte,
  CAST(2 + coalesce(sum(1 + length(text) - length(replace(text, chr(10), ''))) OVER before, 0) AS BIGINT) AS line
FROM documents WINDOW w AS (ORDER BY doc_id), before AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@_register("file_split_scan", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest, record, byte, line FROM ({_PLACES})")
def file_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file read in parts that are cut by counting quotes, with exact places."""
    rows = _in_parts(spark, _document_file(spark, sf_dir)).scan(location=True)
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "_loc.record", "_loc.byte", "_loc.line")


@_register("file_split_escapes", "SELECT CAST(page_id AS VARCHAR) AS page_id, md5(html) AS digest, row_number() OVER (ORDER BY page_id) AS record FROM pages")
def file_split_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump without quotes, cut at line feeds that no backslash protects."""
    path = f"{scratch(spark, 'pages')}.tsv"
    writer.write_one(_t(spark, sf_dir, "pages").select("page_id", "html").orderBy("page_id"), path, fm.MYSQL)
    rows = _in_parts(spark, path, fm.MYSQL).scan(location=True)
    return rows.select("page_id", F.md5(F.col("html").cast("binary")).alias("digest"), "_loc.record")


@_register("file_split_points", f"SELECT true AS whole, true AS many, true AS at_records, count(*) + 1 AS records FROM documents")  # noqa: F541
def file_split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts themselves: they cover the file, begin at records, and know how many stand before them."""
    path = _document_file(spark, sf_dir)
    parts = split.plan(spark, path, fm.CSV, small=0, chunk=max(1, files.size(path) // PARTS), here=0)
    whole = parts[0].start == 0 and all(a.end == b.start for a, b in zip(parts, parts[1:])) and parts[-1].end == files.size(path)
    table = spark.createDataFrame([(p.start, p.record) for p in parts], "byte long, record long")
    places = _in_parts(spark, path, options=ParseOptions(headers=False)).locations()
    met = table.join(places.select("byte", "record"), ["byte", "record"]).count()
    return spark.createDataFrame([(whole, len(parts) >= 10, met == len(parts), places.count())], "whole boolean, many boolean, at_records boolean, records long")


@_register("file_split_threads", "SELECT k AS parts, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders, (VALUES (1), (3), (20)) AS p(k) GROUP BY k")
def file_split_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """However many parts a file is cut in, its rows are the same."""
    path = f"{scratch(spark, 'orders')}.csv"
    writer.write_one(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), path)
    n, out = files.size(path), []
    for k in (1, 3, 20):
        rows = Document.open(spark, path, small=0, chunk=-(-n // k), here=0).scan()
        out.append(rows.agg(F.count("*").alias("n"), F.sum(D.integer(F.col("o_orderkey"))).alias("keys")).select(F.lit(k).alias("parts"), "n", "keys"))
    return out[0].union(out[1]).union(out[2])


def _broken_file(spark: SparkSession, sf_dir: str) -> str:
    """Orders with a record that breaks the syntax wherever the key is 57 modulo 97."""
    path = f"{scratch(spark, 'broken')}.csv"
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey")
    lines = E.encoded(rows, fm.CSV, keep=("o_orderkey",))
    bad = F.when(F.col("o_orderkey") % 97 == 57, F.encode(F.lit('un"expected,x\n'), "UTF-8")).otherwise(F.col("line"))
    writer.place(lines.orderBy("o_orderkey").select(bad.alias("line")), path, b"o_orderkey,o_orderstatus\n")
    return path


@_register("error_fence_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 97 = 57)")
def error_fence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a file with many errors, read in parts: the rows before the first."""
    return _in_parts(spark, _broken_file(spark, sf_dir)).scan(on_error="prefix")


@_register(
    "error_fence_place",
    "WITH k AS (SELECT min(o_orderkey) AS bad FROM orders WHERE o_orderkey % 97 = 57) SELECT 'UnexpectedQuote' AS kind, CAST(25 + sum(strlen(CAST(o_orderkey AS VARCHAR)) + 1 + strlen(o_orderstatus) + 1) + 2 AS BIGINT) AS byte, count(*) + 2 AS line, count(*) + 1 AS record, CAST(0 AS BIGINT) AS field FROM orders, k WHERE o_orderkey < bad",
)
def error_fence_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest error, wherever parts met others."""
    return _in_parts(spark, _broken_file(spark, sf_dir)).errors().drop("path")


@_register("data_source_split", "SELECT l_linestatus, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_linestatus")
def data_source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered data source over one file in many partitions, with columns and a predicate."""
    api.register(spark)
    path = f"{scratch(spark, 'lineitem')}.csv"
    writer.write_one(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), path)
    reader = spark.read.format("quillrow").option("columns", "l_linestatus,l_orderkey").option("predicate", "equals:l_returnflag:A").option("split_bytes", max(1, files.size(path) // PARTS))
    return reader.load(path).groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum(D.integer(F.col("l_orderkey"))).alias("keys"))


@_register("data_source_write", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def data_source_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    api.register(spark)
    folder = scratch(spark, "source")
    _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.format("quillrow").option("path", folder).option("format", "pipe").mode("append").save()
    return spark.read.format("quillrow").option("format", "pipe").load(folder)


@_register("match_first_by_file", "SELECT size, count(*) AS n FROM (SELECT 2 AS size FROM nation UNION ALL SELECT 3 FROM region) GROUP BY size")
def match_first_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without headers are each as wide as their own first record, cut or not."""
    folder = scratch(spark, "widths")
    plain = EmitOptions(headers=False)
    files.opened(folder)[0].create_dir(files.opened(folder)[1], recursive=True)
    writer.write_one(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{folder}/a.csv", options=plain)
    writer.write_one(_t(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit("x").alias("x")), f"{folder}/b.csv", options=plain)
    rows = Document.open(spark, folder, fm.CSV, ParseOptions(headers=False, field_count="match_first"), small=0, chunk=40, here=0).scan()
    return rows.groupBy(F.size("fields").alias("size")).agg(F.count("*").alias("n"))


@_register("predicate_rare_literal", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) = '7'")
def predicate_rare_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal that most blocks don't hold: they are left before their fields are split."""
    path = f"{scratch(spark, 'rare')}.csv"
    writer.write_one(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path)
    return _in_parts(spark, path).scan(columns=["o_orderkey"], predicate=P.equals("o_orderkey", "7"))


# -- folds -------------------------------------------------------------------------------------------

@_register("fold_parts", "SELECT CAST(sum(o_orderkey) AS BIGINT) AS keys, count(*) AS n, max(strlen(o_orderpriority)) AS longest FROM orders")
def fold_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One accumulator a part of a split file, joined on the driver."""
    path = f"{scratch(spark, 'fold')}.csv"
    writer.write_one(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), path)
    parts = folds.fold(_in_parts(spark, path).scan(), lambda: (0, 0, 0), lambda a, r: (a[0] + int(r["o_orderkey"]), a[1] + 1, max(a[2], len(r["o_orderpriority"]))))
    return spark.createDataFrame([(sum(p[0] for p in parts), sum(p[1] for p in parts), max(p[2] for p in parts))], "keys long, n long, longest long")


@_register("fold_columns", "SELECT CAST(sum(o_orderkey) AS BIGINT) AS keys, count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def fold_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulators over whole batches of a split file, after a predicate."""
    import pyarrow.compute as pc

    path = f"{scratch(spark, 'fold')}.csv"
    writer.write_one(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path)
    rows = _in_parts(spark, path).scan(columns=["o_orderkey"], predicate=P.equals("o_orderstatus", "O"))
    parts = folds.fold(rows, lambda: (0, 0), lambda a, b: (a[0] + (pc.sum(b.column(0).cast(pa.int64())).as_py() or 0), a[1] + b.num_rows), by_batch=True)
    return spark.createDataFrame([(sum(p[0] for p in parts), sum(p[1] for p in parts))], "keys long, n long")


@_register("fold_batches", "SELECT (i - 1) // 64 AS batch, CAST(min(c_custkey) AS VARCHAR) AS first, count(*) AS n FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) GROUP BY 1")
def fold_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 rows in document order."""
    path = f"{scratch(spark, 'batches')}.csv"
    writer.write_one(_t(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey"), path)
    seen: list[tuple] = []
    folds.for_each_batch(_in_parts(spark, path), lambda b: seen.append((len(seen), b[0]["c_custkey"], len(b))), size=64)
    return spark.createDataFrame(seen, "batch long, first string, n long")


@_register("fold_each_record", "SELECT CAST(sum(s_suppkey) AS BIGINT) AS keys, count(*) AS n FROM supplier")
def fold_each_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side effects of every record, here on two counters of the cluster."""
    keys, n = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def action(r: dict) -> None:
        keys.add(int(r["s_suppkey"]))
        n.add(1)

    folds.for_each_record(roundtrip.through_text(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), fm.CSV), action)
    return spark.createDataFrame([(keys.value, n.value)], "keys long, n long")


# -- indexes -----------------------------------------------------------------------------------------

@_register("index_build", f"SELECT CAST(0 AS BIGINT) AS record, CAST(0 AS BIGINT) AS byte, CAST(1 AS BIGINT) AS line UNION ALL SELECT record, byte, line FROM ({_PLACES})")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record index of a file, scanned in parallel."""
    return RecordIndex.build(spark, _document_file(spark, sf_dir), scratch(spark, "index")).table


@_register("index_generate", f"SELECT CAST(0 AS BIGINT) AS record, CAST(0 AS BIGINT) AS byte, CAST(1 AS BIGINT) AS line UNION ALL SELECT record, byte, line FROM ({_PLACES})")
def index_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file and its index from one pass of encoding; both are reread."""
    folder = scratch(spark, "generated")
    made = RecordIndex.generate(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", f"{folder}.csv", folder)
    return RecordIndex(spark, folder).validate().table if len(made) else made.table


def _customer_index(spark: SparkSession, sf_dir: str) -> RecordIndex:
    path = f"{scratch(spark, 'customer')}.csv"
    writer.write_one(_t(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey"), path)
    return RecordIndex.build(spark, path, scratch(spark, "index"))


@_register("index_seek_range", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, record FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS record FROM customer) WHERE record >= 40 AND record < 90")
def index_seek_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records 40 to 90, read from their places alone."""
    return _customer_index(spark, sf_dir).read(40, 90, location=True, per_task=20).select("c_custkey", "c_name", "_loc.record")


@_register("index_seek_to_end", "SELECT c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS record FROM customer) WHERE record >= 100 AND ends_with(c_name, '7')")
def index_seek_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a record to the end, with a predicate, by a bound index."""
    return _customer_index(spark, sf_dir).bind().read(100, columns=["c_name"], predicate=P.ends_with("c_name", "7"))


def _index_rules(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    path, folder = f"{scratch(spark, 'rules')}.csv", scratch(spark, "index")
    files.write(path, b'k,v\n1,"a\nb"\n2,c\n')
    index = RecordIndex.build(spark, path, folder)
    other = path.replace(".csv", "-other.csv")
    files.write(other, b'k,v\n1,"a\nb"\n2,d\n')
    return {
        "len": lambda: len(index),
        "offset": lambda: index.record_offset(2),
        "line": lambda: index.record_line(2),
        "format": lambda: index.about["format"] == repr(fm.CSV),
        "out_of_range": lambda: index.record_offset(9),
        "read_out_of_range": lambda: index.read(9),
        "other_source": lambda: index.validate(other),
        "same_source": lambda: index.validate(path) is index,
        "no_index": lambda: RecordIndex(spark, folder + "-none"),
        "loaded_again": lambda: len(RecordIndex(spark, folder)),
    }


_outcomes("index_rules", {"len": "3", "offset": "12", "line": "4", "format": "True", "out_of_range": "RecordOutOfRange", "read_out_of_range": "RecordOutOfRange", "other_source": "SourceMismatch", "same_source": "True", "no_index": "InvalidIndex", "loaded_again": "3"}, _index_rules)


# -- cursors and pushed chunks -----------------------------------------------------------------------

@_register("cursor_walk", "SELECT row_number() OVER (ORDER BY n_nationkey) AS record, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def cursor_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document read record by record, in windows of a few bytes."""
    path = f"{scratch(spark, 'cursor')}.csv"
    writer.write_one(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), path)
    rows = [(r.index, r.fields[0].decode(), r.fields[1].decode()) for r in Cursor(path, window=7)]
    return spark.createDataFrame(rows, "record long, n_nationkey string, n_name string")


def _cursor_rules(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    path = f"{scratch(spark, 'cursor')}.csv"
    files.write(path, b'k,v\n1,"a\nb"\n2,c\n3,d"e\n')
    index = RecordIndex.build(spark, path.replace(".csv", "-good.csv"), scratch(spark, "index")) if files.write(path.replace(".csv", "-good.csv"), b'k,v\n1,"a\nb"\n2,c\n') is None else None

    def all_of(cursor: Cursor) -> str:
        out = []
        try:
            for r in cursor:
                out.append(r.fields[0].decode())
        except QuillError as error:
            out.append(error.kind)
        return " ".join(out)

    def rewound() -> str:
        cursor = Cursor(path)
        first = all_of(cursor)
        cursor.rewind()
        return f"{first} | {all_of(cursor)}"

    def sought() -> str:
        cursor = Cursor(path)
        cursor.seek_raw(Location(12, 4, 2))
        r = cursor.next()
        return f"{r.fields[0].decode()} {cursor.location.byte} {cursor.location.line} {cursor.location.record}"

    def by_index() -> str:
        cursor = Cursor(path.replace(".csv", "-good.csv"))
        cursor.seek(index, 2)
        return f"{all_of(cursor)} {cursor.is_done()}"

    def named() -> str:
        cursor = Cursor(path)
        before = cursor.headers
        cursor.set_headers(["x", "y"])
        return f"{before} {cursor.header_index('y')} {cursor.header_index('v')} {cursor.has_headers()}"

    return {
        "read": lambda: all_of(Cursor(path)),
        "rewind": rewound,
        "seek_raw": sought,
        "seek_outside": lambda: Cursor(path).seek_raw(Location(99)),
        "seek_index": by_index,
        "seek_other_index": lambda: Cursor(path).seek(index, 1),
        "headers": named,
        "without_headers": lambda: Cursor(path, options=ParseOptions(headers=False)).has_headers(),
        "is_done": lambda: Cursor(path).is_done(),
    }


_outcomes(
    "cursor_rules",
    {"read": "1 2 UnexpectedQuote", "rewind": "1 2 UnexpectedQuote | 1 2 UnexpectedQuote", "seek_raw": "2 12 4 2", "seek_outside": "RecordOutOfRange", "seek_index": "2 True", "seek_other_index": "SourceMismatch", "headers": "[''k'', ''v''] 1 None True", "without_headers": "False", "is_done": "False"},
    _cursor_rules,
)


def _push_rules(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    def fed(*chunks: bytes, options: ParseOptions | None = None) -> str:
        parser, out = PushParser(fm.CSV, options), []
        for c in chunks:
            out.append(str(len(parser.chunk(c))))
        out.append(str(len(parser.finish())))
        return f"{' '.join(out)} {parser.is_done}"

    def again() -> str:
        parser = PushParser()
        parser.chunk(b'a,"open')
        parser.reset()
        return f"{len(parser.chunk(b'x\n'))} {parser.is_done} {parser.record}"

    small = ParseOptions(headers=False, limits=Limits(record_bytes=8, field_bytes=8))
    return {
        "split_word": lambda: fed(b"Bos", b"ton,1\nAust", b"in,2"),
        "split_quote": lambda: fed(b'"a', b'"', b'"b"\n'),
        "split_ending": lambda: fed(b"a\r", b"\nb\r\n"),
        "reset": again,
        "limit_on_rest": lambda: fed(b"aaaa", b"aaaaa", options=small),
        "unterminated": lambda: fed(b'x\n"open'),
        "poisoned": lambda: [p := PushParser(), _outcome(lambda: p.chunk(b'a"b\n')), _outcome(lambda: p.chunk(b"x\n"))][1:],
    }


_outcomes(
    "push_rules",
    {"split_word": "0 1 0 1 True", "split_quote": "0 0 1 0 True", "split_ending": "0 2 0 True", "reset": "1 False 1", "limit_on_rest": "RecordTooLarge", "unterminated": "UnterminatedQuotedField", "poisoned": "[''UnexpectedQuote'', ''ParserFailed'']"},
    _push_rules,
)


@_register("incremental_stream", "SELECT CAST(page_id AS VARCHAR) AS stream, md5(html) AS digest, CAST(0 AS BIGINT) AS record FROM pages")
def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut in chunks of 997 bytes through the stateful streaming operator, to files."""
    from .streaming.chunks import records

    folder = scratch(spark, "stream")
    lines = E.encoded(_t(spark, sf_dir, "pages").select("page_id", "html"), fm.CSV, keep=("page_id",))
    n = F.ceil(F.octet_length("line") / 997)
    chunks = lines.select("page_id", "line", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("seq")).select(
        F.col("page_id").cast("string").alias("stream"), "seq", F.substring("line", (F.col("seq") * 997 + 1).cast("int"), F.lit(997)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("last")
    )
    chunks.repartition(3).write.parquet(f"{folder}/in")
    source = spark.readStream.schema("stream string, seq long, chunk binary, last boolean").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    found = records(source, fm.CSV).select("stream", F.md5(F.get("fields", F.lit(1))).alias("digest"), "_loc.record")
    query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("stream string, digest string, record long").parquet(f"{folder}/out")


# -- writing -----------------------------------------------------------------------------------------

@_register("append_to_file", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, i AS copy FROM nation, (VALUES (1), (2)) AS c(i)")
def append_to_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written, and appended to the same file."""
    path = f"{scratch(spark, 'append')}.csv"
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    writer.write_one(rows.withColumn("copy", F.lit(1)), path, fm.EXCEL)
    writer.append(rows.withColumn("copy", F.lit(2)), path, fm.EXCEL)
    return api.read(spark, path, fm.EXCEL).withColumn("copy", D.integer(F.col("copy"), "int"))


def _append_rules(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    two = spark.range(1).selectExpr("1 AS k", "'a' AS v")

    def onto(body: bytes | None, df: DataFrame = two, fmt: fm.Format = fm.CSV, options: EmitOptions | None = None) -> str:
        path = f"{scratch(spark, 'rule')}.csv"
        if body is not None:
            files.write(path, body)
        writer.append(df, path, fmt, options)
        return repr(files.read(path, 0, 100)).replace("'", "")

    return {
        "nothing": lambda: onto(None),
        "empty": lambda: onto(b""),
        "mark_alone": lambda: onto(b"\xef\xbb\xbf", fmt=fm.EXCEL),
        "records": lambda: onto(b"k,v\n0,z\n"),
        "unterminated": lambda: onto(b"k,v\n0,z"),
        "other_width": lambda: onto(b"k\n0\n"),
        "flexible_width": lambda: onto(b"k\n0\n", options=EmitOptions(field_count="flexible")),
        "no_header": lambda: onto(None, options=EmitOptions(headers=False)),
    }


_outcomes(
    "append_rules",
    {"nothing": "bk,v\\n1,a\\n", "empty": "bk,v\\n1,a\\n", "mark_alone": "b\\xef\\xbb\\xbfk,v\\r\\n1,a\\r\\n", "records": "bk,v\\n0,z\\n1,a\\n", "unterminated": "UnterminatedRecord", "other_width": "FieldCountMismatch", "flexible_width": "bk\\n0\\n1,a\\n", "no_header": "b1,a\\n"},
    _append_rules,
)


@_register("document_in_memory", "SELECT md5('n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey)) AS digest FROM nation")
def document_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as one document of bytes."""
    body = writer.document(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"))
    return spark.createDataFrame([(bytearray(body),)], "body binary").select(F.md5("body").alias("digest"))


@_register("write_bounded_files", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, true AS bounded FROM part")
def write_bounded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files of at most 1,024 bytes, each with its own header."""
    folder = scratch(spark, "bounded")
    names = writer.write(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), folder, fm.TSV, segment_bytes=1024)
    bounded = len(names) > 1 and all(files.size(n) <= 1024 for n in names)
    return api.read(spark, folder, fm.TSV).withColumn("bounded", F.lit(bounded))


@row(rename_all="kebab-case")
@dataclasses.dataclass
class Supplier:
    s_suppkey: int
    s_name: str = column(rename="name", format=lambda c: F.upper(c))
    s_nationkey: int | None = None
    s_acctbal: float = column(kind="double", alias=("balance",))
    hidden: str = column(skip=True)


@_register("typed_write_and_read", "SELECT s_suppkey, upper(s_name) AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def typed_write_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row schema's columns written under its headers, and decoded from the file."""
    path = f"{scratch(spark, 'typed')}.csv"
    rows = _t(spark, sf_dir, "supplier").withColumn("hidden", F.lit("never written"))
    writer.write_one(Supplier.quill_schema.encode(rows), path)
    return api.read_typed(spark, path, Supplier)


@_register(
    "typed_formatting",
    "SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS i, regexp_replace(CAST(p_retailprice AS VARCHAR), '[.]0$', '') AS f, CAST(p_size > 25 AS VARCHAR) AS b, CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS o FROM part",
)
def typed_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers, floats in shortest form, booleans in words and absent values, as they are written."""
    rows = _t(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_partkey AS i", "p_retailprice AS f", "p_size > 25 AS b", "CASE WHEN p_size % 2 <> 0 THEN p_size END AS o")
    return parse_column(E.encoded(rows, fm.CSV, ["i", "f", "b", "o"], keep=("k",)), "line", fm.CSV, ParseOptions(headers=("i", "f", "b", "o")), keep=("k",))


@_register("emit_nested", "SELECT md5(n_nationkey || ',' || n_name || ',' || r_name) AS digest FROM nation JOIN region ON n_regionkey = r_regionkey")
def emit_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs in structs as the fields of one record."""
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nested = rows.select("n_nationkey", F.struct("n_name", F.struct("r_name").alias("region")).alias("nation"))
    return E.encoded(E.flattened(nested), fm.CSV, ending=False).select(F.md5("line").alias("digest"))


@_register(
    "emit_arrays",
    f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN '\"\"' ELSE {_sql_necessary('p_name')} END WHEN 2 THEN {_sql_necessary('p_name')} || ',' ELSE {_sql_necessary('p_name')} || ',' || p_brand || ',' || {_sql_necessary('p_type')} END AS line FROM part",
)
def emit_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as records of any width: none, one (which may be empty), two with a NULL, three."""
    fields = F.expr("CASE p_partkey % 4 WHEN 0 THEN array() WHEN 1 THEN array(IF(p_size % 2 = 0, '', p_name)) WHEN 2 THEN array(p_name, CAST(NULL AS STRING)) ELSE array(p_name, p_brand, p_type) END")
    rows = _t(spark, sf_dir, "part").select("p_partkey", fields.cast("array<string>").alias("f"))
    return E.encoded_arrays(rows, "f", fm.CSV, keep=("p_partkey",)).select("p_partkey", F.regexp_replace(F.decode("line", "UTF-8"), "\n$", "").alias("line"))


@_register("emit_pushed", "SELECT n_regionkey, md5('n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey)) AS digest, count(*) + 1 AS records FROM nation GROUP BY n_regionkey")
def emit_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a group, built by a task field by field."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n_nationkey")
        emitter = Emitter(fm.CSV)
        emitter.emit(["n_nationkey", "n_name"])
        for k, name in zip(table.column("n_nationkey").to_pylist(), table.column("n_name").to_pylist()):
            emitter.begin_record()
            emitter.write_field("left over")
            emitter.cancel()
            emitter.emit([str(k), name])
        body = emitter.take()
        return pa.table({"n_regionkey": table.column("n_regionkey").slice(0, 1), "body": pa.array([body]), "records": pa.array([emitter.records], pa.int64())})

    return _t(spark, sf_dir, "nation").groupBy("n_regionkey").applyInArrow(run, "n_regionkey int, body binary, records long").select("n_regionkey", F.md5("body").alias("digest"), "records")


def _emitter_rules(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    class Full:
        def write(self, body: bytes) -> None:
            raise OSError("no space")

    def after(*values, fmt: fm.Format = fm.CSV, options: EmitOptions | None = None) -> str:
        emitter = Emitter(fmt, options)
        for v in values:
            emitter.emit(v)
        return repr(emitter.take()).replace("'", "")

    def poisoned() -> str:
        emitter = Emitter()
        emitter.emit(["a"])
        return f"{_outcome(lambda: emitter.flush_to(Full()))} {_outcome(lambda: emitter.emit(['b']))}"

    def kept() -> str:
        emitter = Emitter(fm.CSV.but(quoting=fm.Quoting.NEVER))
        first = _outcome(lambda: emitter.emit(["a,b"]))
        emitter.emit(["c"])
        return f"{first} {emitter.pending} {emitter.records}"

    return {
        "records": lambda: after(["a", "b"], ["", None]),
        "lone_empty": lambda: after([""]),
        "no_fields": lambda: after([]),
        "other_width": lambda: after(["a", "b"], ["c"]),
        "any_width": lambda: after(["a", "b"], ["c"], options=EmitOptions(field_count="flexible")),
        "fixed_width": lambda: after(["a"], options=EmitOptions(field_count=2)),
        "mark": lambda: after(["a"], fmt=fm.EXCEL),
        "poisoned": poisoned,
        "failed_record": kept,
        "not_open": lambda: Emitter().write_field("a"),
        "postgres_null": lambda: after(["", None], fmt=fm.POSTGRES_COPY_CSV),
        "mysql_null": lambda: after(["\\N", None], fmt=fm.MYSQL),
    }


_outcomes(
    "emitter_rules",
    {
        "records": "ba,b\\n,\\n", "lone_empty": 'b""\\n', "no_fields": "b\\n", "other_width": "FieldCountMismatch", "any_width": "ba,b\\nc\\n", "fixed_width": "FieldCountMismatch", "mark": "b\\xef\\xbb\\xbfa\\r\\n",
        "poisoned": "Io EmitterFailed", "failed_record": "Configuration 2 1", "not_open": "Encode", "postgres_null": 'b"",\\n', "mysql_null": "b\\\\\\\\N\\t\\\\N\\n",
    },
    _emitter_rules,
)


# -- dialects and rules ------------------------------------------------------------------------------

OWN = fm.register_format("caret", fm.Format(delimiter=b"^", quote=b"'", record_ending=b"\x1e", quoting=fm.Quoting.NECESSARY))

_register("roundtrip_own_format", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || '''s ^' AS p_name, p_brand FROM part")(
    lambda spark, sf_dir: roundtrip.through_text(_t(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_name, \"'s ^\") AS p_name", "p_brand"), fm.PRESETS["caret"])
)


@_register("comments_and_blanks", "SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS record, 4 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS line FROM nation")
def comments_and_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a comment, a blank line, a record and another comment for each nation."""
    body = F.concat(F.lit("# about,\"it\n\n"), F.col("n_nationkey"), F.lit(","), F.col("n_name"), F.lit("\n#\n"))
    docs = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", body.alias("b")))).alias("all")).select("n_regionkey", F.array_join(F.transform("all", lambda x: x["b"]), "").alias("body"))
    rows = parse_documents(docs, "body", fm.COMMENTED_CSV, keep=("n_regionkey",))
    return rows.select("n_regionkey", F.get("fields", F.lit(0)).alias("n_nationkey"), F.get("fields", F.lit(1)).alias("n_name"), "_loc.record", "_loc.line")


def _parsed(body: bytes, fmt: fm.Format = fm.CSV, options: ParseOptions | None = None):
    def run() -> str:
        from .sources.parser import Parser

        show = lambda v: "NULL" if v is None else v.decode("latin-1")
        return "/".join("|".join(map(show, r.fields)) for r in Parser(body, fmt, options or ParseOptions(headers=False)))

    return run


def _syntax_cases(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    but = lambda **x: fm.CSV.but(syntax=dataclasses.replace(fm.STRICT, **x))
    limit = lambda **x: ParseOptions(headers=False, limits=Limits(**x))
    return {
        "bare_quote": _parsed(b'a,b"c\n'),
        "bare_quote_kept": _parsed(b'a,b"c\n', but(unquoted_quotes=True)),
        "space_after_quote": _parsed(b'"a" ,b\n'),
        "space_after_quote_dropped": _parsed(b'"a" ,b\n', but(trailing_whitespace_after_quote=True)),
        "no_quoting": _parsed(b'"a",b\n', fm.CSV.but(syntax=fm.Recovery(), quoting=fm.Quoting.RAW)),
        "any_backslash": _parsed(b'"a\\xb"\n', fm.BACKSLASH_CSV.but(syntax=dataclasses.replace(fm.STRICT, any_backslash_escape=True))),
        "bad_backslash": _parsed(b'"a\\xb"\n', fm.BACKSLASH_CSV),
        "unquoted_escape": _parsed(b"a\\,b,c\n", fm.PYTHON_ESCAPED),
        "long_delimiter": _parsed(b"a|b||c\n", fm.CSV.but(delimiter=b"||")),
        "trim_unquoted": _parsed(b'  a  ,"  b  "\n', fm.CSV.but(trim=fm.TRIM_ALL.unquoted_only())),
        "trim_all": _parsed(b'  a  ,"  b  "\n', fm.TRIMMED_CSV),
        "other_quote": _parsed(b"'a,b',c\n", fm.CSV.but(quote=b"'")),
        "blank_kept": _parsed(b"a\n\nb\n"),
        "blank_skipped": _parsed(b"a\n\n\nb\n", fm.CSV.but(skip_blank_records=True)),
        "crlf": _parsed(b"a\r\nb\r\n"),
        "return_at_end": _parsed(b"a\nb\r"),
        "mark_kept": _parsed(b"\xef\xbb\xbfa\n", fm.CSV.but(read_bom=fm.ReadBom.PRESERVE)),
        "mark_dropped": _parsed(b"\xef\xbb\xbfa\n"),
        "initial_space": _parsed(b'a, "b"\n', fm.PYTHON_CSV),
        "mysql": _parsed(b"\\N\ta\\tb\\\\\n", fm.MYSQL),
        "postgres": _parsed(b'"",,x\n', fm.POSTGRES_COPY_CSV),
        "unterminated": _parsed(b'"open'),
        "record_limit": _parsed(b"aaaa,bbbb\n", options=limit(record_bytes=5)),
        "field_limit": _parsed(b"a" * 20 + b",b", options=limit(field_bytes=8)),
        "fields_limit": _parsed(b"a,b,c\n", options=limit(fields=2)),
        "within_limits": _parsed(b"aa,bb\n", options=limit(record_bytes=6, field_bytes=2, fields=2)),
        "fixed_width": _parsed(b"a,b\nc\n", options=ParseOptions(headers=False, field_count=2)),
        "any_width": _parsed(b"a,b\nc\n"),
    }


_SYNTAX = {
    "bare_quote": "UnexpectedQuote", "bare_quote_kept": 'a|b"c', "space_after_quote": "UnexpectedByteAfterQuote", "space_after_quote_dropped": "a|b", "no_quoting": '"a"|b', "any_backslash": "axb", "bad_backslash": "InvalidEscape",
    "unquoted_escape": "a,b|c", "long_delimiter": "a|b|c", "trim_unquoted": "a|  b  ", "trim_all": "a|b", "other_quote": "a,b|c", "blank_kept": "a//b", "blank_skipped": "a/b", "crlf": "a/b", "return_at_end": "a/b\r",
    "mark_kept": "ï»¿a", "mark_dropped": "a", "initial_space": "a|b", "mysql": "NULL|a\tb\\", "postgres": "|NULL|x", "unterminated": "UnterminatedQuotedField", "record_limit": "RecordTooLarge", "field_limit": "FieldTooLarge",
    "fields_limit": "TooManyFields", "within_limits": "aa|bb", "fixed_width": "FieldCountMismatch", "any_width": "a|b/c",
}
_outcomes("syntax_rules", _SYNTAX, _syntax_cases)


def _format_cases(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    fmt = lambda **x: lambda: fm.CSV.but(**x) is not None

    def twice() -> object:
        class Twice:
            a: int
            b: int = column(alias=("a",))

        return row(Twice)

    def many_names() -> object:
        @row
        class One:
            price: float = column(alias=("cost",))

        return One.quill_schema.positions(["price", "cost"])

    return {
        "same_delimiter_and_quote": fmt(delimiter=b'"'),
        "same_ending_and_delimiter": fmt(record_ending=b","),
        "long_quote": fmt(quote=b"''"),
        "escape_is_quote": fmt(escape=fm.backslash(b'"')),
        "comment_is_delimiter": fmt(comment=b","),
        "escapes_need_never": fmt(escape=fm.unquoted()),
        "no_quotes_to_write": fmt(syntax=fm.Recovery()),
        "postgres_without_quotes": fmt(nulls=fm.Nulls.POSTGRES_CSV, quoting=fm.Quoting.NEVER),
        "mysql_raw": fmt(nulls=fm.Nulls.MYSQL, quoting=fm.Quoting.RAW),
        "quote_in_ending": fmt(record_ending=b'~"'),
        "fine": fmt(delimiter=b"::", record_ending=b"~~"),
        "skipped_and_renamed": lambda: column(skip=True, rename="x"),
        "parsed_with_default": lambda: column(parse=lambda c: c, default=1),
        "alias_twice": lambda: column(alias=("a", "a")),
        "two_fields_one_column": twice,
        "two_columns_one_field": many_names,
        "unsplittable": lambda: sum(f.unsplittable() is not None for f in (fm.CSV, fm.COMMENTED_CSV, fm.MYSQL, fm.BACKSLASH_CSV, fm.CSV.but(delimiter=b"||"))),
        "unknown_count_rule": lambda: ParseOptions(field_count="some"),
        "array_in_record": lambda: E.flattened(spark.sql("SELECT array(1) a")),
        "map_in_field": lambda: E.encoded(spark.sql("SELECT map('a', 1) m"), fm.CSV),
    }


_outcomes(
    "configuration_rules",
    dict.fromkeys(
        ["same_delimiter_and_quote", "same_ending_and_delimiter", "long_quote", "escape_is_quote", "comment_is_delimiter", "escapes_need_never", "no_quotes_to_write", "postgres_without_quotes", "mysql_raw", "quote_in_ending", "skipped_and_renamed", "parsed_with_default", "alias_twice", "two_fields_one_column", "unknown_count_rule", "array_in_record", "map_in_field"],
        "Configuration",
    )
    | {"fine": "True", "two_columns_one_field": "Decode", "unsplittable": "3"},
    _format_cases,
)


def _header_cases(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    path = f"{scratch(spark, 'headers')}.csv"
    files.write(path, b'id,"na\nme",id\n1,2,3\n')
    empty = path.replace(".csv", "-empty.csv")
    files.write(empty, b"")
    names = api.headers(spark, path)
    return {
        "names": lambda: len(names),
        "first": lambda: projection.header_index(names, "id"),
        "all": lambda: projection.header_indices(names, "id"),
        "missing": lambda: projection.header_index(names, "x"),
        "project_twice": lambda: projection.resolve(["id"], names),
        "project_missing": lambda: projection.resolve(["x"], names),
        "project_by_place": lambda: projection.resolve([2, 0, 2], names),
        "none_in_empty": lambda: api.headers(spark, empty),
        "given": lambda: api.headers(spark, path, options=ParseOptions(headers=("a", "b", "c"))),
        "off": lambda: api.headers(spark, path, options=ParseOptions(headers=False)),
    }


_outcomes("header_rules", {"names": "3", "first": "0", "all": "[0, 2]", "missing": "None", "project_twice": "DuplicateHeader", "project_missing": "MissingHeader", "project_by_place": "[2, 0, 2]", "none_in_empty": "None", "given": "[''a'', ''b'', ''c'']", "off": "None"}, _header_cases)


@_register("rename_rules", "SELECT rule, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation, (VALUES " + ", ".join(f"('{r}')" for r in RULES) + ") AS t(rule) GROUP BY rule")
def rename_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns named by each of the eight rules, found by a schema of the same rule."""

    @dataclasses.dataclass
    class Nation:
        n_nationkey: int
        n_name: str

    out = None
    for rule, spelled in RULES.items():
        lines = E.encoded(_t(spark, sf_dir, "nation").select("n_name", "n_nationkey"), fm.CSV)
        rows = schema_of(Nation, rule).decode(parse_column(lines, "line", fm.CSV), names=[spelled("n_name"), spelled("n_nationkey")])
        one = rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))
        out = one if out is None else out.union(one)
    return out


# -- rows of other shapes ----------------------------------------------------------------------------

@_register("decode_documents", "SELECT n_regionkey, CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(NULL AS BIGINT) AS absent FROM nation")
def decode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in a column, decoded by position."""

    @row
    @dataclasses.dataclass
    class Entry:
        key: int
        name: str
        absent: int | None = None

    line = F.concat_ws(",", F.col("n_nationkey"), F.concat(F.lit('"'), F.col("n_name"), F.lit('"')))
    docs = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    return api.decode_documents(docs, "body", Entry, keep=("n_regionkey",))


@_register(
    "record_shapes",
    "SELECT c_custkey AS k, c_name AS mapped, c_mktsegment AS field, c_custkey + 1 AS first, [CAST(c_custkey AS BIGINT), c_nationkey] AS numbers, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS variant, c_nationkey * 2 AS own FROM customer",
)
def record_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as maps, structs, tuples, sequences and variants, and a field with a parser of its own."""
    source = _t(spark, sf_dir, "customer").select("c_name", "c_mktsegment", "c_custkey", "c_nationkey")
    rows = parse_column(E.encoded(source, fm.CSV), "line", fm.CSV)
    f = F.col("fields")

    @row
    @dataclasses.dataclass
    class Own:
        c_nationkey: int = column(parse=lambda c: c.cast("int") * 2)

    own = Own.quill_schema.fields[0].parse(R.get(f, 3))
    return rows.select(
        D.integer(R.get(f, 2)).alias("k"),
        F.element_at(R.as_map(f, source.columns), F.lit("c_name")).alias("mapped"),
        R.as_struct(f, source.columns)["c_mktsegment"].alias("field"),
        (R.as_tuple(R.project(f, [2, 3]), ["long", "int"])["_1"] + 1).alias("first"),
        R.as_sequence(f, "long", 2).alias("numbers"),
        R.as_variant(R.get(f, 1), ("BUILDING", "MACHINERY"), "null").alias("variant"),
        own.alias("own"),
    )


@_register(
    "record_places",
    "SELECT n_nationkey, n_nationkey || n_name AS joined, strlen(CAST(n_nationkey AS VARCHAR)) AS start, strlen(n_nationkey || n_name) AS stop, true AS same, true AS hashed, false AS null_is_empty, n_name AS text FROM nation",
)
def record_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields end to end with their ranges, equality and hashes, and bytes as text."""
    rows = parse_column(E.encoded(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), fm.CSV), "line", fm.CSV)
    f = F.col("fields")
    second = F.get(R.ranges(f), F.lit(1))
    return rows.select(
        R.get(f, 0).cast("int").alias("n_nationkey"),
        R.joined(f).alias("joined"),
        second["start"].cast("long").alias("start"),
        second["end"].cast("long").alias("stop"),
        R.same(f, R.to_text(R.to_bytes(f))).alias("same"),
        (R.hashed(f) == R.hashed(R.project(f, [0, 1]))).alias("hashed"),
        (R.hashed(R.set_null(f, 1)) == R.hashed(R.set_field(f, 1, F.lit("")))).alias("null_is_empty"),
        R.get(R.to_text(R.to_bytes(f)), 1).alias("text"),
    )
