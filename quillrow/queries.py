"""The registered queries of the library and the SQL they are held against."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decode as D
from .functions import encode as E
from .functions import record as R
from .operators import roundtrip
from .operators.scan import parse_column, parse_documents
from .operators.segments import segments
from .plans import formats as fm
from .plans import predicate as P
from .plans.options import ParseOptions
from .plans.rows import column, row

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, sql: str | None = None):
    def mark(f):
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return mark


_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_DECIMALS = {c: "decimal(18,2)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}


def lineitem_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip.as_text(_t(spark, sf_dir, "lineitem"), _DECIMALS)


@_register(
    "flagship_scan",
    "SELECT l_linestatus, count(*) AS n, sum(l_orderkey) AS sum_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_price FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, parse strictly with a predicate and three columns, decode, aggregate."""
    rows = roundtrip.through_text(lineitem_text(spark, sf_dir), fm.CSV, columns=["l_orderkey", "l_extendedprice", "l_linestatus"], predicate=P.equals("l_returnflag", "R"))
    return (
        rows.select("l_linestatus", D.integer(F.col("l_orderkey")).alias("k"), F.col("l_extendedprice").cast("decimal(18,2)").alias("p"))
        .groupBy("l_linestatus")
        .agg(F.count("*").alias("n"), F.sum("k").alias("sum_orderkey"), F.sum("p").alias("sum_price"))
    )


# -- every preset, there and back -------------------------------------------------------------------

def _roundtrip(name: str, fmt: fm.Format) -> None:
    documents = "doc_id, text, lang, source"
    blank = "trim(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13))" if name == "trimmed_csv" else "text"
    sql = f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {blank} AS text, lang, source FROM documents"
    if name == "python_csv":
        sql = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN regexp_matches(text, '[,\"\\n\\r]') THEN text ELSE ltrim(text, ' ') END AS text, lang, source FROM documents"
    _register(f"roundtrip_{name}", sql)(lambda spark, sf_dir: roundtrip.through_text(_t(spark, sf_dir, "documents").select(*documents.split(", ")), fmt))


for _name, _fmt in fm.PRESETS.items():
    _roundtrip(_name, _fmt)

_register("roundtrip_pages", "SELECT CAST(page_id AS VARCHAR) AS page_id, url, html FROM pages")(lambda spark, sf_dir: roundtrip.through_text(_t(spark, sf_dir, "pages"), fm.CSV))
_register("roundtrip_conversations_rfc4180", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations")(
    lambda spark, sf_dir: roundtrip.through_text(_t(spark, sf_dir, "conversations"), fm.RFC4180)
)
_register("roundtrip_events", "SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR) AS value, props FROM events")(
    lambda spark, sf_dir: roundtrip.through_text(roundtrip.as_text(_t(spark, sf_dir, "events"), {"value": "decimal(18,4)"}), fm.SEMICOLON)
)
_register("roundtrip_multibyte", "SELECT CAST(page_id AS VARCHAR) AS page_id, url, html FROM pages")(
    lambda spark, sf_dir: roundtrip.through_text(_t(spark, sf_dir, "pages"), fm.CSV.but(delimiter=b"||", record_ending=b"~~\n", quoting=fm.Quoting.ALWAYS))
)
_register("roundtrip_byte_ending", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")(
    lambda spark, sf_dir: roundtrip.through_text(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), fm.CSV.but(record_ending=b"\x1e"))
)


# -- emission ---------------------------------------------------------------------------------------

def _sql_quoted(c: str) -> str:
    return f"'\"' || replace({c}, '\"', '\"\"') || '\"'"


def _sql_necessary(c: str) -> str:
    return f"CASE WHEN {c} LIKE '%,%' OR {c} LIKE '%\"%' OR {c} LIKE '%' || chr(10) || '%' OR {c} LIKE '%' || chr(13) || '%' THEN {_sql_quoted(c)} ELSE {c} END"


def _emit(name: str, fmt: fm.Format, sql: str) -> None:
    _register(name, sql)(lambda spark, sf_dir: E.encoded(_t(spark, sf_dir, "documents").select("doc_id", "text", "source"), fmt, keep=("doc_id",), ending=False).select("doc_id", F.md5("line").alias("digest"), F.octet_length("line").alias("n_bytes")))


def _emit_sql(line: str) -> str:
    return f"SELECT doc_id, md5({line}) AS digest, strlen({line}) AS n_bytes FROM documents"


_emit("emit_necessary", fm.CSV, _emit_sql(f"CAST(doc_id AS VARCHAR) || ',' || {_sql_necessary('text')} || ',' || {_sql_necessary('source')}"))
_emit("emit_always", fm.CSV.but(quoting=fm.Quoting.ALWAYS), _emit_sql(f"{_sql_quoted('CAST(doc_id AS VARCHAR)')} || ',' || {_sql_quoted('text')} || ',' || {_sql_quoted('source')}"))
_emit("emit_non_numeric", fm.CSV.but(quoting=fm.Quoting.NON_NUMERIC), _emit_sql(f"CAST(doc_id AS VARCHAR) || ',' || CASE WHEN regexp_full_match(text, '[+-]?[0-9]+([.][0-9]*)?') THEN text ELSE {_sql_quoted('text')} END || ',' || {_sql_quoted('source')}"))
_emit("emit_raw", fm.TSV.but(quoting=fm.Quoting.RAW), _emit_sql("CAST(doc_id AS VARCHAR) || chr(9) || text || chr(9) || source"))
_emit("emit_backslash", fm.BACKSLASH_CSV.but(quoting=fm.Quoting.ALWAYS), _emit_sql("'\"' || doc_id || '\",\"' || replace(replace(text, '\\', '\\\\'), '\"', '\\\"') || '\",\"' || source || '\"'"))
_emit("emit_mysql", fm.MYSQL, _emit_sql("doc_id || chr(9) || replace(replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), '\"', '\\\"') || chr(9) || source"))


# -- predicates and projections ---------------------------------------------------------------------

def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _predicate(name: str, test: P.Predicate, where: str) -> None:
    sql = f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part WHERE {where}"
    _register(name, sql)(lambda spark, sf_dir: roundtrip.through_text(_part(spark, sf_dir), fm.CSV, predicate=test))


_predicate("pred_equals", P.equals("p_size", "7"), "p_size = 7")
_predicate("pred_contains", P.contains("p_name", "a"), "contains(p_name, 'a')")
_predicate("pred_starts_with", P.starts_with("p_brand", "Brand#1"), "starts_with(p_brand, 'Brand#1')")
_predicate("pred_ends_with", P.ends_with("p_type", "L"), "ends_with(p_type, 'L')")
_predicate("pred_by_index", P.equals(4, "12"), "p_size = 12")
_predicate("pred_missing_header", P.equals("no_such_column", "x"), "false")


@_register("pred_as_column", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey FROM part WHERE contains(p_name, 'e')")
def pred_as_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same predicate evaluated by Spark on records of bytes."""
    lines = E.encoded(_part(spark, sf_dir), fm.CSV)
    rows = parse_column(lines, "line", fm.CSV, text=False)
    return rows.where(P.contains(1, "e").condition(F.col("fields"), 1)).select(R.get(F.col("fields"), 0).cast("string").alias("p_partkey"))


_register("project_names", "SELECT p_type, p_brand, CAST(p_partkey AS VARCHAR) AS p_partkey FROM part")(lambda spark, sf_dir: roundtrip.through_text(_part(spark, sf_dir), fm.PIPE, columns=["p_type", "p_brand", "p_partkey"]))


@_register("project_reordered_short", "SELECT p_brand AS second, p_name AS first, CAST(NULL AS VARCHAR) AS ninth, p_name AS again FROM part")
def project_reordered_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = E.encoded(_part(spark, sf_dir).select("p_name", "p_brand"), fm.CSV)
    rows = parse_column(lines, "line", fm.CSV, columns=[1, 0, 8, 0])
    return rows.toDF("second", "first", "ninth", "again")


# -- NULLs ------------------------------------------------------------------------------------------

_NULLED = "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN '' ELSE l_returnflag END"


def _nulls(name: str, fmt: fm.Format) -> None:
    sql = f"SELECT count(*) AS n, count(v) AS not_null, sum(CASE WHEN v = '' THEN 1 ELSE 0 END) AS empty, l_linenumber FROM (SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, {_NULLED} AS v FROM lineitem) GROUP BY l_linenumber"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _t(spark, sf_dir, "lineitem").selectExpr("l_linenumber", f"{_NULLED} AS v")
        return roundtrip.through_text(rows, fmt).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("v").alias("not_null"), F.sum(F.when(F.col("v") == "", 1).otherwise(0)).alias("empty"))

    _register(name, sql)(query)


_nulls("null_postgres", fm.POSTGRES_COPY_CSV)
_nulls("null_mysql", fm.MYSQL)


@_register("null_literal_mysql", "SELECT count(*) AS n, count(v) AS not_null FROM (SELECT CASE WHEN p_size % 2 = 0 THEN '\\N' END AS v FROM part)")
def null_literal_mysql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that spells the NULL marker stays a field."""
    rows = _t(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_size % 2 = 0 THEN '\\\\N' END AS v")
    return roundtrip.through_text(rows, fm.MYSQL).agg(F.count("*").alias("n"), F.count("v").alias("not_null"))


# -- typed decoding ---------------------------------------------------------------------------------

_SAMPLES = ["1", "+7", "-3", " 12 ", "12 ", "1d", "0x1", "", "007", "1e3", "-1.5E-2", ".5", "5.", ".", "inf", "NaN", "128", "-129", "true", "0", "yes", "t", "99999999999999999999", "18446744073709551615"]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, s): the samples repeated over the keys of part, through text."""
    pick = F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("p_partkey") % len(_SAMPLES) + 1).cast("int"))
    return roundtrip.through_text(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), pick.alias("s")), fm.CSV.but(quoting=fm.Quoting.ALWAYS))


_SAMPLE_SQL = "WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS k, list_extract([" + ", ".join(f"'{s}'" for s in _SAMPLES) + f"], CAST(p_partkey % {len(_SAMPLES)} + 1 AS INTEGER)) AS s FROM part) "
_INT = "CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN TRY_CAST(s AS HUGEINT) END"


@_register("decode_strict_int", _SAMPLE_SQL + f"SELECT k, s, CAST(CASE WHEN ({_INT}) BETWEEN -128 AND 127 THEN {_INT} END AS TINYINT) AS i8, CAST(CASE WHEN ({_INT}) BETWEEN -9223372036854775808 AND 9223372036854775807 THEN {_INT} END AS BIGINT) AS i64, CAST(CASE WHEN regexp_full_match(s, '[+]?[0-9]+') AND ({_INT}) <= 255 THEN {_INT} END AS SMALLINT) AS u8, CAST(CASE WHEN regexp_full_match(s, '[+]?[0-9]+') AND ({_INT}) <= 18446744073709551615 THEN {_INT} END AS DECIMAL(20,0)) AS u64 FROM x")
def decode_strict_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return _samples(spark, sf_dir).select("k", "s", D.integer(s, "byte", "null").alias("i8"), D.integer(s, "long", "null").alias("i64"), D.integer(s, "u8", "null").alias("u8"), D.integer(s, "u64", "null").alias("u64"))


@_register("decode_strict_float", _SAMPLE_SQL + "SELECT k, s, CASE WHEN regexp_full_match(s, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AND abs(TRY_CAST(s AS DOUBLE)) < 1e15 THEN CAST(TRY_CAST(s AS DOUBLE) AS DECIMAL(38,6)) END AS f64, regexp_full_match(lower(s), '[+-]?(inf|infinity|nan)') AS special FROM x")
def decode_strict_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.floating(F.col("s"), "double", "null")
    special = F.coalesce(F.isnan(f) | (f == F.lit(float("inf"))) | (f == F.lit(float("-inf"))), F.lit(False))
    return _samples(spark, sf_dir).select("k", "s", F.when(~special & (F.abs(f) < 1e15), f).cast("decimal(38,6)").alias("f64"), special.alias("special"))


@_register("decode_strict_bool", _SAMPLE_SQL + "SELECT k, s, CASE WHEN s IN ('true', '1') THEN true WHEN s IN ('false', '0') THEN false END AS b, CASE WHEN length(s) = 1 THEN s END AS c FROM x")
def decode_strict_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return _samples(spark, sf_dir).select("k", "s", D.boolean(s, "null").alias("b"), D.character(s, "null").alias("c"))


@_register("decode_empty_modes", _SAMPLE_SQL + "SELECT k, NULLIF(s, '') AS native, s AS kept, CASE WHEN s = '' THEN 'none' ELSE s END AS defaulted FROM x")
def decode_empty_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return _samples(spark, sf_dir).select("k", D.decoded(s, "string", optional=True).alias("native"), D.decoded(s, "string", optional=True, empty="value").alias("kept"), D.decoded(s, "string", default="none").alias("defaulted"))


@row(rename_all="SCREAMING_SNAKE_CASE")
@dataclasses.dataclass
class Customer:
    c_custkey: int
    c_name: str
    segment: str = column(alias=("C_MKTSEGMENT",))
    c_nationkey: int | None = None
    note: str = column(default="-")
    hidden: str = column(skip=True)


@_register("decode_row_schema", "SELECT c_custkey, c_name, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS c_nationkey, '-' AS note FROM customer")
def decode_row_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _t(spark, sf_dir, "customer").select("c_mktsegment", "c_name", "c_custkey", "c_nationkey")
    names = [c.upper() for c in source.columns]
    rows = parse_column(E.encoded(source, fm.CSV), "line", fm.CSV)
    return Customer.quill_schema.decode(rows, names=names)


# -- folds, records, segments, errors, chunks -------------------------------------------------------

@_register("fold_sum_by_key", "SELECT l_suppkey, sum(l_orderkey) AS sum_orderkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def fold_sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roundtrip.through_text(lineitem_text(spark, sf_dir), fm.PIPE, columns=["l_suppkey", "l_orderkey"])
    return rows.select(D.integer(F.col("l_suppkey")).alias("l_suppkey"), D.integer(F.col("l_orderkey")).alias("k")).groupBy("l_suppkey").agg(F.sum("k").alias("sum_orderkey"), F.count("*").alias("n"))


@_register("record_changes", "SELECT CAST(n_nationkey AS VARCHAR) AS key, 'X' AS changed, n_name AS name, 4 AS pushed, true AS nulled, 2 AS cut FROM nation")
def record_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_column(E.encoded(_t(spark, sf_dir, "nation"), fm.CSV), "line", fm.CSV)
    f = F.col("fields")
    changed = R.set_field(f, 2, F.lit("X"))
    return rows.select(
        R.get(f, 0).alias("key"),
        R.get(changed, 2).alias("changed"),
        R.get(changed, 1).alias("name"),
        R.length(R.push_field(f, F.lit("more"))).alias("pushed"),
        R.is_null(R.push_null(R.set_null(f, 0)), 0).alias("nulled"),
        R.length(R.truncate(f, 2)).alias("cut"),
    )


@_register(
    "segments_rollover",
    """
WITH RECURSIVE sized AS (
  SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i, o_orderstatus,
    strlen(CAST(o_orderkey AS VARCHAR)) + strlen(CAST(o_custkey AS VARCHAR)) + 2 AS s FROM orders),
walk AS (
  SELECT o_orderstatus, o_orderkey, i, s AS held, CAST(0 AS BIGINT) AS segment FROM sized WHERE i = 1
  UNION ALL
  SELECT b.o_orderstatus, b.o_orderkey, b.i, CASE WHEN a.held + b.s > 4096 - 21 THEN b.s ELSE a.held + b.s END,
    CASE WHEN a.held + b.s > 4096 - 21 THEN a.segment + 1 ELSE a.segment END
  FROM walk a JOIN sized b ON b.o_orderstatus = a.o_orderstatus AND b.i = a.i + 1)
SELECT o_orderstatus, segment, count(*) AS n, min(o_orderkey) AS first FROM walk GROUP BY o_orderstatus, segment""",
)
def segments_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(_t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_custkey"), "o_orderkey", 4096, group="o_orderstatus")
    return rows.groupBy("o_orderstatus", "segment").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


_MALFORMED = {
    "unexpected_quote": (b'a,b"c\n', fm.CSV),
    "after_quote": (b'x\n"closed"x\n', fm.CSV),
    "unterminated": (b'a\nb,"open', fm.CSV),
    "line_five": (b'a\n"1\n2\n3"\nbad"record\n', fm.CSV),
    "bare_lf": (b"a\r\nb\nc\r\n", fm.RFC4180),
    "bare_cr": (b"a\rb\r\n", fm.RFC4180),
    "bom": (b"\xef\xbb\xbfa\r\n", fm.RFC4180),
    "escape": (b'"a\\x"\n', fm.BACKSLASH_CSV),
    "width": (b"a,b,c\n1,2\n", fm.CSV),
}
_FOUND = {
    "unexpected_quote": ("UnexpectedQuote", 3, 1, 0, 1),
    "after_quote": ("UnexpectedByteAfterQuote", 10, 2, 1, 1),
    "unterminated": ("UnterminatedQuotedField", 9, 2, 1, 1),
    "line_five": ("UnexpectedQuote", 13, 5, 2, 0),
    "bare_lf": ("InvalidRecordEnding", 4, 2, 1, 0),
    "bare_cr": ("InvalidRecordEnding", 1, 1, 0, 0),
    "bom": ("RejectedBom", 0, 1, 0, 0),
    "escape": ("InvalidEscape", 3, 1, 0, 0),
    "width": ("FieldCountMismatch", 10, 3, 1, 2),
}


@_register("error_locations", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', CAST({b} AS BIGINT), CAST({li} AS BIGINT), CAST({r} AS BIGINT), CAST({f} AS BIGINT))" for n, (k, b, li, r, f) in _FOUND.items()) + ") AS t(name, kind, byte, line, record, field)")
def error_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, (body, fmt) in _MALFORMED.items():
        one = spark.createDataFrame([(name, bytearray(body))], "name string, body binary")
        found = parse_documents(one, "body", fmt, ParseOptions(headers=False, field_count="match_first"), keep=("name",), on_error="prefix")
        out = found if out is None else out.unionByName(found)
    return out.where("_error IS NOT NULL").select("name", "_error.*")


@_register("incremental_chunks", "SELECT CAST(doc_id AS VARCHAR) AS stream, md5(text) AS digest FROM documents")
def incremental_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut in chunks of 997 bytes, as (stream, seq, chunk, last)."""
    from .streaming.chunks import records_of

    lines = E.encoded(_t(spark, sf_dir, "documents").select("doc_id", "text"), fm.CSV, keep=("doc_id",))
    n = F.ceil(F.octet_length("line") / 997)
    chunks = lines.select("doc_id", "line", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("seq")).select(
        F.col("doc_id").alias("stream"), "seq", F.substring("line", (F.col("seq") * 997 + 1).cast("int"), F.lit(997)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("last")
    )
    found = records_of(chunks, fm.CSV)
    return found.select("stream", F.md5(F.get("fields", F.lit(1))).alias("digest"))


@_register("file_roundtrip", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as files to the shared folder and read back with a predicate."""
    from . import api
    from .queries_files import scratch
    from .sources import writer

    folder = scratch(spark, "orders")
    writer.write(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), folder, fm.EXCEL)
    return api.read(spark, folder, fm.EXCEL, predicate=P.equals("o_orderstatus", "F"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_files  # noqa: F401 - registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import queries_files  # noqa: F401

    return dict(_oracles)
