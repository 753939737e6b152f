"""Reading and writing delimited text: the functions a user calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators.scan import Document
from .plans.formats import CSV, Format
from .plans.options import ParseOptions
from .plans.predicate import Predicate
from .plans.rows import RowSchema


def read(spark: SparkSession, paths: str | list[str], fmt: Format = CSV, options: ParseOptions | None = None, *, columns: list[int | str] | None = None, predicate: Predicate | None = None, text: bool = True, location: bool = False, on_error: str = "fail") -> DataFrame:
    """Rows of files: one column a header (or chosen column), or ``fields`` where there are no headers."""
    return Document.open(spark, paths, fmt, options).scan(columns, predicate, text=text, location=location, on_error=on_error)


def read_typed(spark: SparkSession, paths: str | list[str], schema: RowSchema | type, fmt: Format = CSV, options: ParseOptions | None = None, *, predicate: Predicate | None = None, empty: str = "null", on_error: str = "fail") -> DataFrame:
    """Rows decoded by a row schema; only its columns leave the parser."""
    from pyspark.sql import functions as F

    schema = getattr(schema, "quill_schema", schema)
    document = Document.open(spark, paths, fmt, options)
    at = schema.positions(document.names)
    used = [a for a in at if a is not None]
    rows = document.scan(used, predicate)
    fields = rows.select(F.array(*[F.col(f"`{c}`") for c in rows.columns]).alias("fields"))
    names = [f.header for f, a in zip(schema.fields, at) if a is not None]
    return schema.decode(fields, names=names, empty=empty, on_error=on_error)


def decode_documents(df: DataFrame, column: str, schema: RowSchema | type, fmt: Format = CSV, options: ParseOptions | None = None, *, keep: tuple[str, ...] = (), empty: str = "null", on_error: str = "fail") -> DataFrame:
    """Rows of documents that a column holds whole, decoded by a row schema; without headers, by position."""
    from pyspark.sql import functions as F

    from .operators.scan import parse_documents

    schema = getattr(schema, "quill_schema", schema)
    options = options or ParseOptions(headers=False)
    names = list(options.headers) if isinstance(options.headers, tuple) else None
    rows = parse_documents(df, column, fmt, options, keep=keep, on_error="fail").select(*keep, "fields")
    return schema.decode(rows.where(F.col("fields").isNotNull()), names=names, empty=empty, on_error=on_error, keep=keep)


def headers(spark: SparkSession, path: str, fmt: Format = CSV, options: ParseOptions | None = None) -> list[str] | None:
    from .operators.scan import read_headers

    return read_headers(path, fmt, options or ParseOptions())[0]


def errors(spark: SparkSession, paths: str | list[str], fmt: Format = CSV, options: ParseOptions | None = None) -> DataFrame:
    """The first error of each file."""
    return Document.open(spark, paths, fmt, options).errors()


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("quillrow")`` known to a session."""
    from .sources.datasource import QuillrowSource

    spark.dataSource.register(QuillrowSource)
