import duckdb
import pytest
from cases import SMALL

from quillrow.llm import oracles, queries


def _plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(oracles.oracle_sql()[name])
    columns = sorted(want.columns)
    rows = sorted(repr([_plain(dict(zip(want.columns, r))[c]) for c in columns]) for r in want.fetchall())
    df = queries.queries()[name](spark, SMALL)
    assert sorted(df.columns) == columns
    assert sorted(repr([_plain(v) for v in r]) for r in df.select(*columns).collect()) == rows


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
