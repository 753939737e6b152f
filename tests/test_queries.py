import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillrow import queries

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def _plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in sorted(os.listdir(SMALL)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_equal_their_sql(spark, tables, name):
    want = tables.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    rows = sorted(repr([_plain(dict(zip(want.columns, r))[c]) for c in columns]) for r in want.fetchall())
    df = queries.queries()[name](spark, SMALL)
    assert sorted(df.columns) == columns
    assert sorted(repr([_plain(v) for v in r]) for r in df.select(*columns).collect()) == rows


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    code = "import sys, importlib.abc\n" "class No(importlib.abc.MetaPathFinder):\n" "    def find_spec(self, name, path=None, target=None):\n" "        if name.startswith('quillrow.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n" "sys.meta_path.insert(0, No())\n" "import __spark_entry__ as e\n" "names = set(e.queries())\n" "assert names and not any(n.startswith('op') or n == 'pipeline' for n in names)\n"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_workers_without_the_path_are_sent_the_package():
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r})\n" "from pyspark.sql import SparkSession\n" "import __spark_entry__ as e\n" "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n" f"assert e.queries()['pred_equals'](s, {SMALL!r}).count() > 0\n"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd="/tmp", check=True, env=env)
