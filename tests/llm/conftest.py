import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import ODD, SMALL  # noqa: E402

@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with ours."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("row", "line", "size", "bits", "unit", "start", "many", "node", "root", "key", "slot", "label", "score", "item_id", "least", "removed", "same", "_same", "_size", "_root", "many", "salt", "salts", "copies"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
