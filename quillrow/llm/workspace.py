"""Tables written to the cluster's shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import shared_folder

_written: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/quillrow/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage beyond files every executor can read, so a lost executor costs a
    reread and not a recomputation.  Unlike persist(), nothing is held by an executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.quill_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for table in tables:
        drop(table.sparkSession, table.quill_path)


def drop(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, every write or action deletes its shuffle files as it ends.

    ``release`` can only ask the garbage collector: what still refers to a plan, such as a listener
    that lags behind, keeps the plan's files.  Make tables that are returned outside, or their
    second reader finds no files and runs the stages again.
    """
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of plans that are no longer referred to.

    The cleaner follows the driver's garbage collections, which may be hours apart; after a phase
    has been written to the shared folder its shuffle files are of no more use.  The first round
    lets go of what Python holds in the JVM, the second of the plans that only hung on that.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
