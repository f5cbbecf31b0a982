"""Shared plumbing: table access, cut lineage, partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local session gets a temporary folder; on a
    cluster that would lose data, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Paths of the tables that were written and not deleted yet.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when the driver ends at the latest."""
    path = f"{shared_dir(spark)}/cohortlens-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _MADE.append(path)
    return path


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder; the reread table and its path.

    Cuts lineage: a lost executor costs no recomputation of what is written.  What is not
    discarded before goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`keep` wrote."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _MADE:
        _MADE.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that :func:`keep` writes inside are deleted at the end, but for those whose paths are put in the list."""
    before, stay = set(_MADE), []
    try:
        yield stay
    finally:
        for path in [p for p in _MADE if p not in before and p not in stay]:
            discard(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_id(source: DataFrame, rest: str, name: str = "id") -> T.StructType:
    """The schema of ``source``'s id column, whatever its type, followed by the fields of a DDL text."""
    return T.StructType([T.StructField(name, source.schema["id"].dataType), *T.StructType.fromDDL(rest).fields])
