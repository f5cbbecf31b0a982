"""Long sweeps in shards that can be stopped and gone on with.

Each shard's sums are one folder of Parquet files, complete once Spark's committer has put its mark
there; the marks are the ledger.  A sweep scores the shards without a mark, a shard that was stopped
half-way from nothing, so none counts twice however often it is run.  What the sweep was made with is kept
beside, and going on with anything else is an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.files import write_bytes

#: Fixed value: the mark that Spark leaves in a folder whose files are all there.
MARK = "_SUCCESS"


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def finished(spark: SparkSession, path: str) -> list[int]:
    """The shards of a sweep that are complete."""
    store, at = _store(spark, f"{path}/shard=*/{MARK}")
    found = store.globStatus(at) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def run_sweep(spark: SparkSession, path: str, shards: Iterable[int], score: Callable[[int], DataFrame], made_with: dict | None = None) -> list[int]:
    """Scores and writes the shards that are not complete; returns those that it did.

    ``score`` gives a shard's additive counts.  ``made_with`` (seeds, cutoffs, sizes) must be the same each time.
    """
    text = json.dumps(made_with or {}, sort_keys=True, default=str)
    store, at = _store(spark, f"{path}/made_with-{hashlib.sha256(text.encode()).hexdigest()[:16]}.json")
    if not store.exists(at):
        if store.globStatus(_store(spark, f"{path}/made_with-*")[1]):
            raise ValueError(f"the sweep at {path} was made with other parameters")
        write_bytes(spark, text.encode(), at.toString())
    have, done = set(finished(spark, path)), []
    for shard in sorted(set(shards) - have):
        score(shard).write.mode("overwrite").parquet(f"{path}/shard={shard}")
        done.append(shard)
    return done


def summed(spark: SparkSession, path: str, keys: list[str], counts: list[str], expected: Iterable[int] | None = None) -> DataFrame:
    """Counts by keys over the complete shards; with ``expected`` a missing shard is an error."""
    have = finished(spark, path)
    missing = sorted(set(expected or ()) - set(have))
    if missing or not have:
        raise ValueError(f"shards without a result: {missing[:20]}" if missing else f"no finished shard under {path}")
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/shard={s}" for s in have if expected is None or s in set(expected)])
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
