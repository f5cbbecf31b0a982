"""Global order numbers and exact quantiles without one task that sees everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.sources.files import scratch


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their number from 1 in an order that tells all of them apart.

    Rows are dealt into ranges of the order and written, so that the ranges stay what they are;
    each range numbers its own, and the sizes of those before it (one row a range) are added.
    """
    spark = rows.sparkSession
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = rows.repartitionByRange(ranges, *columns).withColumn("_range", F.spark_partition_id())
    tagged.write.parquet(path := scratch(spark, "ranges"))
    held = spark.read.schema(tagged.schema).parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    sizes = held.groupBy("_range").agg(F.count("*").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).select("_range", "_before")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*columns))
    return held.withColumn(name, own).join(F.broadcast(sizes), "_range").withColumn(name, F.col(name) + F.col("_before")).select(*rows.columns, name)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(``keys``, names of ``at``): quantiles with linear interpolation, equal to ``percentile``, of non-null values.

    A mergeable sketch brackets each quantile; the values inside its bracket (some ``1 / accuracy`` of a key's
    rows) are counted by value and the wanted ones are picked by their number, from the exact count
    below the bracket on.  A bracket that misses, which the sketch's error can bring about, is checked
    for and that key is done again without limits.  A key's rows never come together in a task.
    """
    spark = rows.sparkSession
    rows = rows.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v")).where("_v is not null")
    rows.write.parquet(path := scratch(spark, "values"))
    held = spark.read.schema(rows.schema).parquet(path)
    if not keys:
        held, keys_in = held.withColumn("_all", F.lit(0)), ["_all"]
    else:
        keys_in = keys
    names, margin = list(at), 2.0 / accuracy
    ends = [max(0.0, at[n] - margin) for n in names] + [min(1.0, at[n] + margin) for n in names]
    sketch = held.groupBy(*keys_in).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), accuracy).alias("_e"))
    known = sketch.select(*keys_in, "_n", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(at[n]).alias("q"), F.col("_e")[i].alias("lo"), F.col("_e")[len(names) + i].alias("hi")) for i, n in enumerate(names)])).alias("_i", "_b"))
    known = known.select(*keys_in, "_n", "_b.*").withColumn("_at", F.col("q") * (F.col("_n") - 1))
    # the ends of the whole range have no neighbour that a bracket could leave out
    known = known.withColumn("lo", F.when(F.col("q") - margin <= 0, F.lit(float("-inf"))).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("q") + margin >= 1, F.lit(float("inf"))).otherwise(F.col("hi")))
    known.write.parquet(path := scratch(spark, "brackets"))
    known = spark.read.schema(known.schema).parquet(path)
    found, missed = _picked(held, known, keys_in)
    if not missed.isEmpty():
        wide = known.join(missed.select(*keys_in, "name"), [*keys_in, "name"], "left_semi").withColumn("lo", F.lit(float("-inf"))).withColumn("hi", F.lit(float("inf")))
        found = found.unionByName(_picked(held, wide, keys_in)[0])
    out = found.groupBy(*keys_in).agg(*[F.max(F.when(F.col("name") == n, F.col("_value"))).alias(n) for n in names])
    return out.select(*keys, *names)


def _picked(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, name, _value) of brackets that hold both values that are interpolated, and the brackets that don't."""
    spark = rows.sparkSession
    of_key = brackets.groupBy(*keys).agg(F.collect_list(F.struct("name", "lo", "hi")).alias("_b"))  # as many as quantiles
    side = F.when(F.col("_v") < F.col("_c.lo"), F.lit(None).cast("double")).otherwise(F.col("_v"))
    # values above a bracket are left out; those below it are counted as one
    counted = rows.join(of_key, keys).select(*keys, "_v", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["hi"])).alias("_c")).select(*keys, F.col("_c.name").alias("name"), side.alias("_v")).groupBy(*keys, "name", "_v").agg(F.count("*").alias("_k"))
    upto = Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("_v"))
    placed = counted.withColumn("_last", F.sum("_k").over(upto) - 1).withColumn("_first", F.col("_last") - F.col("_k") + 1)
    wanted = placed.join(brackets.select(*keys, "name", "_at"), [*keys, "name"])
    low, high = F.floor("_at"), F.ceil("_at")
    holds = lambda x: F.max(F.when((F.col("_first") <= x) & (F.col("_last") >= x), F.col("_v")))
    got = wanted.groupBy(*keys, "name").agg(F.first("_at").alias("_at"), holds(low).alias("_low"), holds(high).alias("_high"))
    value = F.when(low == high, F.col("_low")).otherwise((high - F.col("_at")) * F.col("_low") + (F.col("_at") - low) * F.col("_high"))
    got = brackets.select(*keys, "name").join(got.withColumn("_value", value), [*keys, "name"], "left").select(*keys, "name", "_value")
    got.write.parquet(path := scratch(spark, "picked"))
    got = spark.read.schema(got.schema).parquet(path)
    return got.where("_value is not null"), got.where("_value is null")
