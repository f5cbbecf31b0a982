"""Scalar expressions with the engine's rules for absent values: never NaN, always NULL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chromosomes of the default domain, and codes of the allosomes.
AUTOSOMES = tuple(f"chr{i}" for i in range(1, 23))
ALLOSOME_CODES = {"23": "X", "24": "Y"}


def absent(x: Column) -> Column:
    """NaN to NULL."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or either is NULL."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def z_value(x: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd, NULL where sd is zero."""
    return ratio(x - mean, sd)


def number(x: Column) -> Column:
    """Coercing cast to double: what isn't a finite number is NULL."""
    value = x.cast("string").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def chr_name(x: Column) -> Column:
    """Chromosome names with the prefix ``chr`` and letters for allosomes."""
    bare = F.upper(F.regexp_replace(x.cast("string"), r"^(?i)chr", ""))
    for code, letter in ALLOSOME_CODES.items():
        bare = F.when(bare == code, letter).otherwise(bare)
    return F.concat(F.lit("chr"), bare)


def chr_order(x: Column) -> list[Column]:
    """Sort keys of the natural order: numbers first, then the others."""
    return [F.regexp_replace(x, r"^chr", "").try_cast("int").asc_nulls_last(), x.asc()]


def chr_code(x: Column) -> Column:
    """Numbers of chromosomes with X, Y and M as 23, 24 and 25."""
    bare = F.upper(F.regexp_replace(x, r"^(?i)chr", ""))
    return F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(bare.try_cast("int"))


def plain_decimal(x: Column) -> Column:
    """Thresholds as text without trailing zeros, as ``%g`` writes them: 0.5, 1, 0.05."""
    text = x.cast("decimal(18,6)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def fixed6(x: Column) -> Column:
    """Six decimals as text, NULL for NULL.

    The nearest to the double's exact value, a tie to the even digit, as C and Python print it; Java's
    formatter rounds the shortest decimal half up, which differs at ties and just below them.
    """

    @F.pandas_udf("string")
    def printed(values: pd.Series) -> pd.Series:
        return values.map("{:.6f}".format)

    return F.when(x.isNotNull(), printed(x.cast("double")))


def is_trisomy(label: Column) -> Column:
    return F.coalesce(label.rlike(r"^T\d"), F.lit(False))


def date_of(text: Column) -> Column:
    """The first YYYYMMDD in a text as a date."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"(20\d{6})", 1), F.lit("")), "yyyyMMdd")


def vector(text: Column) -> Column:
    """An array of doubles from a comma-joined cell."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))


def vector_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def logsumexp(terms: list[Column]) -> Column:
    """log(sum(exp(t))) over columns; minus infinity stands for a term that is impossible."""
    low = F.lit(float("-inf"))
    top = F.greatest(*terms)
    return F.when(top == low, low).otherwise(top + F.ln(sum([F.exp(t - top) for t in terms], F.lit(0.0))))


def safe_ln(x: Column) -> Column:
    """ln, minus infinity at zero or below (Spark's own is NULL there)."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf")))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column, empty: float | None = 0.0) -> Column:
    """Matthews correlation of counts; ``empty`` where a margin is zero."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    value = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return value if empty is None else F.coalesce(value, F.lit(empty))
