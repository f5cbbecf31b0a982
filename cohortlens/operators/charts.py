"""Charts of scores: one HTML page with a drawing for each sample, made by expressions and written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import chr_code, ratio

#: Width of a chromosome's column and height of the drawing, in pixels.
STEP, HEIGHT = 30, 300


def score_charts(points: DataFrame, cutoffs: tuple[float, ...] = (3.0, 4.5)) -> DataFrame:
    """(``sample``, ``html``) of tidy points (sample, chr, metric, value, point): a mark for each value over its chromosome,
    of the class of its point, and a line at each cutoff.

    A sample's points are its chromosomes by its metrics, some dozens; values without a number have no mark.
    """
    some = points.where(F.col("value").isNotNull())
    span = some.groupBy("sample").agg(F.least(F.min("value"), F.lit(min(cutoffs, default=0.0))).alias("_lo"), F.greatest(F.max("value"), F.lit(max(cutoffs, default=0.0))).alias("_hi"))
    scaled = lambda v: F.format_string("%.1f", HEIGHT - HEIGHT * F.coalesce(ratio(v - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.5)))
    mark = F.format_string('<circle class="%s" r="4" cx="%d" cy="%s"><title>%s %s %.6f</title></circle>', "point", F.coalesce(chr_code(F.col("chr")), F.lit(26)) * STEP, scaled(F.col("value")), "chr", "metric", "value")
    marks = some.join(span, "sample").select("sample", "_lo", "_hi", F.struct(chr_code(F.col("chr")), "chr", "metric", mark.alias("mark")).alias("m"))
    drawn = marks.groupBy("sample").agg(F.sort_array(F.collect_list("m")).alias("marks"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    lines = [F.concat(F.lit('<line class="cutoff" x1="0" x2="%d" ' % (27 * STEP)), F.lit('y1="'), scaled(F.lit(c)), F.lit('" y2="'), scaled(F.lit(c)), F.lit('"/>')) for c in cutoffs]
    head = F.format_string('<!DOCTYPE html><html><head><meta charset="utf-8"><title>%s</title><style>.hit{fill:#b00}.other{fill:#555}.cutoff{stroke:#999}</style></head><body>', F.col("sample").cast("string"))
    body = F.concat(F.lit(f'<svg width="{27 * STEP}" height="{HEIGHT + 10}">'), *lines, F.array_join(F.transform("marks", lambda m: m["mark"]), ""), F.lit("</svg></body></html>"))
    return drawn.select("sample", F.concat(head, body).alias("html"))


def write_charts(charts: DataFrame, path: str) -> None:
    """One file for each sample, in a folder of its name."""
    charts.select("sample", F.col("html").alias("value")).write.partitionBy("sample").text(path)
