"""A training-corpus pipeline: language, near-duplicates, benchmark passages, personal data, pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontam, langid, pii, simhash, sp_sampling
from cohortlens.llm.common import discard, keep, scratch, table
from cohortlens.llm.queries import PIECES

#: A document goes if no language could be told, or if the told one has less than this score.
LEAST_LANGUAGE_SCORE = 0.3


def _carried(docs: DataFrame) -> DataFrame:
    """The rest of the row as one column beside the text, so that an operator passes both on without a join."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").alias("text"))


def _unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns back from :func:`_carried`, some of them with new values."""
    return rows.select(*[new.get(c, F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set ``lang`` to the predicted language; documents without one, or with a weak one, go.

    Null and empty texts, and those without letters, have none and go; without labelled rows all
    go; repeated rows stay; other columns stay as they are, whatever their names.
    """
    found = langid.identify(_carried(docs), langid.fit(docs), id_col="row", with_text=True)
    sure = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return _unpacked(sure, docs.columns, lang=F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a Jaccard similarity of 0.8 or more of words in fives) one document stays, the one with the smallest id.

    Candidates come from SimHashes and are checked exactly (:func:`simhash.near_copies`).
    Documents without an id stay only if none of their group has one; of rows with equal ids
    and texts one stays; texts without words are one group.
    """
    prints = F.xxhash64(F.lit(1), "doc_id", "text"), F.xxhash64(F.lit(2), "text", "doc_id")  # both together tell rows apart
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), prints[0].alias("a"), prints[1].alias("b")).alias("row"), F.col("text").alias("text"))
    groups = simhash.near_copies(named, id_col="row", shingle=5)
    first = groups.where(F.col("row") == F.col("component_id")).select("row.a", "row.b").distinct()
    rows = docs.select(F.struct("*").alias("row"), prints[0].alias("a"), prints[1].alias("b"))
    return rows.join(first, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go, or a whole item that has fewer.

    Null and empty texts share nothing and stay, as all do if the benchmark is empty; repeated rows stay.
    """
    found = decontam.contamination(_carried(docs), table(spark, sf_dir, "benchmark"), id_col="row", with_text=True)
    return _unpacked(found.where(F.size("spans") == 0), docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes ``<KIND>``; ``n_chars`` follows the text (null of a null text). All rows stay."""
    clean = pii.redact(docs)
    return clean.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, best first; one without pieces for a null or empty text."""
    return sp_sampling.encode(docs, PIECES)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("pieces", sample_pieces),
]

#: Components and sampling aren't expressible in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again; what a stage has written beside them is deleted after it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as stay:
            docs, path = keep(stage(spark, docs, sf_dir), name)
            stay.append(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
