"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`, which has the columns of
`documents` (further ones are dropped); all but the last return such rows. In every stage a null text is
empty, a text of any length is one row, rows that repeat an id or have none are documents of their own,
and an empty table gives an empty result. What that means for each operator is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import langid, line_dedup, mixing, near_dedup, packing
from spindrift.llm.common import DOCUMENT_COLUMNS, pinned, steady, table, tidy

#: A language is believed from this posterior probability.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or no believable language (operator 4).

    Null and empty texts have no letter, so they go here. Of equally probable languages the first counts."""
    steady(spark)
    tidy(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs, model, DOCUMENT_COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*DOCUMENT_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that match an earlier line (operator 6), and without documents that had no other words.

    Documents that lose no line stay as they are, whatever they hold; n_chars is that of the text left."""
    tidy(spark)
    out = line_dedup.dedup_lines(docs.select(*DOCUMENT_COLUMNS))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.withColumn("n_chars", n_chars).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 7), rows without an id or of a repeated one
    included: that of the smallest id."""
    tidy(spark)
    return near_dedup.keep_one(docs.select(*DOCUMENT_COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (operator 9): not at all, once or twice. Documents without a
    source are a source of their own."""
    tidy(spark)
    return mixing.mixed_documents(docs.select(*DOCUMENT_COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets (operator 8); a document that the mix
    takes twice has its pieces twice."""
    tidy(spark)
    return packing.pack(packing.cut_pieces(docs, packing.vocabulary_path()))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL expresses none of the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
