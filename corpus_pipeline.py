"""A corpus pipeline of five stages, from documents to a mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.decontaminate import decontaminate
from ledgerline.llm.language_id import accepted_languages
from ledgerline.llm.line_dedup import drop_boilerplate, text_lines
from ledgerline.llm.mixing import with_copies, word_count
from ledgerline.llm.near_dedup import without_near_duplicates
from ledgerline.llm.store import table, written


#: A line is boilerplate if it is on more than this percentage of its source's documents (see line_dedup.PERCENT).
STAGE_PERCENT = 5


def _row(docs: DataFrame) -> DataFrame:
    """Each row in one column, so that no name of docs meets one of an operator's."""
    return docs.select(F.struct("*").alias("row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return accepted_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate in their source; n_chars is counted anew."""
    clean = drop_boilerplate(_row(docs), text_lines(F.col("row.text")), F.col("row.source"), STAGE_PERCENT)
    text = F.when(F.col("row.text").isNotNull(), F.col("clean_text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return clean.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least doc_id."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its copies say, with the number of the copy; a column named copy is replaced."""
    mixed = with_copies(_row(docs), F.col("row.source"), word_count(F.col("row.text")), F.xxhash64("row.doc_id", "row.text"))
    copies = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "copy"], "copy")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing", mixing)]

#: Trained and iterative stages are beyond SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
