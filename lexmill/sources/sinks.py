"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shorten(text: str, n: int) -> Column:
    """The first ``n`` characters and three dots."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def vocabulary_csv(vocab: DataFrame, path: str, layout: str = "all") -> None:
    """``all`` columns, the ``basic`` ones, or ``terms_only``."""
    cols = {"all": vocab.columns, "basic": ["term", "type", "quality_score"], "terms_only": ["term"]}[layout]
    vocab.select(*cols).write.mode("overwrite").option("header", "true").csv(path)


FEEDBACK_SCHEMA = "feedback_ts timestamp_ntz, document_id string, term string, feedback int, term_type string, algorithms string, quality_score double, in_case_freq int, freq_rank int"


def append_feedback(log: DataFrame, path: str) -> None:
    """Rows added to a feedback log; the columns are those of ``FEEDBACK_SCHEMA``."""
    names = [c.split(" ")[0] for c in FEEDBACK_SCHEMA.split(", ")]
    log.select(*names).write.mode("append").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK_SCHEMA).parquet(path)


def chunk_store(chunks: DataFrame, path: str, case: str = "case_id") -> None:
    """Chunks by case, so that one case is read without the others."""
    chunks.repartition(case, F.pmod(F.xxhash64(*chunks.columns[:2]), F.lit(8))).write.mode("append").partitionBy(case).parquet(path)


def answers_text(answers: DataFrame, path: str, group: str, order: str) -> None:
    """Question and answer blocks as text files, by group."""
    block = F.concat(F.lit("Q: "), "question_text", F.lit("\nA: "), F.coalesce("answer_text", F.lit("")), F.lit("\n"))
    answers.repartition(group).sortWithinPartitions(group, order).select(group, block.alias("value")).write.mode("overwrite").partitionBy(group).text(path)


def debug_rows(df: DataFrame, key: list[str], text: str = "chunk_text") -> DataFrame:
    """Work rows with shortened texts."""
    return df.select(*key, shorten(text, 100).alias(text), shorten("chunk_summary", 75).alias("chunk_summary"), shorten("progressive_summary", 75).alias("progressive_summary"))
