"""Corpora as partitions of one table: status, fingerprint, combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators.ranks import ordinal


def status(documents: DataFrame, group: str) -> DataFrame:
    """group, n_documents, n_chars, ready (five documents with text at least)."""
    g = documents.groupBy(group).agg(F.count(F.when(F.length(F.trim("text")) > 0, 1)).alias("n_documents"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    return g.withColumn("ready", F.col("n_documents") >= C.MIN_CORPUS_DOCS)


def fingerprint(documents: DataFrame, group: str, key: str, stamp: str) -> DataFrame:
    """group, fingerprint: changes when a document is added, removed or touched.

    Documents are hashed one by one and the hashes added up, in two 30-bit
    halves, so no list of a whole corpus is ever collected in one place.
    """
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    half = lambda i: F.sum(F.conv(F.substring(h, i, 7), 16, 10).cast("bigint"))
    return documents.groupBy(group).agg(F.concat_ws("-", half(1), half(8), F.count(F.lit(1))).alias("fingerprint"))


def pending(sources: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Sources without an output."""
    return sources.join(outputs.select(key).distinct(), key, "left_anti")


def combine(a: DataFrame, b: DataFrame, key: str, corpus: str | Column) -> DataFrame:
    """The union of two corpora; where a name clashes, the second is prefixed
    with its corpus."""
    taken = a.select(F.col(key).alias("_k")).distinct()
    renamed = b.join(taken, b[key] == taken["_k"], "left").withColumn(key, F.when(F.col("_k").isNotNull(), F.concat_ws("_", corpus, key)).otherwise(F.col(key))).drop("_k")
    return a.unionByName(renamed)


def vocabulary_size(documents: DataFrame, group: str, text: str = "text") -> DataFrame:
    """group, vocab_size: the number of distinct corpus terms of each corpus;
    counted on (group, term), which are made unique before the shuffle."""
    terms = documents.select(group, F.explode(F.array_distinct(T.corpus_tokens(text))).alias("term"))
    return terms.groupBy(group).agg(F.countDistinct("term").alias("vocab_size"))


def reading_method(confidence: Column, length: Column) -> Column:
    """``digital`` if the text layer of a page file is good enough to keep (most
    words known and not too short), else ``ocr``."""
    return F.when((confidence > C.DIGITAL_CONFIDENCE) & (length > C.DIGITAL_LENGTH), "digital").otherwise("ocr")


def combined_texts(documents: DataFrame, group: str, key: str, text: str, name: str, block: int = 65536) -> DataFrame:
    """group, position, part: the non-empty texts of a group in order, each under
    ``--- name ---``.  Parts are rows: joined with blank lines between them they are
    the combined text, which no single row has to hold."""
    rows = documents.where((F.length(text) > 0) & F.col(group).isNotNull()).select(group, key, F.concat(F.lit("--- "), F.col(name).cast("string"), F.lit(" ---\n"), text).alias("part"))
    return ordinal(rows, [group], [key], F.floor(F.col(key) / block), "position").select(group, "position", "part")
