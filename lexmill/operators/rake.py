"""Key phrases by word co-occurrence (Rose et al. 2010)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def phrases(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, phrase of one to three content words, in order, repeats kept.

    Texts are cut at stop words and punctuation; our own stop list is used.
    """
    words = F.split(F.regexp_replace(F.lower(T.rake_text(text)), r"[^\p{L}\p{N}'\- ]+", " | "), " +")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(C.STOP_VOCAB), "|").otherwise(w)), " ")
    parts = F.transform(F.split(marked, r"\|"), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: (p != "") & (F.size(F.split(p, " ")) <= C.RAKE_MAX_WORDS))
    return df.select(key, F.posexplode(good).alias("pos", "phrase"))


def rake(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, phrase, score = sum of degree/frequency of its words, rank.

    Phrases are cut once and brought together by text; all that follows is counted
    inside that partitioning, without another shuffle.
    """
    p = phrases(df, key, text).repartition(key).groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("times"), F.min("pos").alias("pos"))
    words = p.select("*", F.explode(F.split("phrase", " ")).alias("word"), F.size(F.split("phrase", " ")).alias("n"))
    of = W.partitionBy(key, "word")
    weighed = words.withColumn("weight", F.sum(F.col("n") * F.col("times")).over(of) / F.sum("times").over(of))
    scored = weighed.groupBy(key, "phrase").agg(F.sum("weight").alias("score"), F.first("pos").alias("pos"))
    good = scored.where((F.round("score", 9) >= C.RAKE_MIN_SCORE) & F.length("phrase").between(2, 50) & F.col("phrase").rlike("[a-zA-Z]"))
    top = W.partitionBy(key).orderBy(F.desc(F.round("score", 9)), F.desc("phrase"))
    return good.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= C.RAKE_MAX_PHRASES).select(key, "phrase", F.round("score", 6).alias("score"), "rank")


def clean_phrase(phrase):
    """One junk word off the front, the first letter in upper case."""
    p = F.trim(F.regexp_replace(phrase, "(?i)^(?:" + "|".join(C.RAKE_JUNK_STARTS) + ") ", ""))
    return F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 100))
