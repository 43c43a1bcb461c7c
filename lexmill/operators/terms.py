"""Corpus statistics and BM25 term scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..session import materialize


def term_frequency(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, first position and the number of tokens of the text; counts
    are combined where the rows arise, before the shuffle on (key, term)."""
    # the size goes along inside, as a filter on it would cut the text into tokens again
    sized = T.let(T.vocabulary_tokens(text), lambda t: F.transform(t, lambda w, i: F.struct(w.alias("term"), i.alias("pos"), F.size(t).alias("n"))))
    rows = df.select(key, F.explode(sized).alias("x")).select(key, F.col("x.n").alias("doc_tokens"), "x.pos", "x.term")
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"), F.first("doc_tokens").alias("doc_tokens"))


def document_frequency(df: DataFrame, text: str) -> DataFrame:
    """term, df over all texts; each text gives its distinct terms."""
    return df.select(F.explode(F.array_distinct(T.corpus_tokens(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: DataFrame, text: str) -> DataFrame:
    """term, df, idf = ln((N - df + 0.5) / (df + 0.5) + 1), four decimals.

    Texts are cut into tokens once: every text with a token gives an empty term as
    well, whose count is N."""
    marked = T.let(F.array_distinct(T.corpus_tokens(text)), lambda t: F.when(F.size(t) > 0, F.array_append(t, F.lit(""))))
    counts = materialize(df.select(F.explode(marked).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    one = counts.where("term = ''").select(F.col("df").alias("n_docs"))  # a single row
    return counts.where("term <> ''").crossJoin(F.broadcast(one)).select("term", "df", F.round(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 4).alias("idf"))


def bm25_terms(df: DataFrame, key: str, text: str, weights: DataFrame) -> DataFrame:
    """The best terms of each text against a corpus.

    ``weights``: term, idf.  Unknown terms weigh ``OOV_IDF``.  Scores below the
    threshold fall away; the top hundred by the score of four decimals stay,
    ties by first position.
    """
    tf = term_frequency(df, key, text).where(~F.col("term").rlike(r"^(.)\1*$"))
    joined = tf.join(weights.select("term", "idf"), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(C.OOV_IDF)))
    size = 1 - C.B + C.B * F.col("doc_tokens") / C.AVERAGE_DOC_LENGTH
    score = F.col("idf") * F.col("tf") * (C.K1 + 1) / (F.col("tf") + C.K1 * size)
    top = W.partitionBy(key).orderBy(F.desc("score"), F.asc("pos"))
    return (
        joined.withColumn("raw", score)
        .where(F.col("raw") >= C.MIN_BM25_SCORE)
        .withColumn("score", F.round("raw", 4))
        .withColumn("rank", F.row_number().over(top))
        .where(F.col("rank") <= C.MAX_BM25_TERMS)
        .select(key, "term", "tf", "score", F.round(F.least(F.col("score") / 15, F.lit(1.0)), 4).alias("confidence"), "rank")
    )


def dictionary_confidence(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """key, n_tokens, n_known, confidence: the share of letter-only tokens that
    are in a word list, in percent; 0 without tokens.

    Distinct tokens of a text are counted inside its row; the word list is
    joined on the word, whatever its size.
    """
    found = F.regexp_extract_all(T.ascii_words(text), F.lit(r"\b[a-zA-Z]+\b"), 0)
    toks = df.select(key, F.coalesce(found, F.array().cast("array<string>")).alias("t"))
    pairs = toks.select(key, F.explode("t").alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    known = pairs.join(words.select("word").distinct(), "word").groupBy(key).agg(F.sum("n").alias("n_known"))
    out = toks.select(key, F.size("t").alias("n_tokens")).distinct().join(known, key, "left").withColumn("n_known", F.coalesce("n_known", F.lit(0)))
    return out.withColumn("confidence", F.when(F.col("n_tokens") > 0, F.round(F.col("n_known") * 100 / F.col("n_tokens"), 4)).otherwise(0.0))
