"""Progressive summaries: batch boundaries, contexts and reduce batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .ranks import ordinal, running


#: Chunks of a document that one task puts in order.
BLOCK = 65536


def section_runs(df: DataFrame, doc: str = "source_document", num: str = "chunk_num", section: str = "section_detected") -> DataFrame:
    """doc, run, section, first and last chunk, n: islands of one section.  Chunks meet
    the one before by a join on their place; a document is put in order in blocks."""
    rows = df.where(F.col(doc).isNotNull()).select(doc, num, F.coalesce(section, F.lit("")).alias("section"))
    placed = ordinal(rows, [doc], [num, "section"], F.floor(F.coalesce(F.col(num), F.lit(0)) / BLOCK), "_at")
    before = placed.select(doc, (F.col("_at") + 1).alias("_at"), F.col("section").alias("_before"))
    fresh = placed.join(before, [doc, "_at"], "left").withColumn("_new", F.coalesce((F.col("section") != F.col("_before")).cast("bigint"), F.lit(1).cast("bigint")))
    numbered = running(fresh, [doc], "_at", "_new", F.floor(F.col("_at") / BLOCK), "run")
    return numbered.groupBy(doc, "run").agg(F.min("section").alias("section"), F.min(num).alias("first_chunk"), F.max(num).alias("last_chunk"), F.count(F.lit(1)).alias("n"))


def section_boundaries(df: DataFrame, doc: str = "source_document", num: str = "chunk_num", section: str = "section_detected") -> DataFrame:
    """doc, boundary: ends of runs of three chunks or more, and the last chunk."""
    runs = section_runs(df, doc, num, section)
    ends = runs.where("n >= 3 AND NOT (run = 1 AND section = '')").select(doc, F.col("last_chunk").alias("boundary"))
    last = df.groupBy(doc).agg(F.max(num).alias("boundary"))
    return ends.unionByName(last).distinct()


def adaptive_boundaries(total: Column) -> Column:
    """Every 5 chunks to 20, every 10 to 80, every 5 after, and the last."""
    every = F.concat(F.sequence(F.lit(5), F.lit(20), F.lit(5)), F.sequence(F.lit(30), F.lit(80), F.lit(10)), F.when(total >= 85, F.sequence(F.lit(85), F.greatest(total, F.lit(85)), F.lit(5))).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.concat(F.filter(every, lambda b: b <= total), F.array(total))))


def boundaries(total: Column, mode: str, every: int = 5) -> Column:
    """Chunks after which the running summary is written: each one (``deep``), every
    n-th and the last (``fixed``), or by the number of chunks (``adaptive``)."""
    if mode == "deep":
        return F.sequence(F.lit(1), total)
    if mode == "fixed":
        return F.array_distinct(F.concat(F.when(total >= every, F.sequence(F.lit(every), F.greatest(total, F.lit(every)), F.lit(every))).otherwise(F.array().cast("array<int>")), F.array(total)))
    return adaptive_boundaries(total)


def contexts(df: DataFrame, doc: str = "source_document", num: str = "chunk_num", most: int = 2) -> DataFrame:
    """doc, chunk and what it is summarised with: the previous chunk's summary, its
    first ``most`` sentences, and the document's running summary at that chunk.

    A chunk meets the one with the number before it by a join, so no document is put
    in order.  Blank summaries count as missing."""
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    before = df.select(doc, (F.col(num) + 1).alias(num), filled("chunk_summary").alias("_local"), filled("progressive_summary").alias("_global"))
    rows = df.select(doc, num).join(before, [doc, num], "left")
    parts = F.split("_local", r"\. ", -1)
    short = F.when(F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), ". "), F.lit("."))).otherwise(F.col("_local"))
    first = F.col(num) == 1
    local = F.when(first, "[No preceding content.]").otherwise(F.coalesce(F.concat(F.lit("[Previous: "), short, F.lit("]")), F.lit("[Previous chunk summary not yet available]")))
    whole = F.when(first, "[This is the beginning of the document.]").otherwise(F.coalesce(F.concat(F.lit("[Document overview: "), "_global", F.lit("]")), F.lit("[Global context not yet available]")))
    return rows.select(doc, num, local.alias("local_context"), whole.alias("global_context"))


def reduce_batches(df: DataFrame, group: str, key: str, text: str, room: int = 6192, block: int = 65536) -> DataFrame:
    """group, batch, n, chars: summaries in key order, batched so that a batch
    fits the room: max(2, room // (mean length + 100)) in each.  Only lengths are
    shuffled, and a group is ranked in blocks of keys."""
    rows = df.select(group, key, F.length(text).alias("len"))
    per = rows.groupBy(group).agg(F.avg("len").alias("mean")).select(group, F.greatest(F.lit(2), F.floor(room / (F.col("mean") + 100))).alias("per"))
    placed = ordinal(rows, [group], [key], F.floor(F.col(key) / block), "rn").join(per, group)
    return placed.groupBy(group, F.floor(F.col("rn") / F.col("per")).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("chars"))


def metadata(df: DataFrame, group: str, keywords: str, text: str) -> DataFrame:
    """group, n, mean words (floor), distinct keywords, commonest keyword
    (ties by the smaller)."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    base = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(F.coalesce(words, F.lit(0))) / F.count(F.lit(1))).alias("mean_words"))
    k = df.select(group, F.explode(keywords).alias("k")).where("k IS NOT NULL").groupBy(group, "k").agg(F.count(F.lit(1)).alias("c"))
    top = k.groupBy(group).agg(F.count(F.lit(1)).alias("n_keywords"), F.min(F.struct((-F.col("c")).alias("c"), F.col("k"))).alias("t"))
    return base.join(top, group, "left").select(group, "n", "mean_words", F.coalesce("n_keywords", F.lit(0)).alias("n_keywords"), F.col("t.k").alias("top_keyword"))


def recent_summaries(df: DataFrame, n: int = 5, doc: str = "source_document", num: str = "chunk_num") -> DataFrame:
    """doc, chunk and the last ``n`` summaries up to it, joined.

    Each summary is handed to the n chunks that need it by their place in the
    document, so a list never holds more than n and no document is one task."""
    filled = F.when(F.trim("chunk_summary") != "", F.col("chunk_summary"))
    rows = df.where(F.col(doc).isNotNull()).select(doc, num, filled.alias("_s"))
    placed = ordinal(rows, [doc], [num, "_s"], F.floor(F.coalesce(F.col(num), F.lit(0)) / BLOCK), "_at")
    handed = placed.select(doc, F.explode(F.sequence(F.col("_at"), F.col("_at") + n - 1)).alias("_to"), "_at", "_s").where("_s IS NOT NULL")
    last = handed.groupBy(doc, F.col("_to").alias("_at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]), "\n").alias("recent"))
    return placed.join(last, [doc, "_at"], "left").select(doc, num, F.coalesce("recent", F.lit("")).alias("recent"))


def success_rates(df: DataFrame, group: str) -> DataFrame:
    """group, n, succeeded, rate of document results."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") != "error", 1)).alias("succeeded")).withColumn("rate", F.round(F.col("succeeded") / F.col("n"), 6))


def word_budget(words: Column) -> Column:
    """Room for a summary of so many words: the range of 20 either way and the
    tokens int(max x 1.5 x 1.3)."""
    most = words + 20
    return F.struct(F.greatest(words - 20, F.lit(0)).alias("least"), most.alias("most"), F.floor(most * F.lit(1.5) * F.lit(1.3)).cast("bigint").alias("tokens"))


def prompt_tokens(text: str) -> Column:
    return F.floor(F.length(text) / 4)


def lead(text: str, words: int = 75) -> Column:
    """The first sentences of a text that fit the word budget, at least one; the
    stand-in for a generated summary.  The array kept is bounded by the budget."""
    sents = F.transform(T.sentences(text), T.clean_sentence)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def take(acc, s):
        n = acc["n"] + F.size(F.split(s, " "))
        fits = acc["open"] & ((n <= words) | (F.size(acc["kept"]) == 0))
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"), n.alias("n"), fits.alias("open"))

    return F.aggregate(sents, start, take, lambda acc: F.array_join(acc["kept"], " "))


def lead_summaries(df: DataFrame, key: str, text: str, words: int = 75) -> DataFrame:
    """key, summary of every text with more than fifty characters; shorter, empty
    and null texts have none.  Works inside each row, without a shuffle."""
    return df.where(F.length(T.strip(text)) > 50).select(key, lead(text, words).alias("summary"))


def spread(text: str, words: int) -> Column:
    """Sentences from all over a text, about ``words`` words: the first of every k,
    where k makes them fit.  Each group of k sentences is led by its first, so that no
    part of the text is left out; a text that fits is taken whole."""
    sents = F.transform(T.sentences(text), T.clean_sentence)

    def pick(ss: Column) -> Column:
        total = F.aggregate(ss, F.lit(0), lambda n, s: n + F.size(F.split(s, " ")))
        k = F.greatest(F.lit(1), F.ceil(total / words)).cast("int")
        return T.let(k, lambda k: F.array_join(F.filter(ss, lambda s, i: i % k == 0), " "))

    return T.let(sents, pick)


def spread_summaries(df: DataFrame, key: str, text: str, words: int = 200) -> DataFrame:
    """key, summary of every text with more than fifty characters, from all of its
    parts; works inside each row, without a shuffle."""
    return df.where(F.length(T.strip(text)) > 50).select(key, spread(text, words).alias("summary"))
