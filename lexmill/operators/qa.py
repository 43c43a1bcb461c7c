"""Answers by extraction, their sources, and the question graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def confidence(scores: Column) -> Column:
    """The mean score of the sources to two decimals, 0 without sources."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(F.coalesce(F.size(scores), F.lit(0)) > 0, F.floor(total / F.size(scores) * 100 + 0.5) / 100).otherwise(0.0)


def source_summary(sources: Column) -> Column:
    """``file: first section`` of each file, in rank order."""
    kept = F.filter(sources, lambda s: s["filename"].isNotNull())
    names = F.array_distinct(F.transform(kept, lambda s: s["filename"]))
    first = lambda n: F.get(F.filter(kept, lambda s: s["filename"] == n), F.lit(0))["section"]
    return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(": "), F.coalesce(first(n), F.lit("N/A")))), "; ")


def usable_sources(sources: Column) -> Column:
    return F.filter(sources, lambda s: s["score"] >= C.MIN_RETRIEVAL_SCORE)


def extract_answers(df: DataFrame, key: str, question: str, context: str) -> DataFrame:
    """key and answer: up to three sentences that share most keywords with the
    question, ties by falling sentence; else the first long sentence.

    Sentences are ranked inside each row's own array, so nothing is shuffled.
    """
    words = lambda s: F.array_distinct(F.regexp_extract_all(T.ascii_words(s), F.lit(r"\b[a-zA-Z]+\b"), 0))
    step = df.select(key, T.question_keywords(question).alias("keys"), T.sentences(context).alias("sents"))
    scored = F.filter(F.transform("sents", lambda s: F.struct(F.size(F.array_intersect(F.col("keys"), words(s))).alias("n"), s.alias("s"))), lambda x: x["n"] > 0)
    best = F.slice(F.reverse(F.array_sort(scored)), 1, 3)
    joined = F.array_join(F.transform(best, lambda x: T.clean_sentence(x["s"])), " ")
    long_ = F.get(F.filter("sents", lambda s: F.length(s) > 50), F.lit(0))
    return step.select(key, F.when(F.size(best) > 0, joined).otherwise(F.coalesce(T.clean_sentence(long_), F.lit("No relevant information found in the documents."))).alias("answer"))


def classify(answer: Column, options: Column) -> Column:
    """The option that an answer means: one whose value or label occurs in it,
    else by keywords, else ``unclear`` or the first option."""
    low = F.lower(answer)
    named = F.filter(options, lambda o: low.contains(F.lower(o["value"])) | low.contains(F.lower(F.coalesce(o["label"], F.lit("")))))
    table = F.create_map(*[x for v, ws in C.ANSWER_KEYWORDS.items() for x in (F.lit(v), F.array(*map(F.lit, ws)))])
    by_word = F.filter(options, lambda o: F.exists(F.coalesce(table[F.lower(o["value"])], F.array().cast("array<string>")), lambda w: low.contains(w)))
    unclear = F.filter(options, lambda o: o["value"] == "unclear")
    first = lambda a: F.get(a, F.lit(0))["value"]
    return F.when(answer.isNull(), F.lit(None)).otherwise(F.coalesce(first(named), first(by_word), first(unclear), first(options), F.lit("unclear")))


def edges(questions: DataFrame) -> DataFrame:
    """question_id, value, next_id of the question graph; one edge per option,
    or one for a question without options."""
    per = questions.select("question_id", F.explode("options").alias("o")).select("question_id", F.col("o.value").alias("value"), F.col("o.next_id").alias("next_id"))
    plain = questions.where(F.coalesce(F.size("options"), F.lit(0)) == 0).select("question_id", F.lit(None).cast("string").alias("value"), "next_id")
    return per.unionByName(plain).where("next_id IS NOT NULL")


def steps_to_end(questions: DataFrame, longest: int = 64) -> DataFrame:
    """question_id, steps: the longest way from each question to an end.
    ``longest`` stops a cycle."""
    known = questions.select("question_id")
    e = edges(questions).select("question_id", "next_id").distinct().join(known.select(F.col("question_id").alias("next_id")), "next_id", "left_semi")
    walk = f"""WITH RECURSIVE walk(start, here, steps) AS (
        SELECT question_id, question_id, 0 FROM {{known}}
        UNION ALL SELECT w.start, e.next_id, w.steps + 1 FROM walk w JOIN {{e}} e ON e.question_id = w.here WHERE w.steps < {int(longest)}
    ) SELECT start AS question_id, max(steps) AS steps FROM walk GROUP BY start"""
    return questions.sparkSession.sql(walk, known=known, e=e)


def contexts(answers: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, n_chunks, context: the texts of an answer's usable sources in rank
    order, each under ``[file, section]:``.

    ``answers``: key, sources; ``chunks``: filename, chunk_num, text, one row for
    each.  Sources without a text, a file or a sufficient score are left out; an
    answer without any has no row.  A source list is a short top-k list.
    """
    s = answers.select(key, F.posexplode(usable_sources(F.col("sources"))).alias("rank", "x")).select(key, "rank", F.col("x.filename").alias("filename"), F.col("x.chunk_num").alias("chunk_num"), F.col("x.section").alias("section"))
    named = F.when((F.col("section").isNotNull()) & (F.col("section") != "N/A"), F.concat(F.lit(", "), F.col("section"))).otherwise("")
    parts = s.join(chunks.where("text IS NOT NULL"), ["filename", "chunk_num"]).select(key, "rank", F.concat(F.lit("["), "filename", named, F.lit("]:\n"), "text").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "part")))
    return parts.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.array_join(F.transform(ordered, lambda p: p["part"]), "\n\n---\n\n").alias("context"))
