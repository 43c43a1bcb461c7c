"""Vocabulary: candidates of several algorithms merged, typed, scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from . import rake as R
from . import terms
from .ranks import ordinal

#: Columns of a candidate row: key, term, algorithm, confidence, type, frequency, ord.
ALGORITHM_ORDER = {"NER": 0, "RAKE": 1, "BM25": 2}


def _choice(value: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value], F.lit(default))


#: Stand-in for a statistical tagger, which needs a model that isn't there: runs
#: of capitalised words, told apart by the words around and inside them.
ENTITY = r"(?<![\p{L}])(?:(?:Mr|Mrs|Ms|Dr|Nurse|Justice|Attorney)\.? )?\p{Lu}\p{Ll}+(?:(?: [A-Z]\.)? \p{Lu}[\p{L}'\-]+)+"


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, type, ord, doctor: capitalised runs as Person or Place, cleaned, and
    whether a person is called a doctor."""
    found = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ENTITY), 0)).alias("ord", "raw"))
    term = F.trim(F.regexp_replace("raw", r"^(?:Mr|Mrs|Ms|Dr|Nurse|Justice|Attorney)\.? ", ""))
    org = F.col("term").rlike("(?i)" + "|".join(rf"\b{w}\b" for w in C.ORGANIZATION_WORDS + ["Group", "Company", "Partners", "Associates", "Stores", "Manufacturing", "Harbor", "Point", "Springs", "Falls", "Street", "Road", "Avenue"]).replace(".", r"\."))
    named = found.select(key, "ord", clean_entity(term).alias("term"), F.col("raw").rlike(r"^(?:Dr\.|Doctor)").alias("doctor"))
    return named.where(F.length("term").between(3, 60)).withColumn("type", F.when(org, "Place").otherwise("Person"))


def clean_entity(term: Column) -> Column:
    """Single spaces, no conjunction at either end, no marks around."""
    t = F.trim(F.regexp_replace(term, r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)^(?:and/or|and|or)\s+", ""), r"(?i)\s+(?:and/or|and|or)$", "")
    return F.trim(F.regexp_replace(t, r"^[.,;:!?()\[\]{}\"'/\\]+|[.,;:!?()\[\]{}\"'/\\]+$", ""))


def unusual(df: DataFrame, key: str, text: str, ranks: DataFrame, excluded: DataFrame | None = None, medical: DataFrame | None = None) -> DataFrame:
    """key, term, type, frequency, ord: single words that stand out.

    Words of letters alone that no filter and no exclusion list takes: medical words,
    acronyms that are no titles, and words that are rare in a frequency list.  Words
    inside an entity are skipped, as entities are cut out first.  ``ranks``: word,
    rank; ``excluded`` and ``medical``: word.  Lists are joined on the word.
    """
    rest = F.regexp_replace(F.col(text), ENTITY, " ")
    found = F.regexp_extract_all(rest, F.lit(r"(?<![\p{L}\p{N}_'-])\p{L}{2,}(?![\p{L}\p{N}_'-])"), 0)
    words = df.select(key, F.posexplode(F.filter(found, lambda w: ~F.lower(w).isin(C.STOP_VOCAB) & keeps_word(w) & keeps_entity(w))).alias("pos", "w"))
    each = words.groupBy(key, F.lower("w").alias("word")).agg(F.min_by("w", "pos").alias("term"), F.count(F.lit(1)).alias("frequency"), F.min("pos").alias("ord"))
    if excluded is not None:
        each = each.join(excluded.select(F.lower(F.trim("word")).alias("word")).distinct(), "word", "left_anti")
    known = each.join(ranks.select("word", "rank"), "word", "left")
    listed = medical.select(F.lower(F.trim("word")).alias("word"), F.lit(True).alias("medical")).distinct() if medical is not None else None
    known = known.join(listed, "word", "left") if listed is not None else known.withColumn("medical", F.lit(None).cast("boolean"))
    acronym = F.col("term").rlike(r"^\p{Lu}{2,}$") & ~F.col("term").isin(C.TITLE_ACRONYMS)
    return known.where(F.coalesce("medical", F.lit(False)) | acronym | is_rare(F.col("rank"))).select(key, "term", F.when(F.col("medical"), "Medical").otherwise("Technical").alias("type"), "frequency", "ord")


def candidates(df: DataFrame, key: str, text: str, weights: DataFrame, ranks: DataFrame, medical: DataFrame | None = None) -> DataFrame:
    """The union of the three algorithms' candidates: entities and unusual words, key
    phrases, and BM25 terms if the corpus has five texts."""
    ner = entities(df, key, text).where(keeps_entity(F.col("term"))).select(key, "term", F.lit("NER").alias("algorithm"), F.lit(0.85).alias("confidence"), "type", F.lit(1).cast("bigint").alias("frequency"), F.col("ord").cast("bigint").alias("ord"))
    rk = R.rake(df, key, text).select(key, R.clean_phrase(F.col("phrase")).alias("term"), F.lit("RAKE").alias("algorithm"), F.least(F.col("score") / 15, F.lit(1.0)).alias("confidence"), F.lit("Technical").alias("type"), F.lit(1).cast("bigint").alias("frequency"), F.col("rank").cast("bigint").alias("ord"))
    bm = terms.bm25_terms(df, key, text, weights).select(key, "term", F.lit("BM25").alias("algorithm"), "confidence", F.lit("Technical").alias("type"), F.col("tf").cast("bigint").alias("frequency"), F.col("rank").cast("bigint").alias("ord"))
    odd = unusual(df, key, text, ranks, None, medical).select(key, "term", F.lit("NER").alias("algorithm"), F.lit(0.6).alias("confidence"), "type", F.col("frequency").cast("bigint").alias("frequency"), (F.col("ord") + 500_000_000).cast("bigint").alias("ord"))
    ready = df.where(F.length(F.trim(text)) > 0).limit(C.MIN_CORPUS_DOCS).count() >= C.MIN_CORPUS_DOCS
    return ner.unionByName(odd).unionByName(rk).unionByName(bm if ready else bm.limit(0))


def merge(cands: DataFrame, key: str) -> DataFrame:
    """One row per (key, lower-case term): the first spelling, the sorted
    sources, the weighted confidence, the best type and the summed frequency."""
    order = _choice(F.col("algorithm"), ALGORITHM_ORDER, 9) * 1_000_000_000 + F.col("ord")
    precedence = _choice(F.col("type"), C.TYPE_PRECEDENCE, 0) + F.when(F.col("algorithm") == "NER", 5).otherwise(0)
    weight = _choice(F.col("algorithm"), C.ALGORITHM_WEIGHTS, 1.0)
    rows = cands.withColumn("k", F.lower(F.trim("term"))).where("k <> ''").withColumn("o", order).withColumn("w", weight).withColumn("p", precedence)
    return rows.groupBy(key, "k").agg(
        F.min_by("term", "o").alias("term"),
        F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("sources"),
        F.countDistinct("algorithm").alias("n_algorithms"),
        F.coalesce(F.try_divide(F.sum(F.col("confidence") * F.col("w")), F.sum("w")), F.lit(0.5)).alias("confidence"),
        F.max_by("type", F.struct("p", (-F.col("o")).alias("first"))).alias("type"),
        F.sum("frequency").alias("frequency"),
        F.min("o").alias("ord"),
    )


def category(term: Column, type_: Column) -> Column:
    """Unknown terms become Person or Place by their look."""
    org = F.lit(False)
    for w in C.ORGANIZATION_WORDS:
        org = org | F.lower(term).contains(w.lower())
    words = F.split(F.trim(term), r"\s+")
    person = F.size(words).between(1, 4) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}")) & ~org
    return F.when(type_ != "Unknown", type_).when(person, "Person").when(org, "Place").otherwise("Unknown")


def quality(type_: Column, frequency: Column, rank: Column, algorithms: Column) -> Column:
    """The score from 0 to 100: occurrences, rarity, type, agreement."""
    score = F.lit(50.0) + F.least(frequency * 5, F.lit(20)) + F.when(rank == 0, 20).when(rank > 200_000, 15).when(rank > C.RARE_RANK, 10).otherwise(0) + _choice(type_, C.TYPE_BOOST, 0)
    score = score + F.when(algorithms >= 2, F.least(algorithms * 3, F.lit(10))).otherwise(0)
    return F.bround(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 1)


def vocabulary(merged: DataFrame, key: str, ranks: DataFrame | None = None, documents: int = 1, least: int = 2, medical: DataFrame | None = None, definitions: DataFrame | None = None) -> DataFrame:
    """The final rows: typed, filtered by frequency (persons exempt), scored, defined,
    with their position by rarity: words outside the frequency list first.

    ``ranks``: word, rank of a frequency list; absent words rank 0.  ``medical``:
    word, which makes a term medical whatever found it.  ``definitions``: word,
    definition, for medical and technical terms.  ``documents``: the texts that one
    ``key`` stands for.
    """
    rows = merged.withColumn("type", category(F.col("term"), F.col("type")))
    if medical is not None:
        rows = rows.join(medical.select(F.lower(F.trim("word")).alias("k"), F.lit("Medical").alias("_m")).distinct(), "k", "left").withColumn("type", F.coalesce("_m", "type")).drop("_m")
    rows = rows.join(ranks.select(F.col("word").alias("k"), F.col("rank").alias("freq_rank")), "k", "left") if ranks is not None else rows.withColumn("freq_rank", F.lit(0))
    rows = rows.withColumn("freq_rank", F.coalesce("freq_rank", F.lit(0)))
    kept = rows.where((F.col("type") == "Person") | F.col("frequency").between(least, documents * 4))
    if definitions is not None:
        kept = kept.join(definitions.select(F.lower("word").alias("k"), F.col("definition").alias("_d")), "k", "left")
    else:
        kept = kept.withColumn("_d", F.lit(None).cast("string"))
    short = F.when(F.length("_d") > 100, F.concat(F.substring("_d", 1, 97), F.lit("..."))).otherwise(F.col("_d"))
    meaning = F.when(F.col("type").isin("Medical", "Technical"), F.coalesce(short, F.lit("—"))).otherwise("—")
    rare = W.partitionBy(key).orderBy((F.col("freq_rank") > 0).cast("int"), F.desc("freq_rank"), "ord", "term")
    return kept.withColumn("quality_score", quality(F.col("type"), F.col("frequency"), F.col("freq_rank"), F.col("n_algorithms"))).select(
        key, "term", "type", "quality_score", F.col("frequency").alias("in_case_freq"), "freq_rank", "sources", F.round("confidence", 6).alias("confidence"), meaning.alias("definition"), F.row_number().over(rare).alias("position")
    )


def frequency_ranks(words: DataFrame) -> DataFrame:
    """word, count -> word, rank: 0-based by falling count, ties by word.

    Words of one count are ranked in blocks of their first three characters, as
    most words share the lowest counts.  Only the sizes of the counts pass through one
    ordered window; as the counts add up to the corpus, there are few different ones.
    """
    inside = ordinal(words.select("word", "count"), ["count"], ["word"], F.substring("word", 1, 3), "_at")
    sizes = words.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy(F.desc("count")).rowsBetween(W.unboundedPreceding, -1)
    start = sizes.select("count", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return inside.join(start, "count").select("word", (F.col("_start") + F.col("_at")).alias("rank"))


def person_roles(persons: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, role of each person: the most specific pattern whose captured
    name contains the term or is contained in it.  Captures are taken once per
    text and joined on the key."""
    caught = None
    for i, (pattern, role) in enumerate(C.PERSON_ROLES):
        part = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("caught"), F.lit(i).alias("o"), F.lit(role).alias("role"))
        caught = part if caught is None else caught.unionByName(part)
    low = lambda c: F.lower(F.trim(c))
    names = caught.select(key, low("caught").alias("caught"), "o", "role").distinct()
    hit = persons.select(key, "term").join(names, key).where(low("term").contains(F.col("caught")) | F.col("caught").contains(low("term")))
    best = hit.groupBy(key, "term").agg(F.min_by("role", "o").alias("role"))
    # without a pattern, a doctor is a medical professional
    doctor = F.col("doctor") if "doctor" in persons.columns else F.lit(False)
    fallback = F.when(doctor, "Medical professional").otherwise("Person in case")
    return persons.join(best, [key, "term"], "left").select(key, "term", F.coalesce("role", fallback).alias("role"))


def place_relevance(places: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, relevance of each place: the first pattern whose captured
    place shares half of the shorter one's words."""
    caught = None
    for i, (pattern, role) in enumerate(C.PLACE_ROLES):
        part = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("caught"), F.lit(i).alias("o"), F.lit(role).alias("relevance"))
        caught = part if caught is None else caught.unionByName(part)
    words = lambda c: F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+"))
    hit = places.select(key, "term").join(caught.select(key, words("caught").alias("w"), "o", "relevance").distinct(), key)
    share = F.size(F.array_intersect(words("term"), "w")) / F.least(F.size(words("term")), F.size("w"))
    best = hit.where(share >= 0.5).groupBy(key, "term").agg(F.min_by("relevance", "o").alias("relevance"))
    return places.select(key, "term").join(best, [key, "term"], "left").withColumn("relevance", F.coalesce("relevance", F.lit("Location mentioned in case")))


def keeps_entity(term: Column) -> Column:
    """Whether an entity is none of addresses, fragments, boilerplate, citations."""
    return F.length(term).between(3, 60) & ~term.rlike("(?i)" + "|".join(f"(?:{p})" for p in C.ENTITY_FILTERS[:-1])) & ~term.rlike(C.ENTITY_FILTERS[-1])


def keeps_word(word: Column) -> Column:
    return ~word.rlike("|".join(f"(?:{p})" for p in C.WORD_FILTERS))


def is_rare(rank: Column) -> Column:
    return rank.isNull() | (rank >= C.RARE_RANK)


def without(vocab: DataFrame, excluded: DataFrame) -> DataFrame:
    """The vocabulary without excluded terms (lower case, trimmed)."""
    return vocab.join(excluded.select(F.lower(F.trim("term")).alias("_x")).distinct(), F.lower(F.trim(vocab["term"])) == F.col("_x"), "left_anti")
