"""Briefings: the extractions of a case's chunks brought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..session import materialize
from .alike import last_alike
from .ranks import ordinal


def once(df: DataFrame) -> DataFrame:
    """Extractions without redelivered rows, the successful ones."""
    return df.where("extraction_success").dropDuplicates(["chunk_id"])


def parties(df: DataFrame, side: str) -> DataFrame:
    """case_id, name: the longest spelling of each party, ties by the first."""
    rows = df.select("case_id", "chunk_id", F.posexplode(F.col(f"parties.{side}")).alias("pos", "raw")).select("case_id", "chunk_id", "pos", F.trim("raw").alias("name"), T.normalize_name("raw").alias("norm")).where("norm <> ''")
    return rows.groupBy("case_id", "norm").agg(F.max_by("name", F.struct(F.length("name").alias("n"), (-F.col("chunk_id")).alias("c"), (-F.col("pos")).alias("p"))).alias("name")).select("case_id", "norm", "name")


def first_seen(df: DataFrame, field: str) -> DataFrame:
    """case_id, value, first place of the distinct trimmed values of a list."""
    rows = df.select("case_id", "chunk_id", F.posexplode(field).alias("pos", "raw")).where("trim(raw) <> ''")
    o = F.struct("chunk_id", "pos")
    return rows.groupBy("case_id", F.lower(F.trim("raw")).alias("norm")).agg(F.min_by(F.trim("raw"), o).alias("value"), F.min(o).alias("first"))


def case_type_vote(df: DataFrame) -> DataFrame:
    """case_id, case_type, votes: the commonest family, ties by the first seen."""
    rows = df.select("case_id", "chunk_id", F.posexplode("case_type_hints").alias("pos", "hint")).where("trim(hint) <> ''").withColumn("t", T.case_type("hint"))
    n = rows.groupBy("case_id", "t").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("chunk_id", "pos")).alias("first"))
    w = W.partitionBy("case_id").orderBy(F.desc("votes"), F.asc("first"))
    top = n.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("case_id", F.col("t").alias("case_type"), "votes")
    return df.select("case_id").distinct().join(top, "case_id", "left").select("case_id", F.coalesce("case_type", F.lit("unknown")).alias("case_type"), F.coalesce("votes", F.lit(0)).alias("votes"))


def stats(df: DataFrame) -> DataFrame:
    """case_id and counts of chunks and list items."""
    n = lambda c: F.sum(F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))).alias(f"n_{c}")
    return df.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_chunks"), n("allegations"), n("defenses"), n("key_facts"), n("dates_mentioned"), n("names_mentioned"), n("vocabulary"))


def people_by_category(df: DataFrame) -> DataFrame:
    """case_id, category, name: each person once by normal form, in the longest
    spelling; rows, not lists, as a case may name any number of people."""
    rows = df.select("case_id", F.explode("names_mentioned").alias("x")).select("case_id", F.coalesce(F.upper("x.category"), F.lit("OTHER")).alias("category"), F.trim("x.name").alias("name"), T.normalize_name("x.name").alias("norm")).where("norm <> ''")
    one = rows.groupBy("case_id", "category", "norm").agg(F.max(F.struct(F.length("name").alias("n"), F.col("name"))).alias("best"))
    return one.select("case_id", "category", F.col("best.name").alias("name"))


def dedup_text(df: DataFrame, field: str) -> DataFrame:
    """case_id, value: texts of a list without near-duplicates.

    A text goes if a longer one of its case (ties: the smaller) contains it or is
    at least 0.8 like it (SequenceMatcher's ratio over characters).  No key is
    complete for that ratio, so all pairs of a case are compared, in blocks (see
    ``last_alike``).  Texts of ten characters or less are left out.
    """
    rows = first_seen(df, field).where(F.length("value") > C.MIN_ITEM_LENGTH).select("case_id", "norm", "value")
    rows = materialize(rows, "texts")
    gone = last_alike(rows.select("case_id", "norm", F.length("norm").alias("len")), "case_id", "norm", ["len", F.desc("norm")], C.TEXT_SIMILARITY, contained=True)
    return rows.join(gone.select("case_id", "norm").distinct(), ["case_id", "norm"], "left_anti").select("case_id", "value")


def openings(df: DataFrame) -> DataFrame:
    """case_id, position, part: the first sentence of each case's briefing, in parts
    that make it up when put together in order.

    A case may have any number of parties, so each party is a row, with the words
    before it and the stop behind the last; no row holds a whole list.
    """
    kind = case_type_vote(df).select("case_id", F.concat(F.lit("This is a "), F.col("case_type"), F.lit(" case")).alias("head"))
    sides = {}
    for side in ("plaintiffs", "defendants"):
        rows = parties(df, side).where("case_id IS NOT NULL")
        sides[side] = ordinal(rows, ["case_id"], ["name", "norm"], F.substring("name", 1, 2), "i"), rows.groupBy("case_id").agg(F.count(F.lit(1)).alias(f"n_{side}"))
    n = kind.select("case_id", "head")
    for _, counts in sides.values():
        n = n.join(counts, "case_id", "left")
    n = materialize(n.na.fill(0, ["n_plaintiffs", "n_defendants"]), "sides")
    first = n.select("case_id", F.lit(0).cast("bigint").alias("position"), F.concat("head", F.when(F.col("n_plaintiffs") == 0, ".").when(F.col("n_defendants") == 0, " involving ").otherwise(" brought by ")).alias("part"))

    def listed(side: str, offset: Column, ends: Column, lead: str) -> DataFrame:
        many, i = F.col(f"n_{side}"), F.col("i")
        word = F.when(i == 0, lead).when(i < many - 1, ", ").when(many == 2, " and ").otherwise(", and ")
        stop = F.when((i == many - 1) & ends, ".").otherwise("")
        return sides[side][0].join(n.where("n_plaintiffs > 0"), "case_id").select("case_id", (offset + i).alias("position"), F.concat(word, "name", stop).alias("part"))

    left = listed("plaintiffs", F.lit(1), F.col("n_defendants") == 0, "")
    right = listed("defendants", F.col("n_plaintiffs") + 1, F.lit(True), " against ")
    return first.unionByName(left).unionByName(right)


def sentence_list(items, conjunction: str = "and"):
    """``a``, ``a and b``, ``a, b, and c`` of a short array column."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.array_join(items, f" {conjunction} ")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(f", {conjunction} "), F.element_at(items, -1)))


def firsts(df: DataFrame, field: str, n: int) -> DataFrame:
    """case_id and the first ``n`` distinct values of a list, in order.  Ranked
    before they are collected, so a list never holds more than ``n``."""
    w = W.partitionBy("case_id").orderBy("first")
    top = first_seen(df, field).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return top.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]).alias(field))


def narratives(df: DataFrame) -> DataFrame:
    """case_id, paragraph, position, part: the opening (paragraph 0, in parts), key
    allegations (1, five), defences (2, three), facts (3, five) and dates (4, five) in
    fixed sentences.  Paragraphs that have nothing to say are left out."""
    out = openings(df).select("case_id", F.lit(0).alias("paragraph"), "position", "part")
    dashes = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    said = lambda c, one, many: F.when(F.size(c) == 1, F.concat(F.lit(one), F.lower(F.get(c, F.lit(0))))).otherwise(F.concat(F.lit(many + "\n"), dashes(c)))
    texts = [
        ("allegations", 5, lambda c: said(c, "The plaintiff alleges that ", "The key allegations in this case include:")),
        ("defenses", 3, lambda c: said(c, "The defendant contends that ", "The defense asserts:")),
        ("key_facts", 5, lambda c: F.concat(F.lit("Key facts include:\n"), dashes(c))),
        ("dates_mentioned", 5, lambda c: F.concat(F.lit("Relevant dates: "), sentence_list(c))),
    ]
    for i, (field, n, text) in enumerate(texts, 1):
        out = out.unionByName(firsts(df, field, n).select("case_id", F.lit(i).alias("paragraph"), F.lit(0).cast("bigint").alias("position"), text(F.col(field)).alias("part")))
    return out


def names_section(df: DataFrame) -> DataFrame:
    """case_id, section, position, line: all people of a case by category, as rows.
    People are ranked in blocks of the first letters of their names, so that no case
    is one task."""
    rows = df.select("case_id", F.explode("names_mentioned").alias("x")).select("case_id", F.coalesce(F.upper("x.category"), F.lit("OTHER")).alias("category"), F.trim("x.name").alias("name"), F.trim("x.role").alias("role"), T.normalize_name("x.name").alias("norm")).where("norm <> ''")
    one = rows.groupBy("case_id", "category", "norm").agg(F.max(F.struct(F.length("name").alias("n"), F.col("name"))).alias("b"), F.max(F.struct(F.length("role").alias("n"), F.col("role"))).alias("r"))
    line = F.when(F.length("r.role") > 0, F.concat("b.name", F.lit(" ("), "r.role", F.lit(")"))).otherwise(F.col("b.name"))
    section = F.create_map(*[F.lit(x) for kv in C.CATEGORY_NAMES.items() for x in kv])
    named = one.select("*", F.col("b.name").alias("_name"))
    placed = ordinal(named, ["case_id", "category"], ["_name", "norm"], F.substring("_name", 1, 2), "_at").withColumn("position", F.col("_at") + 1)
    return placed.select("case_id", F.coalesce(section[F.col("category")], F.lit("Other Individuals")).alias("section"), "category", "position", line.alias("line"))


def json_in(raw: Column) -> Column:
    """The JSON in a response: the whole of it, else the first balanced object, else
    what stands between the outermost braces, else the first array; null if none
    parses."""
    t = F.trim(raw)
    valid = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), c)
    part = lambda p: F.nullif(F.regexp_extract(t, p, 0), F.lit(""))
    return F.coalesce(valid(t), valid(part(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")), valid(part(r"(?s)\{.*\}")), valid(part(r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]")))


def listed(json: Column, path: str) -> Column:
    """The strings at a path: a value that is no list becomes one, null and empty items
    fall away."""
    v = F.get_json_object(json, path)
    items = F.when(v.isNull(), F.array().cast("array<string>")).when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def record_of(json: Column) -> Column:
    """A response as a record of the columns of an extraction, coerced."""
    names = F.transform(
        listed(json, "$.names_mentioned"),
        lambda x: F.when(
            x.startswith("{"),
            F.struct(F.coalesce(F.get_json_object(x, "$.name"), F.lit("")).alias("name"), F.coalesce(F.get_json_object(x, "$.role"), F.lit("")).alias("role"), F.upper(F.coalesce(F.get_json_object(x, "$.category"), F.lit("OTHER"))).alias("category")),
        ).otherwise(F.struct(x.alias("name"), F.lit("").alias("role"), F.lit("OTHER").alias("category"))),
    )
    parties = F.struct(listed(json, "$.parties.plaintiffs").alias("plaintiffs"), listed(json, "$.parties.defendants").alias("defendants"))
    lists = [listed(json, f"$.{f}").alias(f) for f in ("allegations", "defenses", "key_facts", "dates_mentioned", "case_type_hints", "vocabulary")]
    return F.when(json.startswith("{"), F.struct(parties.alias("parties"), names.alias("names_mentioned"), *lists))


def parsed_responses(df: DataFrame) -> DataFrame:
    """chunk_id, state, n_chars and record of each failed extraction's raw response:
    ``object`` or ``array`` if JSON can be found in it, ``cut`` if it only begins as
    JSON, ``prose`` else.  The record is null unless an object was found."""
    json = json_in(F.col("raw_response"))
    rows = df.where("raw_response IS NOT NULL").select("chunk_id", "raw_response", json.alias("_json"))
    state = F.when(F.col("_json").startswith("{"), "object").when(F.col("_json").startswith("["), "array").when(F.trim("raw_response").rlike(r"^[\[{]"), "cut").otherwise("prose")
    return rows.select("chunk_id", state.alias("state"), F.length("raw_response").alias("n_chars"), record_of(F.col("_json")).alias("record")).distinct()


def merged_people(df: DataFrame) -> DataFrame:
    """case_id, name, role, category, n_spellings, n_mentions: the people of a
    case, spellings brought together.

    A spelling joins the longest other one of its case that has all its words, or
    whose letters are at least 0.85 like it; joined spellings follow on to the end
    of their chain.  The former are found by a join on the shorter one's rarest
    word, the latter by comparing all pairs in blocks (see ``last_alike``), as no
    key survives every slip.
    Role and category come from the longest role and the commonest category.
    Null and blank names are no people; repeated rows count as mentions.
    """
    rows = df.select("case_id", F.explode("names_mentioned").alias("x")).select(
        "case_id", F.trim("x.name").alias("name"), F.trim("x.role").alias("role"), F.coalesce(F.upper("x.category"), F.lit("OTHER")).alias("category"), T.normalize_name("x.name").alias("norm")
    ).where("norm <> ''")
    by_category = rows.groupBy("case_id", "norm", "category").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.length("name").alias("len"), F.col("name"))).alias("best"), F.max(F.struct(F.length("role").alias("len"), F.col("role"))).alias("role"))
    spelled = materialize(by_category, "spellings")
    one = spelled.select("case_id", "norm").distinct().withColumn("words", F.array_distinct(F.split("norm", " ")))
    word = one.select("case_id", "norm", F.explode("words").alias("k"))
    often = word.groupBy("case_id", "k").agg(F.count(F.lit(1)).alias("f"))
    rarest = word.join(often, ["case_id", "k"]).groupBy("case_id", "norm").agg(F.min(F.struct("f", "k")).alias("r")).select("case_id", "norm", F.col("r.k").alias("k"))
    pairs = rarest.join(word.withColumnRenamed("norm", "longer"), ["case_id", "k"]).select("case_id", "norm", "longer").distinct()
    rank = lambda c: F.struct(F.length(c).alias("len"), F.col(c).alias("v"))
    words = lambda c: F.split(c, " ")
    whole = pairs.where((rank("norm") < rank("longer")) & (F.size(F.array_except(words("norm"), words("longer"))) == 0))
    near = last_alike(one.select("case_id", "norm", F.length("norm").alias("len")), "case_id", "norm", ["len", "norm"], C.NAME_SIMILARITY)
    joined = whole.unionByName(near.withColumnRenamed("other", "longer"))
    to = joined.groupBy("case_id", "norm").agg(F.max(rank("longer")).alias("t")).select("case_id", "norm", F.col("t.v").alias("head"), F.lit(True).alias("moved"))
    while not (to := materialize(to, "heads")).where("moved").isEmpty():  # each round doubles the steps followed; heads only grow longer
        nxt = to.select("case_id", F.col("norm").alias("head"), F.col("head").alias("further"))
        to = to.join(nxt, ["case_id", "head"], "left").select("case_id", "norm", F.coalesce("further", "head").alias("head"), F.col("further").isNotNull().alias("moved"))
    to = to.drop("moved")
    people = spelled.join(to, ["case_id", "norm"], "left").withColumn("head", F.coalesce("head", "norm"))
    per = people.groupBy("case_id", "head", "category").agg(F.sum("n").alias("n"), F.max("best").alias("best"), F.max("role").alias("role"))
    spellings = people.groupBy("case_id", "head").agg(F.countDistinct("norm").alias("n_spellings"))
    top = per.groupBy("case_id", "head").agg(F.sum("n").alias("n_mentions"), F.max("best").alias("b"), F.max("role").alias("r"), F.min(F.struct((-F.col("n")).alias("n"), F.col("category"))).alias("c"))
    return top.join(spellings, ["case_id", "head"]).select("case_id", F.col("b.name").alias("name"), F.col("r.role").alias("role"), F.col("c.category").alias("category"), "n_spellings", "n_mentions")


def sheets(df: DataFrame) -> DataFrame:
    """case_id, section, position, line: the briefing sheet of each case, line by line.

    Sections: 0 title, 1 case type, 2 plaintiffs, 3 defendants, 4 what happened (the
    parts of the narrative's paragraphs), 5 allegations, 6 defences, 7 names, 8
    vocabulary.  All parties are given; allegations and defences (ten), names (ten of a
    category) and terms (thirty) say how many more there are.  No row holds a list.
    """
    cases = df.select("case_id").where("case_id IS NOT NULL").distinct()
    row = lambda d, section, position, line: d.select("case_id", F.lit(section).alias("section"), position.cast("bigint").alias("position"), line.alias("line"))
    kind = case_type_vote(df).where("case_id IS NOT NULL")
    out = row(cases, 0, F.lit(0), F.lit("CASE BRIEFING SHEET")).unionByName(row(kind, 1, F.lit(0), F.when(F.col("case_type") == "unknown", "CASE TYPE: Not determined").otherwise(F.concat(F.lit("CASE TYPE: "), F.initcap("case_type")))))
    titles = {2: "PARTIES", 4: "WHAT HAPPENED", 5: "ALLEGATIONS", 6: "DEFENSES", 7: "NAMES TO KNOW", 8: "VOCABULARY"}
    for section, t in titles.items():
        out = out.unionByName(row(cases, section, F.lit(-2), F.lit(t))).unionByName(row(cases, section, F.lit(-1), F.lit("-" * len(t))))

    def add(items: DataFrame, section: int, none: str) -> None:
        nonlocal out
        out = out.unionByName(items).unionByName(row(cases.join(items.select("case_id").distinct(), "case_id", "left_anti"), section, F.lit(0), F.lit(none)))

    def top(items: DataFrame, section: int, order: list[str], cap: int, line, what: str, none: str) -> None:
        block = F.substring("norm", 1, 1) if order == ["norm"] else F.floor(F.col("first.chunk_id") / 4096)
        placed = ordinal(items.where("case_id IS NOT NULL"), ["case_id"], order, block, "i")
        more = items.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
        kept = row(placed.where(F.col("i") < cap), section, F.col("i"), line)
        add(kept.unionByName(row(more, section, F.lit(cap), F.concat(F.lit("  ... and "), (F.col("n") - cap).cast("string"), F.lit(f" more{what}")))), section, none)

    for section, (side, label) in ((2, ("plaintiffs", "Plaintiff(s): ")), (3, ("defendants", "Defendant(s): "))):
        named = ordinal(parties(df, side).where("case_id IS NOT NULL"), ["case_id"], ["name", "norm"], F.substring("name", 1, 2), "i")
        add(row(named, section, F.col("i"), F.concat(F.lit(label), "name")), section, label + "Not identified")
    told = narratives(df).where("case_id IS NOT NULL")
    out = out.unionByName(row(told, 4, F.col("paragraph") * F.lit(1 << 40) + F.col("position"), F.col("part")))
    short = lambda x: F.when(F.length(x) <= 200, x).otherwise(F.concat(F.substring(x, 1, 197), F.lit("...")))
    numbered = F.concat(F.lit("  "), (F.col("i") + 1).cast("string"), F.lit(". "), short(F.col("value")))
    for section, field in ((5, "allegations"), (6, "defenses")):
        top(first_seen(df, field), section, ["first"], 10, numbered, "", "None identified in documents.")
    place = F.create_map(*[F.lit(x) for i, v in enumerate(C.CATEGORY_NAMES) for x in (v, i)])
    people = names_section(df).where("case_id IS NOT NULL AND position <= 10").withColumn("o", F.coalesce(place[F.col("category")], F.lit(len(C.CATEGORY_NAMES))) * 100)
    heads = people.select("case_id", "o", "section").distinct()
    lines = row(people, 7, F.col("o") + F.col("position"), F.concat(F.lit("    - "), "line")).unionByName(row(heads.groupBy("case_id", "o").agg(F.min("section").alias("title")), 7, F.col("o"), F.concat(F.lit("  "), "title", F.lit(":"))))
    add(lines, 7, "No key individuals identified.")
    top(first_seen(df, "vocabulary"), 8, ["norm"], 30, F.concat(F.lit("  "), "value"), " terms", "No unusual terminology identified.")
    return out
