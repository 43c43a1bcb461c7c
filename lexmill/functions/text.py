"""Scalar text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_words(text: ColumnOrName) -> Column:
    """Lower case, with every foreign letter or digit as ``_`` and every other
    foreign character as a space, so that word boundaries fall as in Unicode."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^\x00-\x7F\p{L}\p{N}]", " "), r"[^\x00-\x7F]", "_")


def tokens(text: ColumnOrName, stop: list[str], least: int) -> Column:
    """Word tokens of at least ``least`` characters, without stop words, in order."""
    found = F.regexp_extract_all(ascii_words(text), F.lit(C.WORD_TOKEN), 0)
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(stop))


def vocabulary_tokens(text: ColumnOrName) -> Column:
    return tokens(text, C.STOP_VOCAB, 3)


def corpus_tokens(text: ColumnOrName) -> Column:
    return tokens(text, C.STOP_CORPUS, 2)


def retrieval_tokens(text: ColumnOrName) -> Column:
    """Lower-case words of letters, digits, ``_`` and ``-``; no stop words."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}_\-]+"), lambda w: w != "")


def question_keywords(text: ColumnOrName) -> Column:
    """Distinct keywords of three or more letters, sorted."""
    found = F.regexp_extract_all(ascii_words(text), F.lit(r"\b[a-zA-Z]+\b"), 0)
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(C.STOP_QUESTION))))


def word_count(text: ColumnOrName) -> Column:
    return F.size(F.filter(F.split(_c(text), r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+"), lambda w: w != ""))


def case_numbers(text: ColumnOrName) -> Column:
    """Distinct case, index and docket numbers, sorted."""
    all_ = F.concat(*[F.regexp_extract_all(_c(text), F.lit(p), 0) for p in C.CASE_NUMBER_PATTERNS])
    return F.array_sort(F.array_distinct(all_))


def dehyphenate(text: ColumnOrName) -> Column:
    return F.regexp_replace(_c(text), r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2")


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once per row; a plain reference
    inside a lambda would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: ColumnOrName) -> Column:
    """White space off both ends."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(C.PAGE_NUMBER_LINE)


def is_upper(line: Column) -> Column:
    return line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")


def is_legal_header(line: Column) -> Column:
    return is_upper(line) & (F.length(line) < 50) & line.rlike("|".join(C.LEGAL_HEADER_WORDS))


def keeps_line(line: Column) -> Column:
    """The line filter: long enough or a legal header, more letters than marks."""
    header = is_legal_header(line)
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    marks = F.length(F.regexp_replace(line, r"[\p{L}\s]", ""))
    return ((F.length(line) > C.MIN_LINE_LENGTH) | header) & (line.rlike(r"\p{Ll}") | header) & (letters > marks)


def normalize(text: ColumnOrName) -> Column:
    """De-hyphenation, page-number lines out, line filter, blank-line collapse."""
    lines = F.filter(F.split(dehyphenate(text), "\n"), lambda x: ~is_page_number(x) & keeps_line(x))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n\s*\n\s*\n+", "\n\n"))


REDACTION = r"[█▓▒]"


def redact(text: ColumnOrName) -> Column:
    return F.regexp_replace(_c(text), REDACTION + "{2,}", " [REDACTED] ")


def strip_controls(text: ColumnOrName) -> Column:
    """Control characters to spaces (line feeds and tabs stay), other C* out."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", " "), r"[\p{Cf}\p{Co}\p{Cs}]", "")


def collapse_whitespace(text: ColumnOrName) -> Column:
    spaced = F.regexp_replace(_c(text), r"[\t\x{A0}\x{2000}\x{2001}]", " ")
    return F.regexp_replace(F.regexp_replace(spaced, " {2,}", " "), r"\n{3,}", "\n\n")


def sanitize(text: ColumnOrName) -> Column:
    return collapse_whitespace(strip_controls(redact(text)))


def sanitize_counts(text: ColumnOrName) -> Column:
    """What the stages of ``sanitize`` take out: signs of redaction, control and
    private or format characters."""
    n = lambda p: F.regexp_count(_c(text), F.lit(p))
    return F.struct(n(REDACTION).alias("redacted"), n(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]").alias("control"), n(r"[\p{Cf}\p{Co}\p{Cs}]").alias("private"))


_N = r"([1-9]|1\d|2[0-5])"


def remove_line_numbers(text: ColumnOrName) -> Column:
    """Transcript line numbers 1 to 25 at either end of a line or behind a bar."""
    t = F.regexp_replace(_c(text), rf"(?md)^(\s*){_N}\s{{2,}}", "$1")
    t = F.regexp_replace(t, rf"(?md)\s{{2,}}{_N}$", "")
    return F.regexp_replace(t, rf"(?md)^\|{_N}\s*", "")


def convert_qa(text: ColumnOrName) -> Column:
    t = F.regexp_replace(_c(text), r"(?md)^(\s*)Q([.:])?\s+", "$1Question: ")
    return F.regexp_replace(t, r"(?md)^(\s*)A([.:])?\s+", "$1Answer: ")


def first_label(text: Column, rules: list[tuple[str, str]], wrap: str) -> Column:
    """The label of the first rule whose pattern occurs; null if none."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(wrap.format(pattern)), F.lit(label)).otherwise(out)
    return out


def section_label(text: ColumnOrName) -> Column:
    return first_label(F.substring(_c(text), 1, 200), C.SECTION_PATTERNS, r"(?imd)^\s*(?:{})")


def section_name(text: ColumnOrName) -> Column:
    """The first fifty characters of what the first pattern in the list matches; null
    if none does.  ``[`` inside a class is escaped for Java."""
    found = [F.nullif(F.regexp_extract(_c(text), "(?imd)" + p.replace("[\\[{", "[\\[\\{"), 0), F.lit("")) for p in C.CHUNK_SECTION_PATTERNS]
    return F.substring(F.coalesce(*found), 1, 50)


def document_type(text: ColumnOrName, filename: ColumnOrName) -> Column:
    name = F.lower(_c(filename))
    by_text = first_label(F.substring(_c(text), 1, 5000), C.DOC_TYPE_PATTERNS, "(?i)(?:{})")
    return (
        F.when(name.contains("complaint"), "complaint")
        .when(name.contains("answer"), "answer")
        .when(name.contains("transcript") | name.contains("depo"), "transcript")
        .when(name.contains("bill") & name.contains("particulars"), "bill_of_particulars")
        .otherwise(F.coalesce(by_text, F.lit("unknown")))
    )


def title_score(page: ColumnOrName) -> Column:
    """Points of a page for looking like a title page."""
    p = _c(page)
    score = sum((F.when(p.rlike(pattern.replace("(?m)", "(?md)").replace("(?im)", "(?imd)")), points).otherwise(0) for pattern, points in C.TITLE_PAGE_PATTERNS), F.lit(0))
    return score + F.when((F.length(strip(p)) < 500) & (score > 0), 1).otherwise(0)


def pages(text: ColumnOrName) -> Column:
    """Pages by form feeds, else by wide gaps or rules, else the first 2000 characters."""
    t = _c(text)
    full = lambda a: F.filter(a, lambda x: strip(x) != "")
    gaps = F.split(t, r"\n{4,}|\n\s*-{10,}\s*\n")
    return (
        F.when(t.contains("\f"), full(F.split(t, "\f")))
        .when(F.size(gaps) > 1, full(gaps))
        .when(F.length(t) > 3000, F.array(F.substring(t, 1, 2000), F.substring(t, 2001, 2**30)))
        .otherwise(F.array(t))
    )


def remove_title_pages(text: ColumnOrName) -> Column:
    p = pages(text)
    kept = F.filter(p, lambda x, i: (i >= C.TITLE_PAGES_LOOKED_AT) | (title_score(x) < C.TITLE_PAGE_SCORE))
    return F.when(F.size(p) > 1, F.array_join(kept, "\n\n")).otherwise(_c(text))


def document_hash(text: ColumnOrName) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.md5(F.substring(_c(text), 1, 1000)), 1, 12))


def duration(seconds: ColumnOrName) -> Column:
    """``1h 2m 5s``; leading zero parts are left out."""
    s = F.floor(_c(seconds)).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    sec = F.concat((s % 60).cast("string"), F.lit("s"))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), sec)).when(m > 0, F.concat(m.cast("string"), F.lit("m "), sec)).otherwise(sec)


def normalize_name(name: ColumnOrName) -> Column:
    """Lower case without titles and punctuation, single spaces."""
    n = F.regexp_replace(F.lower(_c(name)), C.NAME_TITLES, "")
    return F.trim(F.regexp_replace(F.regexp_replace(n, r"[,.'\"()]", ""), r"\s+", " "))


def case_type(hint: ColumnOrName) -> Column:
    """The first family with a variant inside the hint, else the hint itself."""
    low = F.lower(F.trim(_c(hint)))
    out = low
    for family, variants in reversed(C.CASE_TYPES):
        test = low.contains(variants[0])
        for v in variants[1:]:
            test = test | low.contains(v)
        out = F.when(test, F.lit(family)).otherwise(out)
    return out


def rake_text(text: ColumnOrName) -> Column:
    t = F.regexp_replace(_c(text), r"(?md)^\s*\d{1,2}\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b\d+\b", ""), r"\s+", " "))


def sentences(text: ColumnOrName) -> Column:
    """Sentences, with abbreviation periods and numbered periods protected."""
    t = F.regexp_replace(_c(text), r"\[[^\]]+\]:", "")
    t = F.regexp_replace(t, r"(Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Jr\.|Sr\.)", "$1\u0001")
    t = F.regexp_replace(t, r"(Inc\.|Corp\.|Ltd\.|Co\.|\d+\.)", "$1\u0001")
    parts = F.transform(F.split(t, r"[.!?]+\s+"), lambda s: strip(F.replace(s, F.lit("\u0001"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def clean_sentence(s: Column) -> Column:
    t = strip(F.regexp_replace(s, r"\s+", " "))
    return F.when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))
