"""Line and page operators: from the lines of a text to a cleaner text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def _normal_line(line):
    n = F.regexp_replace(T.strip(line), r"\s*-?\s*\d+\s*-?\s*$", "")
    return F.lower(T.strip(F.regexp_replace(n, r"\s+", " ")))


def header_footer(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_removed and the text without its running headers and footers.

    A line goes if its normal form occurs at least three times in the text and
    one of its originals looks like a header.  Counting happens inside each
    row's own array of lines, so nothing is shuffled, however long one text or
    however many texts.  Null texts stay null with nothing removed.
    """
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in C.HEADER_FOOTER_PATTERNS)
    looks = lambda x: (F.length(T.strip(x["line"])) <= C.MAX_HEADER_LENGTH) & (T.strip(x["line"]) != "") & x["line"].rlike(pattern)
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), _normal_line(x).alias("norm")))

    def repeated(all_, named):
        # in a sorted array a form that occurs three times stands two places before itself
        norms = F.array_sort(F.filter(F.transform(all_, lambda x: x["norm"]), lambda n: (n != "") & F.array_contains(named, n)))
        return T.let(norms, lambda ns: F.array_distinct(F.filter(ns, lambda n, i: F.coalesce(F.get(ns, i + C.MIN_HEADER_OCCURRENCES - 1) == n, F.lit(False)))))

    def clean(all_, gone):
        kept = F.transform(F.filter(all_, lambda x: ~F.array_contains(gone, x["norm"])), lambda x: x["line"])
        return T.let(kept, lambda k: F.struct((F.size(all_) - F.size(k)).alias("n"), F.array_join(k, "\n").alias("t")))

    named = lambda all_: F.array_distinct(F.transform(F.filter(all_, looks), lambda x: x["norm"]))
    whole = T.let(lines, lambda all_: T.let(named(all_), lambda ns: T.let(repeated(all_, ns), lambda gone: clean(all_, gone))))
    return df.select(key, whole.alias("_w")).select(key, F.coalesce("_w.n", F.lit(0)).alias("n_removed"), F.col("_w.t").alias(text))


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Steps in order; ``df.transform(pipeline(...))``."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


def default_pipeline(key: str, text: str) -> Callable[[DataFrame], DataFrame]:
    """Title pages, headers and footers, line numbers, questions and answers."""
    return pipeline(
        lambda df: df.withColumn(text, T.remove_title_pages(text)),
        lambda df: header_footer(df, key, text).select(key, text),
        lambda df: df.withColumn(text, T.remove_line_numbers(text)),
        lambda df: df.withColumn(text, T.convert_qa(text)),
    )
