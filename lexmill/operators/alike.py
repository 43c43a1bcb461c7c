"""Pairs of like texts inside a group, compared in blocks of bounded size."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ordinal

#: Texts in a block; a task holds two blocks at a time.
BLOCK = 128


def last_alike(df: DataFrame, group: str, text: str, order: list[str | Column], least: float, contained: bool = False) -> DataFrame:
    """group, text, other: of every text the last one in each block after it
    whose letters are at least ``least`` like it (SequenceMatcher's ratio) or,
    with ``contained``, that contains it; texts without one have no row.

    ``df``: group, text (distinct in its group, no nulls), len; ``order`` begins
    with len, so the other text is never shorter.  Every pair of a group whose
    lengths allow it is compared: blocks of consecutive texts meet in pairs, so
    that no task holds a group.  Common letters and the longest common
    subsequence bound the ratio from above and spare most of its computations.
    """
    placed = ordinal(df.select(group, text, "len"), [group], order, F.col("len"), "_o").withColumn("_b", F.floor(F.col("_o") / BLOCK))
    blocks = placed.groupBy(group, "_b").agg(F.min("len").alias("_lo"), F.max("len").alias("_hi"), F.transform(F.array_sort(F.collect_list(F.struct("_o", text))), lambda x: x[text]).alias("_texts"))
    later = blocks.select(group, F.col("_b").alias("_b2"), F.col("_lo").alias("_lo2"), F.col("_texts").alias("_others"))
    reach = F.lit(True) if contained else F.col("_lo2") * least <= F.col("_hi") * (2 - least) + 1e-6
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = blocks.join(later, group).where((F.col("_b2") >= F.col("_b")) & reach).select(group, "_b", "_b2", "_texts", "_others").repartition(tasks, group, "_b", "_b2")

    def run(it):
        import pandas as pd

        for pdf in it:
            out = [(g, a, b) for g, i, j, x, y in zip(*(pdf[c] for c in pdf.columns)) for a, b in _last(list(x), list(y), i == j, least, contained)]
            yield pd.DataFrame(out, columns=[group, text, "other"])

    kind = df.schema[group].dataType.simpleString()
    return pairs.mapInPandas(run, f"{group} {kind}, {text} string, other string")


def _last(texts: list[str], others: list[str], same: bool, least: float, contained: bool) -> list[tuple[str, str]]:
    """Each text with the last of the others that is like it; in one and the
    same block only those after it count."""
    place: dict[str, int] = {}
    mine, theirs = ([[place.setdefault(c, len(place)) for c in t] for t in x] for x in (texts, others))
    count = lambda x: np.array([np.bincount(t, minlength=len(place)) for t in x], dtype=np.int32)
    mine, theirs = count(mine), count(theirs)
    sizes = mine.sum(1)
    found: dict[int, str] = {}
    for j in range(len(others) - 1, -1, -1):
        b = others[j]
        n = j if same else len(texts)
        common = np.minimum(mine[:n], theirs[j]).sum(1)
        near = 2.0 * common / np.maximum(sizes[:n] + len(b), 1) >= least
        if contained:
            near |= common == sizes[:n]
        matcher = None
        masks: dict[str, int] = {}
        for i in np.flatnonzero(near):
            if i in found:
                continue
            a = texts[i]
            if contained and a in b:
                found[i] = b
                continue
            if matcher is None:
                for k, c in enumerate(b):
                    masks[c] = masks.get(c, 0) | 1 << k
                matcher = SequenceMatcher(None, "", b, autojunk=False)
            if 2.0 * _common_subsequence(a, masks, len(b)) / (len(a) + len(b)) >= least:
                matcher.set_seq1(a)
                if matcher.ratio() >= least:
                    found[i] = b
    return [(texts[i], b) for i, b in found.items()]


def _common_subsequence(a: str, masks: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence with a text of ``n`` characters,
    given as the bits at which each character stands."""
    full = (1 << n) - 1
    v = full
    for c in a:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return n - v.bit_count()
