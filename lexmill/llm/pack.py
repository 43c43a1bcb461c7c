"""Problem 7: filling containers of fixed capacity with items of varying length.

Planning works on the length histogram, not on documents: best-fit decreasing
over counts.  The histogram has less than ``capacity`` lengths, so it is bounded by
the container sizes, whatever the number of documents.  A plan is a list of segments:
the items of one length with ranks ``from`` .. ``from + n - 1`` go to containers
``base``, ``base + 1``, ..., ``per`` items each.  The segments are spread out into
slots, and the documents take them by a join on capacity, length and rank.

An item larger than the capacity is cut into full pieces, each filling one
container, and a rest that is packed like any other item.  Full pieces are planned by
nobody: a document's first container is the number of full pieces before it, a running
sum over documents.

Ranks and running sums are counted within salts and shifted by the totals of the salts
before.  The number of salts comes from the counts (``SALT`` rows in each), so that
no length, however frequent, is sorted in one task.

Defined results: null and empty texts have no tokens and take no slot; a text
of blanks does.  Repeated ids are separate items only if the rows differ in
their tokens; the key is expected to be unique.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from . import tokenize

#: Rows that are ranked in one task, and slots that one row is spread into.
SALT = 100_000


def plan(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts.

    ``histogram``: (length, count), each length at most ``capacity``.  Gives
    segments (length, first rank, number of items, first container, items per
    container) and the number of containers.
    """
    free: list[int] = []  # the free sizes of open groups, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # free size -> (first container, containers)
    segments: list[tuple[int, int, int, int, int]] = []
    used = 0

    def leave(size: int, base: int, n: int) -> None:
        if n and size:
            if size not in groups:
                groups[size] = []
                insort(free, size)
            groups[size].append((base, n))

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while count:
            k = bisect_left(free, length)
            if k < len(free):
                size = free[k]
                base, n = groups[size].pop()
                if not groups[size]:
                    del groups[size]
                    free.pop(k)
            else:
                size, base = capacity, used
                n = -(-count // (capacity // length))
                used += n
            per = size // length
            full = min(n, count // per)
            if full:
                segments.append((length, rank, full * per, base, per))
                leave(size - per * length, base, full)
                rank, count = rank + full * per, count - full * per
            rest = min(count, per) if full < n else 0
            if rest and count < per:
                segments.append((length, rank, rest, base + full, rest))
                leave(size - rest * length, base + full, 1)
                rank, count, full = rank + rest, count - rest, full + 1
            leave(size, base + full, n - full)
    return segments, used


def _before(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``rows`` (with a salt) and the sum of ``value`` over the rows before, counted
    within salts; ``_order`` breaks no tie twice."""
    totals = rows.groupBy(*group, "salt").agg(F.sum(value).alias("_n"))
    start = totals.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*group, "salt").orderBy("_order").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(start, [*group, "salt"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside", "salt", "_order")


def _salted(rows: DataFrame, group: list[str], counts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the salt of each, as many in a group as ``counts`` (group, n) call for."""
    salts = counts.select(*group, F.ceil(F.col("n") / SALT).cast("int").alias("_salts"))
    return rows.join(salts, group).withColumn("_order", F.struct(key, F.xxhash64(key))).withColumn("salt", F.pmod(F.xxhash64(key, *group), "_salts").cast("int")).drop("_salts")


def fill(spark: SparkSession, docs: DataFrame, capacities: list[int], key: str = "doc_id", text: str = "text", path: str = tokenize.TOKENIZER) -> DataFrame:
    """capacity, key, piece (from 0), length and container (from 0 for each
    capacity) of every piece of a document."""
    sized = materialize(tokenize.sizes(docs.where(F.length(text) > 0), key, text, path).where("n_tokens > 0"), "sizes")
    caps = spark.createDataFrame([(int(c),) for c in sorted(set(capacities)) if c and c > 0], "capacity int")
    items = sized.crossJoin(F.broadcast(caps)).select("capacity", key, F.expr("n_tokens DIV capacity").alias("whole"), F.expr("n_tokens % capacity").alias("length"))  # a handful of capacities

    # bounded: less than the sum of the capacities
    counts = materialize(items.where("length > 0").groupBy("capacity", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    full = items.where("whole > 0")
    n_full = materialize(full.groupBy("capacity").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("pieces")), "full")
    taken = {r.capacity: r.pieces for r in n_full.collect()}
    histogram: dict[int, list[tuple[int, int]]] = {}
    for r in counts.collect():
        histogram.setdefault(r.capacity, []).append((r.length, r.n))
    rows = []
    for c, h in histogram.items():
        for length, first, n, base, per in plan(h, c)[0]:
            step = max(per, SALT - SALT % per)  # whole containers
            rows += [(c, length, first + at, min(step, n - at), base + taken.get(c, 0) + at // per, per) for at in range(0, n, step)]
    segments = spark.createDataFrame(rows, "capacity int, length bigint, first bigint, n bigint, base bigint, per bigint")
    slot = segments.select("capacity", "length", "first", "base", "per", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    slots = slot.select("capacity", "length", (F.col("first") + F.col("i")).alias("rank"), (F.col("base") + F.floor(F.col("i") / F.col("per"))).alias("container"))

    group = ["capacity", "length"]
    ranked = _before(_salted(items.where("length > 0").withColumn("one", F.lit(1)), group, counts, key), group, "one", "rank")
    rest = ranked.join(slots, [*group, "rank"]).select("capacity", key, F.col("whole").cast("int").alias("piece"), "length", F.col("container").cast("bigint"))
    placed = _before(_salted(full, ["capacity"], n_full.select("capacity", "n"), key), ["capacity"], "whole", "before")
    pieces = placed.select("capacity", key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"), "before")
    whole = pieces.select("capacity", key, F.col("piece").cast("int").alias("piece"), F.col("capacity").cast("bigint").alias("length"), (F.col("before") + F.col("piece")).cast("bigint").alias("container"))
    return rest.unionByName(whole).select("capacity", F.col(key).cast("bigint").alias(key), "piece", F.col("length").cast("bigint"), "container")
