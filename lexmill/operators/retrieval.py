"""Lexical and vector retrieval, and merging of their hits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import constants as C
from ..functions import text as T
from ..session import materialize

#: Vectors in a block of the blocked search.
BLOCK = 2048
#: Texts and tokens in a block of the lexical search, and questions beside it.
TEXTS, TOKENS, QUESTIONS = 8192, 1_000_000, 2048
#: A term is summed up by a matrix product if more than one of so many texts has it.
OFTEN = 16


def posting_blocks(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """Postings of up to ``TEXTS`` texts and about ``TOKENS`` tokens a row: ids in order
    and their lengths, terms and how many texts each has, and by term the places of
    these texts among the ids with the times that they have it."""
    kind = dict(chunks.dtypes)[key]
    out = _parse_datatype_string(f"n bigint, sized bigint, tokens bigint, ids array<{kind}>, lengths array<int>, terms array<string>, counts array<int>, places array<int>, times array<int>")
    arrow = to_arrow_schema(out)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[(t.column_names[0], "ascending")])).combine_chunks()
        ids, tokens = (c.combine_chunks() for c in t.columns)
        n, size = len(ids), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        pair, times = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), size), return_counts=True)
        code, place = np.divmod(pair, n)
        row = [n, n - tokens.null_count, int(size.sum()), ids, size, coded.dictionary, np.bincount(code, minlength=len(coded.dictionary)), place, times]
        cols = [pa.array([x], f.type) if isinstance(x, int) else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x).cast(f.type.value_type)).cast(f.type) for x, f in zip(row, arrow)]
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, free = [], TEXTS, TOKENS
        for b in batches:
            while b.num_rows:
                ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
                n = min(texts, max(1, int(np.searchsorted(ends, free, "right"))))
                held.append(b.slice(0, n))
                texts, free, b = texts - n, free - int(ends[n - 1]), b.slice(n)
                if b.num_rows or texts == 0 or free <= 0:
                    yield packed(held)
                    held, texts, free = [], TEXTS, TOKENS
        if held:
            yield packed(held)

    return materialize(chunks.select(key, T.retrieval_tokens(text).alias("tokens")).mapInArrow(run, out), "postings")


def bm25_plus(chunks: DataFrame, key: str, text: str, questions: DataFrame, qkey: str, qtext: str, k: int = 5) -> DataFrame:
    """qkey, key, score, relevance, rank: the best chunks of each question.

    Every chunk scores at least the constant part (idf x delta of the question's
    terms), so all chunks are candidates of all questions.  Exact search in blocks:
    each pair of a block of chunks and a block of questions is scored in one task and
    gives its best k only, so pairs of a question and a chunk are never rows.  Chunks
    are cut into tokens once.  Empty tables give no rows, nor do questions without a
    term of the chunks.  Ties go to the smaller key.
    """
    post = posting_blocks(chunks, key, text)
    stats = post.agg(F.sum("n").alias("n_chunks"), (F.sum("tokens") / F.sum("sized")).alias("avg_len"))
    asked = questions.select(qkey, F.explode(T.retrieval_tokens(qtext)).alias("term")).groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("times"))
    df_ = post.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
    weighed = asked.join(df_, "term").crossJoin(F.broadcast(stats))  # stats: one row
    weight = F.col("times") * F.log((F.col("n_chunks") + 1) / F.col("df"))
    asks = weighed.groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("weight")))).alias("x"), F.first("avg_len").alias("avg_len"))
    asks = asks.withColumn("b", F.floor(F.monotonically_increasing_id() / QUESTIONS)).groupBy("b")
    asks = materialize(asks.agg(F.collect_list(qkey).alias("asks"), F.collect_list("x.term").alias("ask_terms"), F.collect_list("x.weight").alias("weights"), F.first("avg_len").alias("avg_len")).drop("b"), "questions")
    kinds = dict(questions.dtypes)[qkey], dict(chunks.dtypes)[key]
    out = _parse_datatype_string(f"{qkey} {kinds[0]}, {key} {kinds[1]}, score double")
    arrow = to_arrow_schema(out)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(name)[i] for name in b.schema.names}
                lengths, counts, places, times = (r[x].values.to_numpy(zero_copy_only=False) for x in ("lengths", "counts", "places", "times"))
                part = times * (C.PLUS_K1 + 1) / (C.PLUS_K1 * (1 - C.PLUS_B + C.PLUS_B * lengths[places] / r["avg_len"].as_py()) + times)
                qi, vi, scores = _best_of_block(len(lengths), counts, places, part, r["terms"].values, r["ask_terms"].values, r["weights"].values, k)
                cols = r["asks"].values.take(pa.array(qi)), r["ids"].values.take(pa.array(vi)), pa.array(scores)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    # never broadcast: a small file may be a large table in memory
    pairs = post.select("ids", "lengths", "terms", "counts", "places", "times").hint("shuffle_replicate_nl").crossJoin(asks)
    return top_k(pairs.mapInArrow(best, out), qkey, key, k)


def _best_of_block(n: int, counts: np.ndarray, places: np.ndarray, part: np.ndarray, terms: pa.Array, ask_terms: pa.ListArray, weights: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, place, score) of the best k of n texts for each question of a block;
    scores have nine decimals, ties go to the smaller place.

    Terms that many texts have are summed up by a matrix product, the others along
    their postings."""
    ends = np.cumsum(counts)
    codes = pc.fill_null(pc.index_in(ask_terms.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    w = weights.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(ask_terms).to_numpy(zero_copy_only=False))])
    here = np.unique(codes[codes >= 0])
    often = here[counts[here] * OFTEN > n]
    dense = np.zeros((len(often), n))
    for j, c in enumerate(often):
        dense[j, places[ends[c] - counts[c] : ends[c]]] = part[ends[c] - counts[c] : ends[c]]
    row = np.full(len(counts), -1)
    row[often] = np.arange(len(often))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(at) - 1, 64):
        hi = min(lo + 64, len(at) - 1)
        of, c, v = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])), codes[at[lo] : at[hi]], w[at[lo] : at[hi]]
        common = np.zeros((hi - lo, len(often)))
        held = (c >= 0) & (row[c] >= 0)
        common[of[held], row[c[held]]] = v[held]
        gain = common @ dense
        for q, x, y in zip(of[~held & (c >= 0)], c[~held & (c >= 0)], v[~held & (c >= 0)]):
            s = slice(ends[x] - counts[x], ends[x])
            gain[q, places[s]] += y * part[s]
        least = np.partition(gain, n - k, axis=1)[:, n - k] if n > k else np.full(hi - lo, -1.0)
        base = np.bincount(of, weights=v, minlength=hi - lo) * C.PLUS_DELTA
        qi, vi = np.nonzero(gain >= least[:, None] - 2e-9)  # what may be as good when rounded
        score = np.rint((base[qi] + gain[qi, vi]) * 1e9) / 1e9
        order = np.lexsort((vi, -score, qi))
        qi, vi, score = qi[order], vi[order], score[order]
        first = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        found.append((qi[first] + lo, vi[first], score[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def top_k(hits: DataFrame, qkey: str, key: str, k: int) -> DataFrame:
    """Rank by score and normalise: score / (score + best score)."""
    w = W.partitionBy(qkey).orderBy(F.desc("score"), F.asc(key))
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = F.max("score").over(W.partitionBy(qkey))
    return ranked.withColumn("relevance", F.round(F.col("score") / (F.col("score") + best), 6)).select(qkey, key, F.round("score", 6).alias("score"), "relevance", "rank")


def vector_top_k(rows: DataFrame, key: str, vec: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """query, key, relevance, rank: the nearest vectors by Euclidean distance,
    relevance = 1 - distance / sqrt(2), not below 0.

    Exact search in blocks: vectors and queries are grouped into blocks of fixed
    size, pairs of blocks are compared by one matrix product each, and each
    gives its best k only.
    """
    block = lambda df, kn, vn, b: df.where(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.col(vec).alias("v")).withColumn("b", F.floor(F.monotonically_increasing_id() / BLOCK)).groupBy("b").agg(F.collect_list("id").alias(kn), F.collect_list("v").alias(vn)).drop("b")
    pairs = block(rows, "ids", "vs", "b").crossJoin(block(queries, "qids", "qs", "c"))

    def best(it):
        for pdf in it:
            for r in pdf.itertuples(index=False):
                v, q = np.array(r.vs.tolist(), np.float64), np.array(r.qs.tolist(), np.float64)
                ids, qids = np.asarray(r.ids), np.asarray(r.qids)
                d2 = np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * q @ v.T, 0.0)
                n = min(k, len(ids))
                low = np.sort(d2, axis=1)[:, n - 1]
                qi, vi = np.nonzero(d2 <= low[:, None] + 1e-12)
                yield pd.DataFrame({"query": qids[qi], "id": ids[vi], "distance": np.sqrt(d2[qi, vi])})

    near = pairs.mapInPandas(best, "query bigint, id bigint, distance double")
    rel = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") / math.sqrt(2)))
    w = W.partitionBy("query").orderBy(F.desc("relevance"), F.asc("id"))
    return near.select("query", "id", F.round(rel, 6).alias("relevance")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("id", key)


def merge_hits(hits: DataFrame, qkey: str, key: str, k: int) -> DataFrame:
    """Hits of several algorithms (qkey, key, algorithm, weight, relevance) as one
    ranking: the weighted mean over the algorithms that returned a chunk, and a
    tenth more for each further one, at most 1."""
    g = hits.groupBy(qkey, key).agg(
        F.sum(F.col("relevance") * F.col("weight")).alias("s"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("sources")
    )
    score = F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide("s", "w"), F.lit(0.0)) + 0.1 * (F.col("n") - 1)), 6)
    w = W.partitionBy(qkey).orderBy(F.desc("score"), F.asc(key))
    return g.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(qkey, key, "score", "sources", "rank")
