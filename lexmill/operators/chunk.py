"""Chunkers: greedy folds over paragraphs and a recursive splitter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .ranks import ordinal, starts


def paragraphs(text: str) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def section_chunks(df: DataFrame, key: str, text: str, limit: int = C.SECTION_MAX_WORDS) -> DataFrame:
    """key, chunk_num (from 1), text, word_count, section_name.

    A chunk closes before a paragraph that begins a section, or that would carry
    it over ``limit`` words; one long paragraph stays whole.  A chunk that closes for
    its length alone leaves its section behind.  The fold is a
    higher-order aggregate inside each row.  Null and blank texts have no chunks.
    """
    words = lambda p: F.size(F.split(F.trim(p), r"\s+"))
    part = "struct<text:string,words:int,section:string>"
    start = F.struct(F.array().cast(f"array<{part}>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("sec"))

    def step(a, x):
        found = x["section"]
        p = x["text"]
        closes = (a["n"] > 0) & (found.isNotNull() | (a["n"] + words(p) > limit))
        closed = F.array_append(a["done"], F.struct(a["buf"].alias("text"), a["n"].alias("words"), a["sec"].alias("section")))
        return F.struct(
            F.when(closes, closed).otherwise(a["done"]).alias("done"),
            F.when(closes | (a["n"] == 0), p).otherwise(F.concat(a["buf"], F.lit("\n\n"), p)).alias("buf"),
            F.when(closes, words(p)).otherwise(a["n"] + words(p)).alias("n"),
            F.when(closes, found).otherwise(F.coalesce(found, a["sec"])).alias("sec"),
        )

    end = lambda a: F.when(a["n"] > 0, F.array_append(a["done"], F.struct(a["buf"].alias("text"), a["n"].alias("words"), a["sec"].alias("section")))).otherwise(a["done"])
    named = F.transform(paragraphs(text), lambda p: F.struct(p.alias("text"), T.section_name(p).alias("section")))
    folded = F.aggregate(named, start, step, end)
    return df.select(key, F.posexplode(folded).alias("i", "c")).select(key, (F.col("i") + 1).alias("chunk_num"), F.col("c.text").alias("text"), F.col("c.words").alias("word_count"), F.col("c.section").alias("section_name"))


# -- chunkers that scan backwards, for Arrow batches ----------------------


def force_split(text: str, target: int = C.BRIEF_TARGET, most: int = C.BRIEF_MAX) -> list[str]:
    """Pieces of at most ``most`` characters, cut behind the last sentence end
    in [target - 200, most), else at the last space there, else hard."""
    out = []
    while len(text) > most:
        window = text[target - 200 : most]
        cut = max(window.rfind(x) for x in (". ", "? ", "! "))
        cut = cut + 1 if cut >= 0 else window.rfind(" ")
        at = target - 200 + cut if cut > 0 else most
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [*out, text] if text else out


def brief_paragraphs(text: str) -> list[str]:
    """Paragraphs; where one is too long, lines regrouped to the target size."""
    parts = [p.strip() for p in text.split("\n\n") if p.strip()]
    if any(len(p) > C.BRIEF_MAX for p in parts):
        parts, buf = [], ""
        for line in (x.strip() for x in text.split("\n")):
            if not line:
                continue
            if buf and len(buf) + len(line) + 1 > C.BRIEF_TARGET:
                parts.append(buf)
                buf = ""
            buf = f"{buf}\n{line}" if buf else line
        if buf:
            parts.append(buf)
    return [piece for p in parts for piece in (force_split(p) if len(p) > C.BRIEF_MAX else [p])]


def recursive_split(text: str, size: int = C.SPLIT_SIZE, overlap: int = C.SPLIT_OVERLAP, seps: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """The published recursive character splitter: split at the first separator
    that occurs, merge pieces up to ``size``, carry ``overlap`` over, and split
    what is still too long by the next separators."""
    at = next((i for i, s in enumerate(seps) if s == "" or s in text), len(seps) - 1)
    sep, rest = seps[at], seps[at + 1 :]
    pieces = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    good: list[str] = []

    def flush() -> None:
        cur: list[str] = []
        n = 0
        for p in good:
            extra = len(p) + (len(sep) if cur else 0)
            if cur and n + extra > size:
                if joined := sep.join(cur).strip():
                    out.append(joined)
                while cur and (n > overlap or n + extra > size):
                    n -= len(cur[0]) + (len(sep) if len(cur) > 1 else 0)
                    cur.pop(0)
                extra = len(p) + (len(sep) if cur else 0)
            cur.append(p)
            n += extra
        if joined := sep.join(cur).strip():
            out.append(joined)
        good.clear()

    for p in pieces:
        if len(p) <= size:
            good.append(p)
            continue
        flush()
        out += recursive_split(p, size, overlap, rest) if rest else [p]
    flush()
    return out


def split_texts(df: DataFrame, key: str, text: str, how: str = "recursive") -> DataFrame:
    """key, chunk_num (from 0), text; ``how``: "recursive" or "brief"."""
    cut = {"recursive": recursive_split, "brief": brief_paragraphs}[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for i, c in enumerate(cut(t))]
            ks, ns, cs = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ks, b.schema.field(0).type), pa.array(ns, pa.int32()), pa.array(cs, pa.string())], names=[key, "chunk_num", "text"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, chunk_num int, text string")


def brief_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_index (from 0), text, char_count, section_hint.

    A chunk closes at the hard limit, at the target before a longer paragraph, or
    at a section once it has the minimum.  The hint is that of the newest
    section seen, also for the chunk that it closes.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [brief_paragraphs(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.string()))], names=[key, "ps"])

    # the paragraphs of a text stay in its row: nothing is shuffled
    parts = df.select(key, text).mapInArrow(cut, f"{key} {dict(df.dtypes)[key]}, ps array<string>")
    label = lambda p: T.section_label(p)
    part = "struct<text:string,hint:string>"
    start = F.struct(F.array().cast(f"array<{part}>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("hint"))

    def step(a, p):
        sec = label(p)
        hint = F.coalesce(sec, a["hint"])
        closes = (a["n"] > 0) & ((a["n"] + F.length(p) > C.BRIEF_MAX) | ((a["n"] >= C.BRIEF_TARGET) & (F.length(p) > 200)) | (sec.isNotNull() & (a["n"] >= C.BRIEF_MIN)))
        return F.struct(
            F.when(closes, F.array_append(a["done"], F.struct(a["buf"].alias("text"), hint.alias("hint")))).otherwise(a["done"]).alias("done"),
            F.when(closes | (a["n"] == 0), p).otherwise(F.concat(a["buf"], F.lit("\n\n"), p)).alias("buf"),
            F.when(closes, F.length(p)).otherwise(a["n"] + F.length(p)).alias("n"),
            hint.alias("hint"),
        )

    end = lambda a: F.when(a["n"] > 0, F.array_append(a["done"], F.struct(a["buf"].alias("text"), a["hint"].alias("hint")))).otherwise(a["done"])
    return parts.select(key, F.posexplode(F.aggregate("ps", start, step, end)).alias("chunk_index", "c")).select(key, "chunk_index", F.col("c.text").alias("text"), F.length("c.text").alias("char_count"), F.col("c.hint").alias("section_hint"))


def chunk_ids(chunks: DataFrame, doc: str, num: str, coarse: int = 3, fine: int = 8, block: int = 65536) -> DataFrame:
    """``chunks`` with chunk_id ``document_n``, n counting from 0 over all chunks
    in the order of documents and their chunks.

    Chunks are ranked inside their document, in blocks, and shifted by the sizes
    of the documents before, which are summed by the first letters of their
    names; no window spans all rows.  Chunks without a document or a number get
    no id and fall away.
    """
    known = chunks.where(F.col(doc).isNotNull() & F.col(num).isNotNull())
    sizes = known.groupBy(doc).agg(F.count(F.lit(1)).alias("_size"))
    first = starts(sizes, doc, "_size", F.substring(doc, 1, coarse), F.substring(doc, 1, fine), "_first").select(doc, "_first")
    placed = ordinal(known, [doc], [num], F.floor(F.col(num) / block), "_n").join(first, doc)
    return placed.withColumn("chunk_id", F.concat(F.col(doc), F.lit("_"), (F.col("_first") + F.col("_n")).cast("string"))).drop("_first", "_n")
