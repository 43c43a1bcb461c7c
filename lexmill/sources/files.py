"""Reading folders of documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MAX_BYTES, LARGE_BYTES = 500 * 1024**2, 100 * 1024**2
_RTF_WORD = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "datastore"}


def rtf_text(raw: str) -> str:
    """The plain text of an RTF document: groups, control words, escapes."""
    out: list[str] = []
    stack: list[bool] = []
    skip, first = False, False
    for word, arg, byte, sign, brace, text in _RTF_WORD.findall(raw):
        if brace == "{":
            stack.append(skip)
            first = True
            continue
        if brace == "}":
            skip = stack.pop() if stack else False
        elif word:
            if first and word in _RTF_SKIP:
                skip = True
            elif not skip:
                if word in ("par", "line", "page", "sect"):
                    out.append("\n")
                elif word == "tab":
                    out.append("\t")
                elif word == "u" and arg:
                    out.append(chr(int(arg) % 65536))
                elif word in ("emdash", "endash", "lquote", "rquote", "ldblquote", "rdblquote", "bullet"):
                    out.append({"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}[word])
        elif sign == "*" and first:
            skip = True
        elif not skip:
            if byte:
                out.append(bytes([int(byte, 16)]).decode("cp1252", "ignore"))
            elif sign in ("\\", "{", "}"):
                out.append(sign)
            elif sign == "~":
                out.append(" ")
            elif text:
                out.append(text)
        first = False
    return "".join(out).strip()


def documents(spark: SparkSession, path: str) -> DataFrame:
    """filename, status, method, confidence, text, case_numbers, file_size,
    error_message of every file under a folder.

    Text and RTF are read; other kinds give an error row, never an exception.
    Oversized files are sorted out by their length before they are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))

    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: b.decode("utf-8", "ignore"))

    def plain(content: pd.Series) -> pd.Series:
        return content.map(lambda b: rtf_text(b.decode("latin-1")))

    from pyspark.sql.functions import pandas_udf

    txt, rtf = pandas_udf(decode, "string"), pandas_udf(plain, "string")
    meta = files.select("path", name.alias("filename"), ext.alias("ext"), F.col("length").alias("file_size"), "content")
    ok = meta.where(F.col("file_size") <= MAX_BYTES)
    read = lambda e, f, m: ok.where(F.col("ext") == e).select("filename", "file_size", F.lit(m).alias("method"), f("content").alias("text"))
    good = read("txt", txt, "direct_read").unionByName(read("rtf", rtf, "rtf_extraction"))
    good = good.withColumn("case_numbers", T.case_numbers("text")).withColumn("text", T.sanitize(T.normalize("text")))
    good = good.select("filename", F.when(F.col("text") == "", "error").otherwise("success").alias("status"), "method", F.lit(100).alias("confidence"), "text", "case_numbers", "file_size", F.when(F.col("text") == "", "No text after normalisation").alias("error_message"))
    bad = meta.where((F.col("file_size") > MAX_BYTES) | ~F.col("ext").isin("txt", "rtf"))
    reason = F.when(F.col("file_size") > MAX_BYTES, "File too large").otherwise("Unsupported file type")
    none = F.lit(None).cast("string")
    return good.unionByName(bad.select("filename", F.lit("error").alias("status"), none.alias("method"), F.lit(0).alias("confidence"), none.alias("text"), F.array().cast("array<string>").alias("case_numbers"), "file_size", reason.alias("error_message")))


def word_list(spark: SparkSession, path: str, skip_comments: bool = False) -> DataFrame:
    """word: trimmed lower-case lines, blanks skipped."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''")
    return words.where(~F.col("word").startswith("#")) if skip_comments else words
