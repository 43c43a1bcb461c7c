"""Searching vocabularies that grow with the corpus: tries over blocks of words.

Words and the tokens to look up are tables.  Both carry a block, which every word
that can answer a token shares with it.  A block with many words is cut into parts,
each of which becomes one trie, and a block with many tokens into salts, so that no
task holds more than ``PART`` words and no block is one task.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Words in one trie, and tokens looked up beside one copy of it.
PART, SALT = 20_000, 5_000

Ask = Callable[[str, int], Iterable[tuple]]


def search(words: DataFrame, tokens: DataFrame, prepare: Callable[[list[tuple[str, int]]], Ask], schema: str, part: int = PART, salt: int = SALT) -> DataFrame:
    """token and what ``prepare(words of a part)(token, n)`` gives, one row for each.

    ``words``: block, word, n; ``tokens``: block, token, n.  Words of blocks that no
    token asks for are left out before they are moved; tokens whose block has no
    words have no rows.
    """
    asked = tokens.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / salt).cast("int").alias("salts"))
    held = words.join(asked, "block", "left_semi").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    size = asked.join(held, "block")
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = words.join(size, "block").select("block", pick("word", "parts").alias("part"), every("salts").alias("salt"), F.lit(0).alias("role"), F.col("word").alias("text"), F.col("n").cast("bigint").alias("n"))
    right = tokens.join(size, "block").select("block", every("parts").alias("part"), pick("token", "salts").alias("salt"), F.lit(1).alias("role"), F.col("token").alias("text"), F.col("n").cast("bigint").alias("n"))
    place = ["block", "part", "salt"]
    rows = left.unionByName(right).repartition(*place).sortWithinPartitions(*place, "role", "text")
    out = _parse_datatype_string(f"token string, {schema}")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ask = None, [], None
        for b in batches:
            got: list[tuple] = []
            for *here, role, text, n in zip(*(c.to_pylist() for c in b.columns)):
                if here != at:
                    at, held, ask = here, [], None
                if not role:
                    held.append((text, n))
                    continue
                if ask is None:
                    ask = prepare(held)
                got += [(text, *x) for x in ask(text, n)]
            cols = list(zip(*got)) if got else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return rows.mapInArrow(run, out)
