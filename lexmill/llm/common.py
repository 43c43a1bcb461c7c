"""What the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows, and characters of text, of a batch that is handed on.
ROWS, CHARS = 4096, 16_000_000


def map_rows(df: DataFrame, fn: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` over all rows of a partition, as tuples in column order; what it builds
    is built once for a partition, and rows are read and handed on in batches."""
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in fn(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
            held.append(row)
            for x in row:
                if type(x) is str:
                    size += len(x)
            if len(held) >= ROWS or size > CHARS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return df.mapInArrow(run, out)


def shingle_free(col: str):
    """A text column with content: not null, not empty."""
    return F.col(col).isNotNull() & (F.length(col) > 0)
