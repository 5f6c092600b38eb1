"""Row functions over Arrow batches: the one place where Python workers are entered."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def flat_map(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | StructType, chunk: int = 4096) -> DataFrame:
    """Map all rows of a partition, as tuples in column order, to tuples of ``schema``.

    ``fn`` gets an iterator over the whole partition and may aggregate before it
    yields; output is packed into Arrow batches of ``chunk`` rows.
    """
    out: StructType = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        buf: list[tuple] = []
        for row in fn(rows()):
            buf.append(row)
            if len(buf) >= chunk:
                yield pack(buf)
                buf = []
        if buf:
            yield pack(buf)

    def pack(buf: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buf), arrow)], schema=arrow)

    return df.mapInArrow(run, out)
