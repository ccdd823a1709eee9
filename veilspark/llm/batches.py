"""Running a function over the texts of a DataFrame, one Arrow batch after another, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows that a function gets at a time; a batch from Spark is cut into such slices.
SLICE = 512


def per_text(df: DataFrame, make: Callable[[], Callable[[list[str | None]], Iterable[Iterable]]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the columns of `schema`, in the order of df's rows.

    make() is called once in each task and gives a function from texts (None where null) to one sequence for each
    column of schema. Columns of df other than key and text are ignored, whatever their names are."""
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = StructType.fromDDL(f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                columns = work(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).cast(kinds[0]), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names=names)

    return src.mapInArrow(run, out)


def kept_rows(df: DataFrame, make: Callable[[], Callable[[list[str | None]], Iterable[bool]]], text: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, for whose text the function says True."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                yield b.filter(pa.array(list(work(b.column(at).to_pylist())), pa.bool_()))

    return df.mapInArrow(run, df.schema)


class Ragged:
    """Byte strings side by side, to be joined by number: joined([3, 1]) is the fourth and then the second."""

    def __init__(self, parts: list[bytes]):
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, which: np.ndarray) -> bytes:
        n = self.length[which]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.start[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
