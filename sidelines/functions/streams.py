"""Rules in which each row depends on what was made of the row before, as one sorted pass over each key's rows."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def sorted_fold(rows: DataFrame, by: list[str], order: list[str], used: list[str], added: list[T.StructField], begin: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """rows with the columns `added`: begin() gives a key's step, a small function with its own state, which is called with the
    columns `used` of the key's rows one after another and returns the added values.

    Keys are spread over tasks and each one's rows pass as a stream in order, so a task holds a step's state and a batch of
    rows, however many rows a key has. Rows of equal order pass in any order."""
    fields = [*rows.schema.fields, *added]
    keys, values = [rows.columns.index(c) for c in by], [rows.columns.index(c) for c in used]
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            out: list[list] = [[] for _ in added]
            for key, row in zip(zip(*(batch.column(i).to_pylist() for i in keys), strict=True), zip(*(batch.column(i).to_pylist() for i in values), strict=True), strict=True):
                if step is None or key != at:
                    at, step = key, begin()
                for column, value in zip(out, step(*row), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))], [f.name for f in fields])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, T.StructType(fields))
