"""Python steps over rows with nested values, such as polygons."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def mapped(df: DataFrame, f: Callable[[dict], Iterable[dict]], schema: str, at_once: int = 64) -> DataFrame:
    """The rows that f gives for each row; structs are dicts, arrays lists, maps lists of pairs. A task holds `at_once` rows as Python values."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                yield pa.RecordBatch.from_pylist([row for x in batch.slice(start, at_once).to_pylist() for row in f(x)], schema=arrow)

    return df.mapInArrow(run, schema)
