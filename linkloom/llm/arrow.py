"""Running a function over Arrow batches of a frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from linkloom.session import spread

__all__ = ["ROWS", "map_rows", "spread", "table"]

ROWS = 256


def map_rows(df: DataFrame, run: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = ROWS) -> DataFrame:
    """``run`` gets up to ``rows`` rows as lists by column, and gives lists or Arrow arrays by column of ``schema``."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = run(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([v if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(go, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
