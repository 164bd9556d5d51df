"""Shared plumbing of the training-data operators: staged tables, Arrow maps, word normalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.runtime import discard, ship, staged, staging_path

__all__ = ["arrow_map", "arrow_schema", "discard", "free_name", "map_batches", "row_numbers", "salted_join", "small_batches", "staged", "staging_path", "table"]

BATCH_ROWS = 1000


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``rows``, so that Python memory stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand. The session's batches shrink from Spark's default to ``BATCH_ROWS``.

    Texts are large: 10,000 rows a batch would hold too much beside the heap. Spark reads the setting when the
    plan runs, so it stays set; a value of the caller's own is left alone.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def pooled(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
        yield from run(batches)

    return df.mapInArrow(pooled, schema)


def arrow_map(
    df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str, slice_rows: int = 512
) -> DataFrame:
    """``map_batches`` over column dicts, fed in slices of ``slice_rows``."""
    out = arrow_schema(schema)

    def run(batches):
        slices = ({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)} for part in small_batches(batches, slice_rows))
        for got in rows(slices):
            if len(next(iter(got.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return map_batches(df, run, schema)


def salted_join(many: DataFrame, few: DataFrame, on: str | list[str], by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join on ``on``; rows of one key on the side of ``many`` are dealt to ``salts`` tasks by a hash of ``by``."""
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*([on] if isinstance(on, str) else on), "__salt"], how).drop("__salt")


def row_numbers() -> Iterator[int]:
    """Numbers that no other row of the same stage gets; fixed once the rows are written."""
    return count(TaskContext.get().partitionId() << 33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
