"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text bytes handled at once inside a task, whatever the number of rows in an Arrow batch.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` of about ``limit`` bytes in ``column``; a row is never cut."""
    start = size = 0
    values = batch.column(batch.schema.get_field_index(column))
    for i, n in enumerate(pc.binary_length(values).to_pylist()):
        if i > start and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(df: DataFrame, column: str, added: list[tuple[str, str]], make: Callable[[], Callable],
              limit: int = SLICE_BYTES) -> DataFrame:
    """Append columns computed from the texts of ``column``, a slice of rows of about ``limit`` bytes at a time.

    ``make()`` runs once per task and returns a function from a list of texts (None for null)
    to one list of values per added column.  A column that already has an added name is replaced.
    """
    names = [name for name, _ in added]
    kept = [c for c in df.columns if c not in names or c == column]
    source = df.select(*(F.col(f"`{c}`") for c in kept))
    out = [c for c in kept if c not in names]
    schema = T.StructType([f for f in source.schema.fields if f.name in out]
                          + [T.StructField(n, T._parse_datatype_string(t)) for n, t in added])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, call = to_arrow_schema(T.StructType(schema.fields[len(out):])), make()
        for batch in batches:
            for part in slices(batch, column, limit):
                texts = part.column(part.schema.get_field_index(column)).to_pylist()
                values = call(texts)
                columns = [part.column(part.schema.get_field_index(c)) for c in out]
                columns += [pa.array(v, type=arrow.field(n).type) for n, v in zip(names, values, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*out, *names])
                del texts, values, columns
        # The process serves later tasks: what Arrow keeps for reuse goes back first.
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)
