"""Few rows are handled where the driver is: a statement on a handful of rows needs no job. The bounds are checked, and results are the
same beyond them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes (as Catalyst estimates them, or as a manifest states them) and rows up to which the driver handles rows itself. 0: never.
LOCAL = {"bytes": 1 << 20, "rows": 8192}


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def source_bytes(df: DataFrame) -> int:
    """Of what df reads; for a join Catalyst's estimate multiplies these."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def local_rows(df: DataFrame) -> pa.Table | None:
    """All rows, if they are few; at most one more than the bound is fetched to know."""
    if (held := getattr(df, "_held", None)) is not None:
        return held
    if df.isStreaming or estimated_bytes(df) > LOCAL["bytes"]:
        return None
    here = df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation"  # whose size is known
    rows = (df if here else df.limit(LOCAL["rows"] + 1)).toArrow()
    return rows if len(rows) <= LOCAL["rows"] else None


def from_arrow(spark: SparkSession, batches: list[pa.RecordBatch], schema: T.StructType) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    arrow = to_arrow_schema(schema)
    there = [b for b in batches if len(b)]
    rows = pa.Table.from_batches(there).cast(arrow) if there else arrow.empty_table()
    made = spark.createDataFrame(rows, schema)
    if rows.nbytes <= LOCAL["bytes"] and len(rows) <= LOCAL["rows"]:
        made._held = rows  # as they are at hand
    return made
