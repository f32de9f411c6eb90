"""Row numbers per key without gathering a key in one task.

Rows are sorted by key and order into ranges that cut through hot keys. Each task counts
within its part of a key; of the parts, only the first key of a range can go on from the
range before, so a table of one row per range carries the counts over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.operators.heavy import materialise
from rankfold.session import ship_package


def _count(key: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = pc.dictionary_encode(b.column(key), null_encoding="encode")
            at = codes.indices.to_numpy()
            start = np.flatnonzero(np.diff(at, prepend=-1))
            n = np.arange(b.num_rows) - np.repeat(start, np.diff(start, append=b.num_rows)) + 1
            first = (codes.dictionary[at[0]].as_py(),)
            if first == last:
                n[:start[1] if len(start) > 1 else len(n)] += seen
            last, seen = (codes.dictionary[at[-1]].as_py(),), int(n[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=names)
    return run


def numbered(rows: DataFrame, key: str, order: list[Column], name: str = "rn", parts: int | None = None) -> DataFrame:
    """``rows`` with ``name`` long: 1, 2, ... per ``key`` (null is a key too) in ``order``,
    which should be total. The sorted rows are written to the shared folder once."""
    spark = rows.sparkSession
    ship_package(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id())
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema]
    counted = materialise(dealt.mapInArrow(_count(dealt.columns.index(key), [*dealt.columns, name]),
                                           ", ".join([*fields, f"`{name}` bigint"])), "numbered")
    # one row a range: its first key, its last key and how many rows of that it has
    edges = counted.groupBy("_range").agg(F.min(F.struct(key)).alias("first"), F.max(F.struct(key, name)).alias("last")) \
        .select("_range", F.col(f"first.{key}").alias("first"), F.col(f"last.{key}").alias("last"),
                F.col(f"last.{name}").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("last").orderBy("_range"))
    before = Window.orderBy("_range")
    carried = edges.withColumn("sum", so_far).select(
        "_range", "first", F.lag(F.struct("last", "sum")).over(before).alias("p")) \
        .where(F.col("p").isNotNull() & F.col("p.last").eqNullSafe(F.col("first"))) \
        .select(F.col("_range").alias("_r"), F.col("first").alias("_first"), F.col("p.sum").alias("_more"))
    return counted.join(F.broadcast(carried), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_first")), "left") \
        .withColumn(name, F.col(name) + F.coalesce("_more", F.lit(0))).select(*rows.columns, name)
