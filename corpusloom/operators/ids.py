"""Dense ids over a total order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import unused
from ..sources.shared import written


def with_dense_id(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with a column of ids 0, 1, ... in the given total order.

    Rows are range-partitioned; each partition numbers its own and only the partitions' sizes are added up in one place. The
    numbered rows are written once: range bounds come from a sample, so two computations could cut differently.
    """
    part, rank, start = (unused(df, f"__{name}_{x}") for x in ("part", "rank", "from"))
    ranged = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    numbered = written(ranged.withColumn(rank, F.row_number().over(W.partitionBy(part).orderBy(*order))), "dense-ids")
    sizes = numbered.groupBy(part).agg(F.max(rank).alias("n"))
    before = F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(part, F.coalesce(before, F.lit(0)).alias(start))
    return numbered.join(offsets, part).withColumn(name, F.col(rank) - 1 + F.col(start)).drop(part, rank, start)
