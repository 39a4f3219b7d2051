"""Places in a whole order, counted over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterfold.llm.common import pin

#: Low bits of ``monotonically_increasing_id``: the row's number in its partition.
_WITHIN = (1 << 33) - 1


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add each row's place, from 1, in ``order``, which must tell all rows apart.

    Rows are dealt by ranges and written with their range and place in it, so that a
    repeated task finds the same ranges; only the sizes of the ranges (one row for each
    partition) are summed in one place.
    """
    dealt = pin(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN)).alias("__at"))
    )
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    return dealt.join(starts, "__range").select(*df.columns, (F.col("__before") + F.col("__at") + 1).alias(name))
