"""Exact global ranks without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: A row's place in its partition takes the lower bits of the id that Spark numbers rows with.
_PLACE_BITS = 33


def global_rank(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based number of each row in the order of ``keys`` (ascending, best without ties).

    Spark deals the rows to ranges of the keys, as many as the shuffle has partitions, and each is sorted by itself;
    a row's number is its place after the rows of the ranges before. The numbered rows are cut, as ranges are sampled.
    """
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank__id", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftrightunsigned("rank__id", _PLACE_BITS).alias("rank__range")).agg(F.count("*").alias("rank__n"))
    before = sizes.select("rank__range", (F.sum("rank__n").over(Window.partitionBy(F.lit(0)).orderBy("rank__range")) - F.col("rank__n")).alias("rank__before"))  # a row for each range
    numbered = placed.withColumn("rank__range", F.shiftrightunsigned("rank__id", _PLACE_BITS)).join(F.broadcast(before), "rank__range")
    place = F.col("rank__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return numbered.withColumn(name, (F.col("rank__before") + place + 1).cast("bigint")).drop("rank__range", "rank__before", "rank__id")
