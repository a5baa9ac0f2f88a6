"""Places and running sums inside groups of any size.

A window over a group brings the group to one task; here rows are sorted into ranges first, so that a group that holds
a third of all rows, or is all of them, is spread over many tasks. Counts and sums of each group's ranges (a row for each) give
every range its start; inside a range a window does the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import cut


def numbered(rows: DataFrame, keys: list[str], order: list[Column], place: str = "place", value: str | None = None, total: str = "total") -> DataFrame:
    """rows with their place from 1 inside the group of ``keys`` (none: all rows; nulls are a group), by ``order``, and where asked for the running sum of ``value``.

    ``order`` must tell rows apart, else the places of equal ones are any.
    """
    columns = rows.columns
    dealt = cut(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    sums = [F.count("*").alias("_n")] + ([F.sum(value).alias("_s")] if value else [])
    each = dealt.groupBy(*keys, "_part").agg(*sums)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ("_n", "_s")[: len(sums)]])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_of"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    out = dealt.join(starts, same).withColumn(place, F.col("_before_n") + F.row_number().over(inside))
    if value:
        out = out.withColumn(total, F.col("_before_s") + F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*columns, place, *[total] * bool(value))
