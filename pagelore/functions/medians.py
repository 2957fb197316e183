"""Exact medians of groups of any size, selected from range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.functions.stored import stored


def with_medians(report: DataFrame, rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """report, a row for each group of keys, with a column for each value: struct(lower, upper), the middle elements.

    Of an odd number of values both are the middle one. Nulls are left out; a group of nulls has null.

    Equal values are counted in the map tasks. All values of all groups are then dealt over partitions by range and
    stored; the counts of a group's partitions, summed up, tell in which of them its middle lies, and only that one
    partition's share of the group is put in order. So a group's values never meet in one task.
    """
    told = rows.select(*keys, *(v.alias(name) for name, v in values.items()))
    whole = all(isinstance(told.schema[name].dataType, T.IntegralType) for name in values)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_m"), F.col(name).cast("bigint" if whole else "double").alias("_v")) for i, name in enumerate(values))))
    counts = told.select(*keys, each.alias("_x")).select(*keys, "_x.*").where("_v is not null").groupBy(*keys, "_m", "_v").agg(F.count("*").alias("_c"))
    dealt = stored(counts.repartitionByRange("_m", *keys, "_v").withColumn("_part", F.spark_partition_id()), "values")
    group = Window.partitionBy(*keys, "_m").orderBy("_part")  # a row for each partition
    sums = dealt.groupBy(*keys, "_m", "_part").agg(F.sum("_c").alias("_s"))
    placed = sums.select(*keys, "_m", "_part", (F.sum("_s").over(group) - F.col("_s")).alias("_before"), "_s", F.sum("_s").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    holds = "_before + _s > (_n - 1) div 2 and _before <= _n div 2"
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*keys, "_m", "_part"]]
    near = dealt.alias("d").join(placed.where(holds).alias("p"), same).select("d.*", "p._before", "p._n")
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_m", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda i, place: F.max(F.when((F.col("_m") == i) & (F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place), F.col("_v")))
    pair = lambda i, kind: F.struct(at(i, F.expr("(_n - 1) div 2")).cast(kind).alias("lower"), at(i, F.expr("_n div 2")).cast(kind).alias("upper"))
    found = near.withColumn("_upto", upto).groupBy(*keys).agg(*(pair(i, told.schema[name].dataType).alias(name) for i, name in enumerate(values)))
    again = [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    return report.alias("r").join(found.alias("m"), again, "left").select("r.*", *(f"m.{name}" for name in values))


def middle(median: str) -> Column:
    """The median that averages the middle pair."""
    return (F.col(f"{median}.lower") + F.col(f"{median}.upper")) / 2
