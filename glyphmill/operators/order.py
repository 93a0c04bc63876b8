"""Natural order as data: dense ordinals without bringing a scope into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Order keys of this many consecutive values are numbered together.
SPAN = 1 << 16


def dense_ordinals(df: DataFrame, scope: list[str], key: str, name: str, span: int = SPAN) -> DataFrame:
    """`name`: the row's place in its scope, from 0, by the whole number `key`, which is unique in the scope.

    Rows are numbered within stretches of the key; the stretches' sizes, a small table, are summed up
    in order and added. No scope, however large, is sorted by one task.
    """
    parts = df.withColumn("_stretch", F.floor(F.col(key) / span))
    sizes = parts.groupBy(*scope, "_stretch").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_first", F.sum("_n").over(Window.partitionBy(*scope).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)))
    sizes = sizes.select(*scope, "_stretch", F.coalesce("_first", F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(*scope, "_stretch").orderBy(key)) - 1
    return parts.withColumn("_own", own).join(sizes, [*scope, "_stretch"]).withColumn(name, F.col("_own") + F.col("_first")).drop("_stretch", "_own", "_first")


def semantic_key(*parts: Column) -> Column:
    """A sortable key: arrays of whole numbers compare element by element."""
    return F.array(*(p.cast("long") for p in parts))


def running_end_overlap(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Spans that begin before an earlier span of their group has ended."""
    w = Window.partitionBy(*group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_end", F.max(end).over(w)).where(F.col("_end") > F.col(start)).drop("_end")
