"""Greedy packing of whole groups into bounded blocks, and task ids within blocks.

Packing is a fold in order, so a scope's sizes are gathered in one row; a scope is one file, and its
row holds two numbers for each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SHELL = len('{"groups":[') + len("]}")


def pack_blocks(groups: DataFrame, scope: str, order: str, size: str, target: int, shell: int = SHELL) -> DataFrame:
    """(scope, order, block_id): a group joins the block while it fits; one that is too large stands alone."""
    items = groups.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("items"))
    fold = f"""aggregate(items, named_struct('block', cast(-1 as bigint), 'used', cast({target} + 1 as bigint), 'out', cast(array() as array<struct<o:bigint,block:bigint>>)),
        (a, x) -> if(a.used <= {target} and a.used + 1 + x.s <= {target},
            named_struct('block', a.block, 'used', a.used + 1 + x.s, 'out', concat(a.out, array(named_struct('o', cast(x.o as bigint), 'block', a.block)))),
            named_struct('block', a.block + 1, 'used', {shell} + x.s, 'out', concat(a.out, array(named_struct('o', cast(x.o as bigint), 'block', a.block + 1))))),
        a -> a.out)"""
    return items.select(scope, F.inline(F.expr(fold))).withColumnsRenamed({"o": order, "block": "block_id"})


def assign_task_ids(units: DataFrame, block: list[str], order: str, is_task: str) -> DataFrame:
    """task_id: consecutive from 0 among a block's tasks, null for other units; blocks without a task are left out. A block is bounded."""
    w = Window.partitionBy(*block)
    ordered = w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flag = F.col(is_task).cast("int")
    out = units.withColumn("_any", F.max(flag).over(w)).withColumn("task_id", F.when(F.col(is_task), F.sum(flag).over(ordered) - 1)).where("_any = 1")
    return out.drop("_any")


def block_terms(hits: DataFrame, block: list[str], terms: str) -> DataFrame:
    """The union of a block's term numbers (array column), in file order."""
    return hits.groupBy(*block).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(terms)))).alias("terms"))
