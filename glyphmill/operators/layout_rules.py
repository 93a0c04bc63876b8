"""Selectors of layout rules: any value within a field, all fields together, less the excluded ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select(units: DataFrame, rules: DataFrame, unit: str, fields: dict[str, str], excluded: str = "exclude_ids") -> DataFrame:
    """(unit, ord, max_width): which rule applies to which unit. rules is a resource and small; Spark picks the join by its size.

    fields: rule column by unit column; a null rule column selects all.
    """
    fits = F.lit(True)
    for rule_column, unit_column in fields.items():
        fits = fits & (F.col(rule_column).isNull() | F.array_contains(F.col(rule_column), F.col(unit_column).cast("string")))
    fits = fits & ~F.coalesce(F.array_contains(F.col(excluded), F.col(unit).cast("string")), F.lit(False))
    return units.join(rules, fits).select(unit, "ord", "max_width")


def problems(units: DataFrame, rules: DataFrame, hits: DataFrame, unit: str) -> DataFrame:
    """(problem, subject): rules without a unit, and units that two rules select."""
    none = rules.join(hits.select("ord").distinct(), "ord", "left_anti").select(F.lit("no_unit").alias("problem"), F.col("ord").cast("string").alias("subject"))
    two = hits.groupBy(unit).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("two_rules").alias("problem"), F.col(unit).cast("string").alias("subject"))
    return none.unionByName(two)
