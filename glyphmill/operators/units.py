"""Groups, units and their constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators.order import dense_ordinals


def natural_id(path: Column, line: Column, unit: Column) -> Column:
    """path:lineN:unitM, both numbers from 1."""
    return F.concat_ws(":", path, F.concat(F.lit("line"), (line + 1).cast("string")), F.concat(F.lit("unit"), (unit + 1).cast("string")))


def units_of(docs: DataFrame, scope: str, group: str, text: str) -> DataFrame:
    """A row for each line of each text, with ordinals in natural order. Null texts have no units."""
    rows = dense_ordinals(docs.select(F.col(scope).alias("scope_id"), F.col(group).alias("group_id"), F.col(text).alias("text")), ["scope_id"], "group_id", "group_ord")
    rows = rows.select("scope_id", "group_id", "group_ord", F.posexplode(T.lines(F.col("text"))).alias("unit_ord", "text"))
    return rows.select("scope_id", "group_id", "group_ord", "unit_ord", natural_id(F.col("scope_id"), F.col("group_ord"), F.col("unit_ord")).alias("natural_id"), "text")


def problems(units: DataFrame, group: list[str], unit: str, text: str) -> DataFrame:
    """(problem, n): broken constraints of units: ids that repeat in a group, empty ids, CR or NUL, null texts."""
    doubled = units.groupBy(*group, unit).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_unit").alias("problem"), "n")
    checks = {
        "empty_id": F.col(unit).isNull() | (F.col(unit).cast("string") == ""),
        "control_character": F.col(text).rlike("[\r\\x00]"),
        "null_text": F.col(text).isNull(),
    }
    counts = units.agg(*(F.count_if(c).alias(k) for k, c in checks.items()))
    return counts.unpivot([], list(checks), "problem", "n").unionByName(doubled)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def valid_group(units: Column) -> Column:
    """The predicate of a group's units (array of id, text): some, with ids that differ and clean texts."""
    return (F.size(units) > 0) & (F.size(F.array_distinct(F.transform(units, lambda u: u.id))) == F.size(units)) & ~F.exists(units, lambda u: u.text.rlike("[\r\\x00]") | (u.id == ""))
