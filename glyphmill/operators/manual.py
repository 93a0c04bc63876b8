"""Manual answers, listings, exports and the write-back plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions.layout import repaired_punctuation, wrap_to
from glyphmill.operators import validate


def select(units: DataFrame, which: str, status: str = "status", ids: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Units for manual work: pending, rejected, all, or the ids of a table."""
    if ids is not None:
        return units.join(ids.select(key), key, "left_semi")
    return units if which == "all" else units.where(F.col(status) == which)


def listing(units: DataFrame, statuses: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    out = units if not statuses else units.where(F.col("status").isin(statuses))
    return out if ids is None else out.where(F.col("id").isin(ids))


def context(units: DataFrame, ids: list[str], key: str = "id", group: str = "group_id") -> DataFrame:
    """All units of the groups of the asked ids, in the order they were asked for."""
    asked = units.sparkSession.createDataFrame(list(enumerate(ids)), f"asked int, {key} string")
    groups = asked.join(units.select(key, group), key).select("asked", group)
    return units.join(groups, group)


def check(answers: DataFrame, units: DataFrame, key: str = "id") -> DataFrame:
    """(id, problem) of answers (id, type, source, translation) against units (id, type, lines)."""
    doubled = answers.groupBy(key).agg(F.count("*").alias("_n"))
    j = answers.join(doubled, key).join(units.select(key, F.col("type").alias("_type"), F.col("lines").alias("_lines")), key, "left")
    broken = validate.violation(F.col("source"), F.col("translation"))
    kind = F.when(F.col("_n") > 1, "duplicate_id").when(F.col("_lines").isNull(), "unknown_id").when(F.col("_type") != F.col("type"), "other_type").when(F.col("_lines") != F.col("source"), "source_changed").otherwise(broken)
    return j.select(key, kind.alias("problem")).where("problem is not null").distinct()


def export_rows(units: DataFrame) -> DataFrame:
    """One JSON line a unit; absent values are left out."""
    return units.select(F.to_json(F.struct(*units.columns)).alias("value"))


def manual_toml(units: DataFrame, path: str) -> None:
    """Entries of units (id, type, source, translation) as TOML, one table a unit. JSON strings are TOML strings."""
    text = lambda c: F.to_json(F.array(c))
    one = lambda c: F.regexp_extract(text(c), r"(?s)^\[(.*)\]$", 1)
    body = F.concat(F.lit("[[translation]]\nid = "), one(F.col("id")), F.lit("\ntype = "), one(F.col("type")), F.lit("\nsource = "), F.to_json("source"), F.lit("\ntranslation = "), F.to_json(F.coalesce("translation", F.array().cast("array<string>"))), F.lit("\n"))
    units.sort("id").select(body.alias("value")).write.mode("overwrite").text(path)


def write_back(units: DataFrame, source: str, body: str, most_width: int | None = None, repair: bool = True, manual: str | None = None) -> DataFrame:
    """Each unit's text to write, and how it came about: retained without a valid body, else written, repaired or wrapped."""
    s, b = F.col(source), F.col(body)
    broken = validate.violation(T.lines(s), T.lines(b))
    use = b.isNotNull() & broken.isNull()
    text = F.when(use, b)
    if repair:
        by_hand = F.col(manual) if manual else F.lit(False)
        text = F.when(use & ~by_hand, repaired_punctuation(s, b)).otherwise(text)
    if most_width:
        text = wrap_to(most_width)(text)
    out = units.withColumn("_written", text)
    how = F.when(F.col("_written").isNull(), "retained").when(F.col("_written") == b, "written").otherwise("adjusted")
    return out.withColumn("outcome", how).withColumn("final", F.coalesce("_written", s)).drop("_written")
