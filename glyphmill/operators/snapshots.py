"""Snapshots: reconciling, status, compare-and-swap, upsert and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(old: DataFrame, new: DataFrame, keys: list[str], text: str, body: str) -> DataFrame:
    """Old and new units side by side; a body survives only where the unit's own text is unchanged.

    change: added, removed, kept or changed. Where a unit sits doesn't matter, as keys don't name files.
    """
    o = old.select(*keys, F.col(text).alias("_old"), F.col(body).alias("_body"), F.lit(True).alias("_in_old"))
    n = new.select(*keys, F.col(text).alias("_new"), F.lit(True).alias("_in_new"))
    same = F.col("_old").eqNullSafe(F.col("_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(same, "kept").otherwise("changed")
    out = o.join(n, keys, "full_outer").withColumn("change", change)
    return out.select(*keys, "change", F.when(F.col("change") == "kept", F.col("_body")).alias(body))


def status(has_body: Column, current: Column, rejected: Column, needed: Column) -> Column:
    """translated over unfinished over outdated over not_needed."""
    return F.when(has_body & current, "translated").when(rejected | (needed & ~has_body), "unfinished").when(has_body, "outdated").otherwise("not_needed")


def current_text(manual: Column, automatic: Column, source: Column) -> Column:
    return F.coalesce(manual, automatic, source)


def detached(side: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Side records whose unit is gone."""
    return side.join(units.select(*keys), keys, "left_anti")


def compare_and_swap(table: DataFrame, pending: DataFrame, keys: list[str], value: str, expected: str, proposed: str) -> DataFrame:
    """The table with pending values applied where the stored one is as expected, null included; `outcome` tells which."""
    out = table.join(pending.select(*keys, expected, proposed, F.lit(True).alias("_p")), keys, "left")
    fits = F.col("_p").isNotNull() & F.col(value).eqNullSafe(F.col(expected))
    outcome = F.when(F.col("_p").isNull(), "untouched").when(fits, "applied").otherwise("conflict")
    return out.withColumn("outcome", outcome).withColumn(value, F.when(fits, F.col(proposed)).otherwise(F.col(value))).drop(expected, proposed, "_p")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows take the place of those with their keys; others are added."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def differences(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): missing from actual or unexpected there."""
    missing = expected.select(*keys).exceptAll(actual.select(*keys)).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.select(*keys).exceptAll(expected.select(*keys)).withColumn("side", F.lit("unexpected")))


def coverage(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected, covered, missing and unexpected keys."""
    both = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(actual.select(*keys).distinct().withColumn("_a", F.lit(1)), keys, "full_outer")
    e, a = F.col("_e").isNotNull(), F.col("_a").isNotNull()
    return both.agg(F.count_if(e).alias("expected"), F.count_if(e & a).alias("covered"), F.count_if(e & ~a).alias("missing"), F.count_if(~e & a).alias("unexpected"))


def schema_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, finding) of objects (name, definition): missing, unexpected or mismatched."""
    j = expected.select("name", F.col("definition").alias("_e")).join(actual.select("name", F.col("definition").alias("_a")), "name", "full_outer")
    kind = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_e") != F.col("_a"), "mismatched")
    return j.select("name", kind.alias("finding")).where("finding is not null")


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """The table with values set where the condition holds, and `changed` on those rows."""
    hit = F.coalesce(where, F.lit(False))
    new = {name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()}
    return table.withColumns({**new, "changed": hit})


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def set_answers(table: DataFrame, answers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A new snapshot with answers set, null clearing one, and `outcome`. All or nothing: an answer to a key that isn't there ends the job."""
    a = answers.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_a"))
    out = table.withColumn("_t", F.lit(True)).join(a, keys, "full_outer")
    name = F.concat(F.lit("no such unit: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    outcome = F.when(F.col("_t").isNull(), F.raise_error(name).cast("string")).when(F.col("_a").isNull(), "kept").when(F.col("_new").isNull(), "cleared").otherwise("set")
    out = out.withColumn("outcome", outcome).withColumn(value, F.when(F.col("_a").isNull(), F.col(value)).otherwise(F.col("_new")))
    return out.drop("_new", "_a", "_t")
