"""Families of equal units: representatives, reuse and propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def families(units: DataFrame, key: Column | str, order: str) -> DataFrame:
    """(family, representative, members, targets): targets are the members that take the representative's answer."""
    return units.groupBy(F.col(key).alias("family") if isinstance(key, str) else key.alias("family")).agg(
        F.min(order).alias("representative"), F.count("*").alias("members"), (F.count("*") - 1).alias("targets")
    )


def outcomes(units: DataFrame, family: str, order: str, body: str) -> DataFrame:
    """What becomes of each family. body: a unit's current answer or null.

    No current answer: request one for the earliest unit. One distinct answer: reuse it for the
    others. More than one: keep all, and request for the earliest unit without. A unit that has an
    answer is never given another.
    """
    open_ = F.col(body).isNull()
    out = units.groupBy(family).agg(
        F.count("*").alias("members"),
        F.count_if(open_).alias("unresolved"),
        F.count_distinct(body).alias("answers"),
        F.min(F.when(open_, F.col(order))).alias("first_unresolved"),
        F.min(F.when(~open_, F.col(order))).alias("seed"),
    )
    kind = F.when(F.col("unresolved") == 0, "complete").when(F.col("answers") == 1, "reuse").otherwise("request")
    return out.withColumn("outcome", kind)


def propagate(units: DataFrame, family: str, order: str, body: str) -> DataFrame:
    """Every unit with the answer it has or, in a family with just one, is to reuse.

    The families' answers are aggregated first and joined back, so a large family isn't collected.
    """
    seeds = units.where(F.col(body).isNotNull()).groupBy(family).agg(F.min_by(body, order).alias("seed_body"), F.count_distinct(body).alias("answers")).where("answers = 1")
    out = units.join(seeds.select(family, "seed_body"), family, "left")
    return out.withColumn("reused", F.col(body).isNull() & F.col("seed_body").isNotNull()).withColumn("answer", F.coalesce(body, "seed_body")).drop("seed_body")


def role_key(role: Column, text: Column, context: Column, location: Column, field: Column) -> Column:
    """The family key by role: speakers by text, bodies with context, choices with location, other values with field."""
    return F.when(role == "speaker", F.struct(role, text, F.lit("").alias("extra"))).when(role == "body", F.struct(role, text, context.alias("extra"))).when(
        role == "choices", F.struct(role, text, location.alias("extra"))
    ).otherwise(F.struct(role, text, field.alias("extra")))
