"""Mutation claims: intents on a path's ancestors, an exclusive claim on its leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def derive(paths: DataFrame, owner: str, steps: str) -> DataFrame:
    """(owner, resource, access) for every prefix of each path (array of steps), joined by /; a step's own ~ and / become ~0 and ~1."""
    out = paths.select(owner, F.col(steps).alias("_s"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.transform(F.slice(F.col(steps), 1, i), lambda s: F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))), "/"))).alias("_i", "resource"))
    return out.select(owner, "resource", F.when(F.col("_i") == F.size("_s") - 1, "exclusive").otherwise("intent").alias("access")).distinct()


def summary(claims: DataFrame, resource: str, owner: str, access: str, order: str) -> DataFrame:
    """Of each resource: claims, exclusive ones, owners, the earliest intent, and what is wrong, if anything.

    A hot resource is aggregated map-side; nothing is paired.
    """
    out = claims.groupBy(resource).agg(
        F.count("*").alias("claims"), F.count_if(F.col(access) == "exclusive").alias("exclusive"), F.count_distinct(owner).alias("owners"),
        F.min(F.when(F.col(access) == "intent", F.col(order))).alias("first_intent"),
    )
    wrong = F.when((F.col("exclusive") > 1), "several_exclusive").when((F.col("exclusive") == 1) & (F.col("claims") > 1), "mixed_access").otherwise("none")
    return out.withColumn("error", wrong)


def conflicts(claims: DataFrame, resource: str, owner: str, access: str) -> DataFrame:
    """(resource, a, b): owners a < b of whom at least one claims the resource exclusively.

    Claims are first folded to one row for a resource, owner and access, so the pairs are bounded by the owners.
    """
    c = claims.groupBy(resource, owner).agg(F.bool_or(F.col(access) == "exclusive").alias("x"))
    a, b = c.select(resource, F.col(owner).alias("a"), F.col("x").alias("xa")), c.select(resource, F.col(owner).alias("b"), F.col("x").alias("xb"))
    return a.join(b, resource).where("a < b and (xa or xb)").select(resource, "a", "b")


def ordered(claims: DataFrame, resource: str, access: str, location: str) -> DataFrame:
    """claims in the order of resource, access and location, one sort by ranges."""
    return claims.orderBy(resource, access, location)
