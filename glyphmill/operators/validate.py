"""Hard invariants of candidates, and binding of answers to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T


def violation(source: Column, target: Column, fixed: bool = True) -> Column:
    """The first broken invariant of a candidate's lines, null if it holds: line count, line characters, blank slots, blank body."""
    bad = F.exists(target, lambda t: t.isNull() | t.rlike("[\r\n\\x00]"))
    bom = F.exists(target, lambda t: t.contains("﻿"))
    slots = F.exists(F.zip_with(source, target, lambda s, t: T.is_blank(s) != T.is_blank(t)), lambda x: x)
    blank = F.forall(target, T.is_blank)
    out = F.when(F.lit(fixed) & (F.size(source) != F.size(target)), "line_count").when(bad, "line_character").when(bom, "byte_order_mark")
    return out.when(F.lit(fixed) & slots, "blank_slot").when(blank, "blank_body")


def bind(expected: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """(key, n, outcome): every expected or answered id with what becomes of it.

    Ids out of canonical form are invalid, ids nobody asked for unexpected; of an id answered twice all
    copies are ignored; an id without an answer is missing.
    """
    counts = answers.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key).distinct().withColumn("_e", F.lit(True)).join(counts, key, "full_outer")
    outcome = (
        F.when(F.col("n").isNull(), "missing_id").when(~T.is_canonical_id(F.col(key)), "invalid_id").when(F.col("_e").isNull(), "unexpected_id").when(F.col("n") > 1, "duplicate_id").otherwise("bound")
    )
    return both.select(key, F.coalesce("n", F.lit(0)).alias("n"), outcome.alias("outcome"))


def accept(expected: DataFrame, answers: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """Destinations (key, source lines) with the answer bound to them and whether it is accepted, rejected or pending."""
    bound = bind(expected, answers, key).where("outcome = 'bound'").select(key)
    out = expected.join(answers.join(bound, key, "left_semi").select(key, target), key, "left")
    broken = violation(F.col(source), F.col(target))
    state = F.when(F.col(target).isNull(), "pending").when(broken.isNull(), "accepted").otherwise("rejected")
    return out.withColumn("violation", F.when(F.col(target).isNotNull(), broken)).withColumn("state", state)
