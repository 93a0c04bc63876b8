"""Units made ready for requests: applicable placeholder rules, protected text, need, term hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import hashing, placeholder
from glyphmill.functions import text as T
from glyphmill.functions.languages import language
from glyphmill.operators import terms as terms_of


def applicable_rules(units: DataFrame, rules: list[dict], key: list[str], id: str, scope: str) -> DataFrame:
    """(key, ord): the placeholder rules of each unit. A rule without scopes or ids takes all; a unit must fit both.

    rules is a resource as sources.resources reads it, so it is a literal of the plan, and units aren't shuffled.
    """
    fits = lambda names, column: F.lit(True) if names is None else F.coalesce(F.col(column).cast("string").isin(list(names)), F.lit(False))
    own = [F.when(fits(r.get("scopes"), scope) & fits(r.get("ids"), id), F.lit(i)) for i, r in enumerate(rules)]
    numbers = F.array_compact(F.array(*own)) if own else F.array().cast("array<int>")
    return units.select(*key, F.explode(numbers).alias("ord"))


def prepare(units: DataFrame, text: str, lang: str, pattern: str, entries: list[str]) -> DataFrame:
    """units with protected, originals, binding, needed, hits and state: blank, retained (nothing of the language outside of spans), reserved (the text holds a token's envelope) or request."""
    t = F.col(text)
    out = units.withColumn("protected", placeholder.protect(t, pattern)).withColumn("originals", placeholder.spans(t, pattern))
    bindings = F.transform("originals", lambda o, i: F.struct(placeholder.token(i).alias("token"), o.alias("original"), F.lit("rule").alias("label"), F.lit("text").alias("scope"), F.lit("preserve").alias("order"), F.lit(None).cast("string").alias("wrapper")))
    natural = placeholder.natural_text(F.col("protected"))
    out = out.withColumn("binding", hashing.bindings_sha256(bindings)).withColumn("_natural", natural)
    out = out.withColumn("needed", language(lang).needs(F.col("_natural"))).withColumn("hits", F.array_distinct(terms_of.selected(F.col("_natural"), entries)))
    state = F.when(placeholder.has_reserved(t), "reserved").when(T.is_blank(t), "blank").when(~F.col("needed"), "retained").otherwise("request")
    return out.withColumn("state", state).drop("_natural")
