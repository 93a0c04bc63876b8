"""Quality findings of stored translations, one row each, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from glyphmill.functions import text as T


def findings(pairs: DataFrame, key: str, source: str, target: str, grams: int = 4, most_width: int | None = None) -> DataFrame:
    """(key, kind): every finding of a pair of texts. One pass: a row's findings are an array that is exploded."""
    s, t = F.col(source), F.col(target)
    kinds = {
        "missing": t.isNull(),
        "blank": t.isNotNull() & T.is_blank(t),
        "lines": F.size(T.lines(s)) != F.size(T.lines(t)),
        "copied": T.copied_fragment(s, t, grams).isNotNull(),
        "control_shapes": F.array_sort(T.control_shapes(s)) != F.array_sort(T.control_shapes(t)),
        "explanation": T.is_explanation(t) & ~T.is_explanation(s),
    }
    if most_width:
        kinds["width"] = F.exists(T.lines(t), lambda x: T.display_width(x) > most_width)
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())), lambda k: k.isNotNull())
    return pairs.select(key, F.explode(found).alias("kind"))


def grouped(found: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """(kind, n, ids, examples): the first examples come from a ranking, so no kind's ids are gathered whole."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(key))
    first = found.select("kind", key).distinct().withColumn("r", rank).where(F.col("r") <= examples)
    first = first.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("examples"))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids")).join(first, "kind")


def unextracted(survey: DataFrame, units: DataFrame, text: str) -> DataFrame:
    """Surveyed texts that look like player text and aren't among the units."""
    return survey.where(T.player_text(F.col(text))).join(units.select(text).distinct(), text, "left_anti")


def written_back(expected: DataFrame, actual: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, problem): where what was read back isn't what was to be written."""
    j = expected.select(*keys, F.col(text).alias("_e")).join(actual.select(*keys, F.col(text).alias("_a")), keys, "full_outer")
    stable = T.letters_and_digits(F.col("_e")) != T.letters_and_digits(F.col("_a"))
    kind = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(stable, "text").when(F.col("_e") != F.col("_a"), "form")
    return j.select(*keys, kind.alias("problem")).where("problem is not null")


def ownership(decisions: DataFrame, exported: DataFrame, key: str) -> DataFrame:
    """(key, problem): survey decisions against exported owners."""
    j = decisions.select(key, F.col("owner").alias("_d")).join(exported.select(key, F.col("owner").alias("_o")), key, "full_outer")
    kind = F.when(F.col("_o").isNull(), "not_exported").when(F.col("_d").isNull(), "undecided").when(F.col("_d") != F.col("_o"), "other_owner")
    return j.select(key, kind.alias("problem")).where("problem is not null")


def placeholder_candidates(units: DataFrame, text: str) -> DataFrame:
    """(pattern, n, units): shapes of control sequences with their letters kept and numbers generalised."""
    shapes = units.select(F.monotonically_increasing_id().alias("_u"), F.explode(T.control_shapes(F.col(text))).alias("_s"))
    return shapes.select("_u", F.regexp_replace("_s", "[0-9]+", "N").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"), F.count_distinct("_u").alias("units"))
