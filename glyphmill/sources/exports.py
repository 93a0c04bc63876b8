"""Export lines: translations with their state, and ownership. Reading is strict; every line that breaks a rule has the rule's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["manual_id", "source", "translation", "state", "origin", "type", "owner", "rule_number", "rejected_candidate_json"]
NEEDED = ["manual_id", "source", "translation", "state", "origin", "type"]
ROW = "struct<manual_id:string,source:array<string>,translation:array<string>,state:string,origin:string,type:string,owner:string,rule_number:long,rejected_candidate_json:string>"


def line_error(value: Column, tree: Column, row: Column, keys: Column) -> Column:
    """The first rule that an export line breaks; null if it breaks none. tree, row and keys are what the line was parsed to, once."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(tree, f"$.{path}", "variant"))
    texts = lambda path: kind(path).isin("ARRAY<STRING>", "ARRAY<VOID>")
    in_ = lambda c, *names: F.coalesce(c.isin(*names), F.lit(False))
    current, rejected = row.state == "current", row.state == "rejected"
    none = ~F.array_contains(keys, "rejected_candidate_json")
    state = (
        F.when(current & ~texts("translation"), "current_without_translation")
        .when(~current & row.translation.isNotNull(), "translation_of_unfinished")
        .when(F.when(row.state == "pending", row.origin != "none").otherwise(row.origin == "none"), "wrong_origin")
        .when(rejected & F.coalesce(row.rejected_candidate_json == "", F.lit(True)), "rejected_without_candidate")
        .when(~rejected & ~none, "unexpected_candidate")
    )
    owner = F.when(row.owner.isNotNull() & ~in_(row.owner, "builtin", "rules"), "wrong_owner").when(
        F.when(F.coalesce(row.owner, F.lit("")) == "rules", F.coalesce(row.rule_number <= 0, F.lit(True))).otherwise(row.rule_number.isNotNull()), "wrong_rule_number"
    )
    return F.coalesce(
        F.when(F.trim(value) == "", "blank_line")
        .when(tree.isNull() | keys.isNull(), "malformed_json")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0, "unknown_key")
        .when(F.size(F.array_except(F.array(*map(F.lit, NEEDED)), keys)) > 0, "missing_key")
        .when((kind("manual_id") != "STRING") | (row.manual_id == "") | row.manual_id.isNull(), "wrong_id")
        .when(~texts("source"), "wrong_source")
        .when(~in_(row.state, "current", "pending", "rejected") | ~in_(row.type, "fixed", "free"), "wrong_state")
        .when(~in_(row.origin, "none", "automatic", "manual"), "wrong_origin"),
        owner,
        state,
    )


def checked(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with `error` and, where there is none, the row; a line whose id is on another line too is repeated_id."""
    out = lines.withColumns({"_tree": F.try_parse_json(value), "row": F.from_json(value, ROW), "_keys": F.json_object_keys(value)})
    out = out.withColumn("error", line_error(F.col(value), F.col("_tree"), F.col("row"), F.col("_keys"))).drop("_tree", "_keys")
    # A line with an error has no row, so its id doesn't count.
    twice = out.where("error is null").groupBy(F.col("row.manual_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1")
    out = out.join(twice, F.col("row.manual_id") == F.col("_id"), "left")
    return out.withColumn("error", F.coalesce("error", F.when(F.col("_n").isNotNull(), "repeated_id"))).withColumn("row", F.when(F.col("error").isNull(), F.col("row"))).drop("_id", "_n")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an export; the first line that breaks a rule ends the job."""
    out = checked(spark.read.text(path))
    return out.select(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast(ROW)).otherwise(F.col("row")).alias("row")).select("row.*")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(manual_id) of id lines, objects of just that key; others end the job."""
    lines = spark.read.text(path)
    fits = F.coalesce((F.json_object_keys("value") == F.array(F.lit("manual_id"))) & (F.get_json_object("value", "$.manual_id") != ""), F.lit(False))
    return lines.select(F.when(fits, F.get_json_object("value", "$.manual_id")).otherwise(F.raise_error(F.concat(F.lit("bad id line: "), "value")).cast("string")).alias("manual_id")).distinct()


def export_lines(units: DataFrame) -> DataFrame:
    """(manual_id, value): one line a unit of FIELDS. A translation is null unless current, a candidate is there only if rejected."""
    body = F.when(F.col("state") == "current", F.col("translation"))
    text = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f'"{name}":'), _json(c)))
    parts = [text("manual_id", F.col("manual_id")), F.concat(F.lit('"source":'), F.to_json("source")), F.concat(F.lit('"translation":'), F.coalesce(F.to_json(body), F.lit("null")))]
    parts += [text(n, F.col(n)) for n in ("state", "origin", "type", "owner")]
    parts += [F.concat(F.lit('"rule_number":'), F.col("rule_number").cast("string")), F.when(F.col("state") == "rejected", text("rejected_candidate_json", F.col("rejected_candidate_json")))]
    return units.select("manual_id", F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")).alias("value"))


def _json(c: Column) -> Column:
    made = F.to_json(F.array(c))
    return F.substring(made, F.lit(2), F.length(made) - 2)


def ownership_lines(units: DataFrame) -> DataFrame:
    """(manual_id, value): id, owner and, for units of rules, the rule's number."""
    return units.select("manual_id", F.to_json(F.struct("manual_id", "owner", "rule_number")).alias("value"))
