"""Strict JSONL groups: {"id", "kind", "units": [{"id", "text"}]}, one object a line.

Reading never infers. Lines are read whole, with their file and number; every line that breaks a rule
gets the rule's name, so a caller can fail or report. Rules: blank line, malformed JSON or doubled keys,
unknown or missing keys, wrong types, empty ids, kinds or units, doubled unit ids, CR or NUL in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = "struct<id:string,kind:string,units:array<struct<id:string,text:string>>>"


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line, value) of all files *.jsonl under root, by exact lower-case suffix; line from 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    path = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    text = F.col("content").cast("string")
    # The line end of the last line doesn't begin another.
    rows = files.select(path.alias("path"), F.posexplode(F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\r?\n", -1)).alias("line", "value"), (F.length("content") == 0).alias("empty"))
    return rows.where(~F.col("empty")).drop("empty")


def line_error(value: Column) -> Column:
    """The first rule that a line breaks; null if it is a valid group."""
    keys = F.json_object_keys(value)
    units = F.from_json(F.get_json_object(value, "$.units"), "array<string>")
    group = F.from_json(value, GROUP)
    sound = lambda found, names: F.array_sort(found) == F.array(*map(F.lit, sorted(names)))
    is_text = lambda v, p: F.get_json_object(v, p).isNotNull()
    return (
        F.when(F.trim(value) == "", "blank_line")
        .when(F.try_parse_json(value).isNull() | keys.isNull(), "malformed_json")
        .when(F.size(F.array_distinct(keys)) != F.size(keys), "duplicate_key")
        .when(~sound(keys, ["id", "kind", "units"]), "wrong_keys")
        .when(units.isNull() | F.exists(units, lambda u: F.json_object_keys(u).isNull() | ~sound(F.json_object_keys(u), ["id", "text"])), "wrong_unit_keys")
        .when(group.isNull() | group.id.isNull() | group.kind.isNull() | F.exists(group.units, lambda u: u.id.isNull() | u.text.isNull()) | ~is_text(value, "$.id"), "wrong_type")
        .when((group.id == "") | (group.kind == "") | (F.size(group.units) == 0) | F.exists(group.units, lambda u: u.id == ""), "empty_value")
        .when(F.size(F.array_distinct(F.transform(group.units, lambda u: u.id))) != F.size(group.units), "duplicate_unit")
        .when(F.exists(group.units, lambda u: u.text.rlike("[\r\\x00]")), "control_character")
    )


def checked(lines: DataFrame) -> DataFrame:
    """Lines with `error` and, where there is none, the group."""
    out = lines.withColumn("error", line_error(F.col("value")))
    return out.withColumn("group", F.when(F.col("error").isNull(), F.from_json("value", GROUP)))


def read_groups(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """(path, line, id, kind, units). strict: the first bad line ends the job with its place and rule."""
    rows = checked(read_lines(spark, root))
    if strict:
        bad = F.concat(F.col("path"), F.lit(":"), (F.col("line") + 1).cast("string"), F.lit(" "), F.col("error"))
        rows = rows.withColumn("group", F.when(F.col("error").isNotNull(), F.raise_error(bad).cast(GROUP)).otherwise(F.col("group")))
    else:
        rows = rows.where("error is null")
    return rows.select("path", "line", "group.id", "group.kind", "group.units")


def repeated_groups(groups: DataFrame) -> DataFrame:
    """Group ids that occur more than once in the project."""
    return groups.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def units(groups: DataFrame) -> DataFrame:
    """(path, line, group_id, kind, unit_ord, unit_id, text) in natural order by path, line, unit_ord."""
    out = groups.select("path", "line", F.col("id").alias("group_id"), "kind", F.posexplode("units").alias("unit_ord", "u"))
    return out.select("path", "line", "group_id", "kind", "unit_ord", F.col("u.id").alias("unit_id"), F.col("u.text").alias("text"))


def write_groups(groups: DataFrame, path: str) -> None:
    """Compact JSON lines, LF ended, one folder a source file, in line order within it."""
    rows = groups.select("path", "line", F.to_json(F.struct("id", "kind", "units")).alias("value"))
    rows.repartition("path").sortWithinPartitions("path", "line").select("path", "value").write.mode("overwrite").partitionBy("path").text(path)
