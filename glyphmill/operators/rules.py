"""Extraction rules: value paths compiled to Column expressions.

A path is made of keys (a, ["a b"]), places ([3]) and [] for every element. Between two steps a value that
is a JSON string is decoded. A missing key or place gives nothing; null elements are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.sources.documents import is_map

STEP = re.compile(r"""\.?([A-Za-z_][A-Za-z0-9_]*)|\["((?:[^"\\]|\\.)*)"\]|\[([0-9]+)\]|(\[\])""")


def compile_path(path: str) -> list[tuple[str, object]]:
    """Steps ("key", name), ("place", n) and ("each", None); ValueError for anything else."""
    steps, at = [], 0
    while at < len(path):
        m = STEP.match(path, at)
        if not m or (path[at] == "." and not steps):
            raise ValueError(f"bad path at {at}: {path}")
        name, quoted, place, each = m.groups()
        steps.append(("key", name) if name else ("place", int(place)) if place else ("each", None) if each else ("key", re.sub(r"\\(.)", r"\1", quoted)))
        at = m.end()
    if not steps:
        raise ValueError("empty path")
    return steps


def extract(docs: DataFrame, key: list[str], body: str, path: str) -> DataFrame:
    """(key, at, value): the scalar texts a path leads to; `at` holds the places taken at each []."""
    out = docs.select(*key, F.array().cast("array<int>").alias("at"), F.col(body).alias("value")).where("value is not null")
    for kind, x in compile_path(path):
        # A string leaf that was a JSON document comes out of get_json_object as its own text.
        if kind == "key":
            name = str(x).replace("'", "\\'")
            out = out.withColumn("value", F.get_json_object("value", f"$['{name}']"))
        elif kind == "place":
            out = out.withColumn("value", F.get_json_object("value", f"$[{x}]"))
        else:
            out = out.select(*key, "at", F.posexplode(F.from_json("value", "array<string>")).alias("_i", "value"))
            out = out.select(*key, F.concat("at", F.array("_i")).alias("at"), "value")
        out = out.where("value is not null")
    return out


def unmatched(rules: list[str], found: DataFrame, rule: str) -> DataFrame:
    """Rules without a target that holds more than white space."""
    all_ = found.sparkSession.createDataFrame([(r,) for r in rules], f"{rule} string")
    return all_.join(found.where(F.trim("value") != "").select(rule).distinct(), rule, "left_anti")


def doubled(found: DataFrame, target: list[str], rule: str) -> DataFrame:
    """Targets that more than one rule leads to."""
    return found.groupBy(*target).agg(F.count_distinct(rule).alias("rules")).where("rules > 1")


def recipe(text, pattern: str):
    """What a pattern's first group takes (slots) and what stands between the matches (literals)."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("slots"), F.split(text, pattern, -1).alias("literals"))


FOUND = "array<struct<path:string,at:array<int>,value:string>>"


def _found(tree: dict, value, at):
    """What the paths of a tree lead to from a value, as an array; a shared step is one expression."""
    parts = [F.array(F.struct(F.lit(p).alias("path"), at.alias("at"), value.alias("value"))) for p in tree.get("paths", [])]
    for (kind, x), child in tree.get("steps", {}).items():
        if kind == "each":
            parts.append(_each(child, value, at))
        else:
            name = str(x).replace("'", "\\'")
            parts.append(_found(child, F.get_json_object(value, f"$['{name}']" if kind == "key" else f"$[{x}]"), at))
    return F.concat(*(F.coalesce(p.cast(FOUND), F.array().cast(FOUND)) for p in parts))


def _each(tree: dict, value, at):
    return F.flatten(F.transform(F.from_json(value, "array<string>"), lambda v, i: _found(tree, v, F.concat(at, F.array(i)))))


def extract_many(docs: DataFrame, key: list[str], body: str, paths: list[str]) -> DataFrame:
    """(key, path, at, value) of several paths in one pass over each document; steps that paths share are taken once."""
    tree: dict = {}
    for path in paths:
        node = tree
        for step in compile_path(path):
            node = node.setdefault("steps", {}).setdefault(step, {})
        node.setdefault("paths", []).append(path)
    found = F.filter(_found(tree, F.col(body), F.array().cast("array<int>")), lambda f: f.value.isNotNull())
    return docs.select(*key, F.inline(found))


#: Documents with event lists, beside the maps.
EVENT_DOCUMENTS = ["CommonEvents.json", "Troops.json"]


def route(files: DataFrame, file: str, rules: list[dict]) -> DataFrame:
    """files with rule, the number of each rule that reads them: the file's own, those for all maps (file Map*.json), and commands' rules for event documents.

    rules is a resource; each file takes its numbers from a literal map by name, so nothing is shuffled.
    """
    exact: dict[str, list[int]] = {}
    maps, commands = [], []
    for i, r in enumerate(rules):
        if "code" in r:
            commands.append(i)
        elif r.get("file") == "Map*.json":
            maps.append(i)
        elif "file" in r:
            exact.setdefault(r["file"], []).append(i)
    numbers = lambda some: F.array(*map(F.lit, some)).cast("array<int>")
    own = numbers([])
    if exact:
        own = F.coalesce(F.create_map(*(x for name, some in exact.items() for x in (F.lit(name), numbers(some))))[F.col(file)], own)
    own = F.concat(own, F.when(is_map(F.col(file)), numbers(maps)).otherwise(numbers([])))
    own = F.concat(own, F.when(is_map(F.col(file)) | F.col(file).isin(EVENT_DOCUMENTS), numbers(commands)).otherwise(numbers([])))
    return files.withColumn("rule", F.explode(F.array_sort(own)))


def merged(found: DataFrame, source: str, physical: str, steps: str, rule: str) -> DataFrame:
    """Targets in the order of source, place and steps, with `error` where more than one rule leads to the same."""
    targets = [source, steps]
    twice = found.groupBy(*targets).agg(F.min(rule).alias("first_rule"), F.count("*").alias("_n"))
    out = found.join(twice, targets).withColumn("error", F.when(F.col("_n") > 1, "duplicate_target"))
    return out.drop("_n").orderBy(source, physical, steps)
