"""Nested project documents: maps, databases, event lists, plugin settings, html and scripts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Event codes, as the documents define them.
DIALOGUE, DIALOGUE_LINE = 101, 401
CHOICES, CHOICE, CHOICES_END = 102, 402, 404
SCROLL, SCROLL_LINE = 105, 405
RENAMES = (320, 324, 325)


def read_documents(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """(name, path, body) of JSON and JS files under root; only the named files are opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("name", name).where(F.col("name").rlike(r"\.(json|js|html)$"))
    if names is not None:
        files = files.where(F.col("name").isin(names))
    return files.select("name", "path", F.col("content").cast("string").alias("body"))


def is_map(name: Column) -> Column:
    """MapNNN.json: three digits, or more without a leading zero, from 1 to 4294967295."""
    digits = F.regexp_extract(name, r"^Map([0-9]{3}|[1-9][0-9]{3,9})\.json$", 1)
    number = F.try_to_number(digits, F.lit("9999999999"))
    return F.coalesce((digits != "") & (number >= 1) & (number <= 4294967295), F.lit(False))


def plugins(body: Column) -> Column:
    """The settings array of a plugins script, as JSON text without its envelope."""
    return F.regexp_extract(body, r"(?s)=\s*(\[.*\])\s*;?\s*$", 1)


def enabled(entries: DataFrame, name: str) -> DataFrame:
    return entries.where((F.col("name") == name) & F.col("status"))


def database_fields(body: DataFrame, fields: list[str]) -> DataFrame:
    """(path, index, field, text) of the non-blank fields of a database document, a JSON array with null rows."""
    rows = body.select("path", F.posexplode(F.from_json("body", "array<map<string,string>>")).alias("index", "row")).where("row is not null")
    rows = rows.select("path", "index", *(F.col("row")[f].alias(f) for f in fields))
    return rows.unpivot(["path", "index"], fields, "field", "text").where(F.trim("text") != "")


COMMANDS = "array<struct<code:int,indent:int,parameters:array<string>>>"


def commands(lists: DataFrame, key: list[str], body: str) -> DataFrame:
    """(key, idx, code, indent, parameters) of event lists given as JSON text."""
    return lists.select(*key, F.posexplode(F.from_json(body, COMMANDS)).alias("idx", "c")).select(*key, "idx", "c.code", "c.indent", "c.parameters")


def event_blocks(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, block, kind, lines): dialogue and scrolling text, as runs of a head command and its line commands.

    A list belongs to one event and is sorted within it.
    """
    w = Window.partitionBy(*key).orderBy("idx")
    head = F.col("code").isin(DIALOGUE, SCROLL)
    line = F.col("code").isin(DIALOGUE_LINE, SCROLL_LINE)
    # A block is broken by any command that is neither its head nor one of its lines.
    rows = rows.withColumn("block", F.sum((head | ~line).cast("int")).over(w))
    out = rows.where(head | line).groupBy(*key, "block").agg(
        F.min_by("code", "idx").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.when(line, F.struct("idx", F.get("parameters", F.lit(0)).alias("t"))))), lambda x: x.t).alias("lines"),
    )
    kind = F.when(F.col("first") == DIALOGUE, "dialogue").when(F.col("first") == SCROLL, "scrolling")
    return out.select(*key, "block", kind.alias("kind"), "lines").where(kind.isNotNull() & (F.size("lines") > 0))


def choices(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, idx, options, branches): each choice command with the branch commands of its own indent up to its end."""
    w = Window.partitionBy(*key, "indent").orderBy("idx")
    part = rows.where(F.col("code").isin(CHOICES, CHOICE, CHOICES_END)).withColumn("block", F.sum((F.col("code") == CHOICES).cast("int")).over(w))
    return part.where("block > 0").groupBy(*key, "indent", "block").agg(
        F.min("idx").alias("idx"),
        F.from_json(F.min_by(F.get("parameters", F.lit(0)), "idx"), "array<string>").alias("options"),
        F.count_if(F.col("code") == CHOICE).alias("branches"),
        F.bool_or(F.col("code") == CHOICES_END).alias("closed"),
    )


def renames(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.where(F.col("code").isin(*RENAMES)).select(*key, "idx", "code", F.get("parameters", F.lit(1)).alias("text"))


def speaker(line: Column, pattern: str) -> Column:
    """The first group of the speaker pattern; null where blank or absent."""
    return F.nullif(F.trim(F.regexp_extract(line, pattern, 1)), F.lit(""))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<script[^>]*\ssrc=["']([^"']+)["']"""), F.lit(1))


# -- scanners that need a place by place reading


def string_leaves(value, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, text) of every string in a decoded JSON value; strings that are JSON containers are entered."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{at}.{k}" if re.fullmatch(r"[A-Za-z_]\w*", k) else f"{at}[{json.dumps(k, ensure_ascii=False)}]", x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{at}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, str):
            inner = None
            if v[:1] in ("{", "["):
                try:
                    inner = json.loads(v)
                except ValueError:
                    pass
            if isinstance(inner, (dict, list)):
                stack.append((at + "|json", inner))
            else:
                yield at, v


SCRIPT = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<template>`(?:[^`\\]|\\.)*`)"""
    r"""|(?P<regex>(?<![\w)\]])\s*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)""",
    re.S,
)


def script_literals(code: str) -> Iterator[tuple[int, str, str]]:
    """(place, kind, text) of the string and template literals of a script; comments and patterns are passed over."""
    for m in SCRIPT.finditer(code):
        if m.lastgroup == "text" or m.lastgroup == "template":
            body = m.group(m.lastgroup)[1:-1]
            body = re.sub(r"\\(['\"`\\/])", r"\1", body).replace("\\n", "\n").replace("\\t", "\t")
            yield m.start(m.lastgroup), "string" if m.lastgroup == "text" else "template", body


def explode_leaves(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path, text): the string leaves of JSON texts; texts that are no JSON give no rows."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(k, p, x) for p, x in string_leaves(json.loads(t))]
                except (TypeError, ValueError):
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), (batch.schema.field(0).type, pa.string(), pa.string()))], [key, "path", "text"])

    return docs.select(key, body).mapInArrow(run, f"{key} {kind}, path string, text string")


def explode_literals(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, kind, text): the literals of scripts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for x in script_literals(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string()))], [key, "place", "kind", "text"])

    return docs.select(key, body).mapInArrow(run, f"{key} {kind}, place int, kind string, text string")


# -- system files and event lists

#: Where a system file holds texts.
SYSTEM_TEXTS = ["gameTitle", "currencyUnit"]
SYSTEM_LISTS = ["terms.basic", "terms.commands", "terms.params", "elements", "skillTypes", "weaponTypes", "armorTypes", "equipTypes"]
SYSTEM_MAP = "terms.messages"
FIELDS = "array<struct<field:string,text:string>>"


def system_texts(bodies: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """(key, field, text): scalars, list elements and the open set of messages of system files; blank ones and nulls are left out."""
    at = lambda path: F.get_json_object(body, f"$.{path}")
    field = lambda name, text: F.struct(name.alias("field"), text.alias("text"))
    listed = lambda n: F.transform(F.from_json(at(n), "array<string>"), lambda x, i: field(F.concat(F.lit(f"{n}["), i.cast("string"), F.lit("]")), x))
    parts = [F.array(*(field(F.lit(n), at(n)) for n in SYSTEM_TEXTS)), *map(listed, SYSTEM_LISTS)]
    parts.append(F.transform(F.map_entries(F.from_json(at(SYSTEM_MAP), "map<string,string>")), lambda e: field(F.concat(F.lit(f"{SYSTEM_MAP}."), e.key), e.value)))
    found = F.concat(*(F.coalesce(p.cast(FIELDS), F.array().cast(FIELDS)) for p in parts))
    return bodies.select(*key, F.inline(found)).where(F.trim("text") != "")


def map_names(bodies: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    return bodies.select(*key, F.get_json_object(body, "$.displayName").alias("text")).where(F.trim("text") != "")


PAGES = "array<struct<pages:array<struct<list:string>>>>"


def event_lists(bodies: DataFrame, key: list[str], kind: str, body: str = "body") -> DataFrame:
    """(key, event, page, list): the command lists of maps, common events (their page is null) or troops, as JSON text; null rows are passed over."""
    if kind == "common":
        rows = bodies.select(*key, F.posexplode(F.from_json(body, "array<struct<list:string>>")).alias("event", "e"))
        return rows.select(*key, "event", F.lit(None).cast("int").alias("page"), "e.list").where("list is not null")
    if kind not in ("map", "troop"):
        raise ValueError(f"no event document {kind}")
    whole = F.from_json(F.get_json_object(body, "$.events") if kind == "map" else F.col(body), PAGES)
    rows = bodies.select(*key, F.posexplode(whole).alias("event", "e")).select(*key, "event", F.posexplode("e.pages").alias("page", "p"))
    return rows.select(*key, "event", "page", "p.list").where("list is not null")
