"""Structural write-back: edits carried into JSON documents, whatever they don't touch kept as it is."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The step into a string that holds JSON.
DECODE = "|json"
EDITS = "array<struct<steps:array<string>,old:string,text:string,start:int,stop:int,commands:string>>"


class EditError(ValueError):
    pass


class Number(str):
    """A number as it was written."""


class Constant(str):
    pass


def load(text: str):
    return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=Constant)


def dump(value) -> str:
    """Compact JSON; numbers are as they were read."""
    if isinstance(value, (Number, Constant)):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _replaced(items: list, edits: list[dict]) -> list:
    """The list with ranges [start, stop) replaced, all by places of the list as it was."""
    out, at = [], 0
    for e in sorted(edits, key=lambda e: (e["start"], e["stop"])):
        if e["start"] < at or e["stop"] < e["start"] or e["stop"] > len(items):
            raise EditError("overlapping_ranges" if e["start"] < at else "no_such_range")
        out += items[at : e["start"]] + load(e["commands"])
        at = e["stop"]
    return out + items[at:]


def applied(value, edits: list[dict], depth: int = 0):
    """The value with all edits whose steps lead on from here. Values are set before lists are changed, and a nested document is decoded and encoded once."""
    here, below = [e for e in edits if len(e["steps"]) == depth], {}
    for e in edits:
        if len(e["steps"]) > depth:
            below.setdefault(e["steps"][depth], []).append(e)
    if DECODE in below:
        if len(below) > 1 or here or not isinstance(value, str) or isinstance(value, (Number, Constant)):
            raise EditError("not_nested_json")
        try:
            inner = load(value)
        except ValueError as error:
            raise EditError("not_nested_json") from error
        return dump(applied(inner, below[DECODE], depth + 1))
    for step, some in below.items():
        place = int(step[1:-1]) if step.startswith("[") else step
        if not isinstance(value, list if isinstance(place, int) else dict) or not (0 <= place < len(value) if isinstance(place, int) else place in value):
            raise EditError("no_such_place")
        value[place] = applied(value[place], some, depth + 1)
    texts, ranges = [e for e in here if e["commands"] is None], [e for e in here if e["commands"] is not None]
    if ranges:
        if texts or not isinstance(value, list):
            raise EditError("not_a_list")
        return _replaced(value, ranges)
    if texts:
        if len(texts) > 1:
            raise EditError("doubled_edit")
        if not isinstance(value, str) or isinstance(value, (Number, Constant)):
            raise EditError("not_a_text")
        if texts[0]["old"] is not None and texts[0]["old"] != value:
            raise EditError("source_changed")
        return texts[0]["text"]
    return value


def rewrite(docs: DataFrame, key: str, body: str, edits: DataFrame) -> DataFrame:
    """(key, body, error) of every document; one without edits, or with an edit that doesn't fit, keeps its body byte for byte.

    edits (key, steps, old, text, start, stop, commands): steps are names, places as [3], and |json to enter a string of JSON. A text
    edit sets `text`, if the string there still is `old` (null: whatever it is); a list edit replaces [start, stop) by the JSON
    array `commands`. The edits of one document, which its size bounds, are gathered with it.
    """
    own = edits.groupBy(key).agg(F.collect_list(F.struct("steps", "old", "text", "start", "stop", "commands")).cast(EDITS).alias("_edits"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, errors = [], []
            for text, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                error = None
                if some:
                    try:
                        text = dump(applied(load(text), some))
                    except EditError as e:
                        error = str(e)
                    except (TypeError, ValueError, RecursionError):
                        error = "malformed_json"
                bodies.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], [key, "body", "error"])

    return docs.select(key, F.col(body).alias("_body")).join(own, key, "left").select(key, "_body", "_edits").mapInArrow(run, f"{key} {kind}, body string, error string")
