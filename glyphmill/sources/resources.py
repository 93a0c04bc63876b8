"""Small strict resources, read on the driver: terminology, placeholder, layout and extraction rules, manual answers."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession

#: Rows of a resource at most; resources are sent to every task.
MOST = 100_000

SHAPES = {
    "term": ({"term": str, "translation": str}, {"triggers": list}),
    "placeholder": ({"pattern": str, "order": str}, {"scopes": list, "ids": list}),
    "layout": ({"max_width": int}, {"kinds": list, "ids": list, "scopes": list, "exclude_ids": list}),
    "extract": ({"path": str}, {"file": str, "plugin": str, "code": int, "pattern": str, "decode_json": bool}),
    "dialogue": ({"pattern": str}, {}),
    "translation": ({"id": str, "type": str, "source": list, "translation": list}, {}),
}
SCHEMAS = {
    "term": "ord int, term string, translation string, triggers array<string>",
    "placeholder": "ord int, pattern string, `order` string, scopes array<string>, ids array<string>",
    "layout": "ord int, max_width int, kinds array<string>, ids array<string>, scopes array<string>, exclude_ids array<string>",
    "extract": "ord int, path string, file string, plugin string, code int, pattern string, decode_json boolean",
    "dialogue": "ord int, pattern string",
    "translation": "ord int, id string, type string, source array<string>, translation array<string>",
}


class ResourceError(ValueError):
    pass


def parse(text: str, kind: str) -> list[dict]:
    """The entries of a TOML resource of one kind; unknown, missing, mistyped and doubled ones are errors."""
    data = tomllib.loads(text)
    if set(data) - {kind}:
        raise ResourceError(f"unknown table {sorted(set(data) - {kind})[0]}")
    needed, optional = SHAPES[kind]
    rows, seen = [], set()
    for k, entry in enumerate(data.get(kind, [])):
        if extra := set(entry) - set(needed) - set(optional):
            raise ResourceError(f"entry {k}: unknown key {sorted(extra)[0]}")
        for name, type_ in needed.items():
            if name not in entry:
                raise ResourceError(f"entry {k}: missing key {name}")
        for name, value in entry.items():
            if not isinstance(value, (needed | optional)[name]) or isinstance(value, bool) != ((needed | optional)[name] is bool):
                raise ResourceError(f"entry {k}: wrong type of {name}")
        if kind in ("term", "translation"):
            key = entry.get("term", entry.get("id"))
            if not key or key in seen:
                raise ResourceError(f"entry {k}: {'doubled' if key else 'empty'} {kind}")
            seen.add(key)
        rows.append(entry)
    if len(rows) > MOST:
        raise ResourceError(f"more than {MOST} entries")
    return rows


def resource(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """The entries as a small DataFrame, numbered in file order."""
    names = [x.split()[0].strip("`") for x in SCHEMAS[kind].split(", ")]
    rows = [(k, *(e.get(n) for n in names[1:])) for k, e in enumerate(parse(text, kind))]
    return spark.createDataFrame(rows, SCHEMAS[kind])


def triggers(entries: list[dict]) -> list[str]:
    """What each term is found by: its triggers, or itself."""
    return [t for e in entries for t in (e.get("triggers") or [e["term"]])]
