"""The answer path: the message a block is sent as, how the answer to it is read, and what becomes of its entries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions.json_repair import RepairError, repair
from glyphmill.operators.validate import violation

FENCE, FENCE_END = r"^[ \t\r\n]*```json[ \t]*\r?\n", r"^[ \t]*```[ \t]*\r?$"


# -- messages


def quoted(text: Column) -> Column:
    """The text as a JSON string."""
    made = F.to_json(F.array(text))
    return F.substring(made, F.lit(2), F.length(made) - 2)


def _object(fields: dict[str, Column], depth: int) -> Column:
    """Rendered values by name; those that are null are left out."""
    pad = "  " * (depth + 1)
    items = F.filter(F.array(*(F.concat(F.lit(f'{pad}"{n}": '), c) for n, c in fields.items())), lambda x: x.isNotNull())
    return F.concat(F.lit("{\n"), F.array_join(items, ",\n"), F.lit("\n" + "  " * depth + "}"))


def _list(items: Column, depth: int) -> Column:
    inner = F.array_join(F.transform(items, lambda x: F.concat(F.lit("  " * (depth + 1)), x)), ",\n")
    return F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("[\n"), inner, F.lit("\n" + "  " * depth + "]")))


def user_message(terms: Column, groups: Column) -> Column:
    """One fenced JSON text, indented by two spaces.

    terms: array<struct<source, translation>>, left out where empty; groups: array<struct<kind, units: array<struct<id, role,
    type, text>>>>. Units of context have neither id nor type; a text is rendered as the array of its lines.
    """

    def unit(u: Column) -> Column:
        some = lambda c: F.when(c.isNotNull(), quoted(c))
        return _object({"id": some(u.id), "role": some(u.role), "type": some(u.type), "text": _list(F.transform(T.lines(u.text), quoted), 5)}, 4)

    group = lambda g: _object({"kind": quoted(g.kind), "units": _list(F.transform(g.units, unit), 3)}, 2)
    term = lambda t: _object({"source": quoted(t.source), "translation": quoted(t.translation)}, 2)
    known = F.when(F.size(terms) > 0, _list(F.transform(terms, term), 1))
    return F.concat(F.lit("```json\n"), _object({"terminology": known, "groups": _list(F.transform(groups, group), 1)}, 0), F.lit("\n```"))


# -- answers


def unfenced(text: Column) -> Column:
    """What the one json fence around an answer holds. Another label, text outside, or no end: the answer as it is."""

    def content(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.rlike(FENCE_END)), True).cast("int")
        clean = F.forall(F.slice(lines, at + 1, F.size(lines)), lambda x: x.rlike(r"^[ \t\r]*$"))
        return F.when((at > 0) & clean, F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0))), "\n"))

    # The list is bound to a lambda's variable, so that it is made once.
    inside = F.get(F.transform(F.array(F.split(F.regexp_replace(text, FENCE, ""), "\n", -1)), content), F.lit(0))
    return F.when(text.rlike(FENCE), F.coalesce(inside, text)).otherwise(text)


class Pairs(list):
    """An object's names and values in order, doubled names kept."""

    def names(self) -> list[str]:
        return sorted(k for k, _ in self)


def _constant(name: str):
    raise ValueError(name)


def _decode(text: str):
    return json.loads(text, object_pairs_hook=Pairs, parse_constant=_constant)


def _lines(value) -> bool:
    return isinstance(value, list) and not isinstance(value, Pairs) and all(isinstance(x, str) for x in value)


def entries(answer: str | None, thinking: bool = False, echo: bool = False) -> Iterator[tuple]:
    """(at, id, lines, source, problem) of each entry, or one row with only the problem where the answer can't be read.

    Strict JSON first, then repair. thinking: the root holds just `think`, a text that isn't blank, and `translations`.
    echo: a value is an object of just `source` and `translation`.
    """
    broken = lambda why: iter([(None, None, None, None, why)])
    if answer is None:
        return broken("no_answer")
    try:
        try:
            root = _decode(answer)
        except ValueError:
            root = _decode(repair(answer))
    except RepairError as e:
        return broken(e.kind)
    except ValueError:
        return broken("malformed_json")
    except RecursionError:
        return broken("too_deep")
    if isinstance(root, Pairs) and thinking:
        parts = dict(root)
        if root.names() != ["think", "translations"] or not isinstance(parts["think"], str):
            return broken("wrong_shape")
        if not parts["think"].strip():
            return broken("empty_thinking")
        root = parts["translations"]
    if not isinstance(root, Pairs):
        return broken("wrong_shape")

    def rows():
        for at, (name, value) in enumerate(root):
            source = None
            if echo:
                if not isinstance(value, Pairs) or value.names() != ["source", "translation"] or not _lines(dict(value)["source"]):
                    yield at, name, None, None, "wrong_echo"
                    continue
                source, value = dict(value)["source"], dict(value)["translation"]
            yield (at, name, value, source, None) if _lines(value) else (at, name, None, source, "wrong_value")

    return rows()


def read(answers: DataFrame, keys: list[str], answer: str, thinking: bool = False, echo: bool = False) -> DataFrame:
    """(keys, at, id, lines, source, problem): the entries of every answer; an answer with none that can be read has one row of nulls and the reason."""
    kinds = [answers.schema[k].dataType.simpleString() for k in keys]
    names = ["at", "id", "lines", "source", "problem"]
    types = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *row) for i, t in enumerate(batch.column(len(keys)).to_pylist()) for row in entries(t, thinking, echo)]
            place = pa.array([f[0] for f in found], pa.int32())
            columns = [batch.column(i).take(place) for i in range(len(keys))]
            columns += [pa.array([f[j + 1] for f in found], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *names])

    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds)), "at int, id string, lines array<string>, source array<string>, problem string"])
    return answers.select(*keys, unfenced(F.col(answer)).alias("_answer")).mapInArrow(run, schema)


def settle(requests: DataFrame, found: DataFrame, keys: list[str], source: str, fixed: bool = True) -> DataFrame:
    """(keys, id, outcome, reason, lines): every requested or answered id of a block.

    outcome: accepted, rejected (with the broken invariant, or the value's or echo's problem), missing, unexpected, invalid or
    repeated. Of an id answered twice in a block no answer counts. An echo must repeat the source's lines.
    """
    by_id = found.where("id is not null").groupBy(*keys, "id").agg(F.count("*").alias("_n"), F.min_by(F.struct("lines", F.col("source").alias("echo"), "problem"), "at").alias("_a"))
    both = requests.select(*keys, "id", F.col(source).alias("_s"), F.lit(True).alias("_r")).join(by_id, [*keys, "id"], "full_outer")
    said, asked = F.col("_a.lines"), F.col("_s")
    reason = F.coalesce(F.col("_a.problem"), F.when(F.col("_a.echo") != asked, "other_echo"), violation(asked, said, fixed))
    outcome = (
        F.when(F.col("_n").isNull(), "missing").when(~T.is_canonical_id(F.col("id")), "invalid").when(F.col("_r").isNull(), "unexpected")
        .when(F.col("_n") > 1, "repeated").when(reason.isNotNull(), "rejected").otherwise("accepted")
    )
    out = both.withColumn("outcome", outcome)
    return out.select(*keys, "id", "outcome", F.when(F.col("outcome") == "rejected", reason).alias("reason"), F.when(F.col("outcome") == "accepted", said).alias("lines"))
