"""Framed SHA-256: a frame is a tag byte, the length as eight bytes and the bytes, so no two sequences of frames collide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAIN = "glyphmill/v1"


def frame(value: Column, tag: str = "01") -> Column:
    """One frame as hex digits; null becomes a frame of tag 00 without content."""
    data = F.encode(value, "UTF-8")
    made = F.concat(F.lit(tag), F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0"), F.hex(data))
    return F.coalesce(made, F.lit("00" + "0" * 16))


def framed_sha256(*values: Column, domain: str = DOMAIN) -> Column:
    return F.sha2(F.unhex(F.concat(frame(F.lit(domain), "00"), *(frame(v) for v in values))), 256)


def ordered_sha256(order: Column, *values: Column, domain: str = DOMAIN) -> Column:
    """Aggregate: the digest of a group's values in order."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat(*(frame(v) for v in values)).alias("x"))))
    return F.sha2(F.unhex(F.concat(frame(F.lit(domain), "00"), F.array_join(F.transform(items, lambda i: i.x), ""))), 256)


def automatic_applicability(source_lang: Column, target_lang: Column, group: Column, unit: Column, text: Column, context: Column) -> Column:
    """Binds the language pair, both ids, the unit's own text and its group's context."""
    return framed_sha256(source_lang, target_lang, group, unit, text, context, domain="glyphmill/automatic")


def manual_applicability(source_lang: Column, target_lang: Column, path: Column, kind: Column, group: Column, unit: Column, shape: Column, text: Column) -> Column:
    """Binds everything about the unit itself and nothing of its siblings."""
    return framed_sha256(source_lang, target_lang, path, kind, group, unit, shape, text, domain="glyphmill/manual")


def game_applicability(source_lang: Column, target_lang: Column, owner: Column, kind: Column, location: Column, role: Column, shape: Column, text: Column, own_context: Column, context: Column) -> Column:
    """Binds the language pair, the owner, the group's kind and place, the unit's role, shape and text, and both contexts."""
    return framed_sha256(source_lang, target_lang, owner, kind, location, role, shape, text, own_context, context, domain="glyphmill/game")


def bindings_sha256(bindings: Column) -> Column:
    """The digest of protected spans in order: array<struct<token, original, label, scope, order, wrapper>>.

    Wrappers count by the number of their first appearance, whatever they are named; a span without one has null.
    """

    def digest(b: Column) -> Column:
        pairs = F.array_distinct(F.filter(F.transform(b, lambda x: x.wrapper), lambda w: w.isNotNull()))
        one = lambda x: F.concat(*(frame(v) for v in (x.token, x.original, x.label, x.scope, x.order)), frame((F.array_position(pairs, x.wrapper) - 1).cast("string")))
        return F.sha2(F.unhex(F.concat(frame(F.lit("glyphmill/bindings"), "00"), F.array_join(F.transform(b, one), ""))), 256)

    return F.get(F.transform(F.array(bindings), digest), F.lit(0))
