"""Protected spans as Column expressions: numbered tokens in, originals back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\u27e6gm:", "\u27e7"


def spans(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def has_reserved(text: Column) -> Column:
    return F.contains(text, F.lit(OPEN))


def token(number: Column) -> Column:
    return F.concat(F.lit(OPEN), F.format_string("%04d", number), F.lit(CLOSE))


def protect(text: Column, pattern: str) -> Column:
    """The text with every match replaced by its token, numbered from 0 in source order."""
    between = F.split(text, pattern, -1)
    return F.array_join(F.transform(between, lambda t, i: F.when(i == 0, t).otherwise(F.concat(token(i - 1), t))), "")


def restore(text: Column, originals: Column) -> Column:
    """Tokens back to originals, by number; unknown numbers stay."""
    return F.aggregate(
        F.transform(originals, lambda o, i: F.struct(token(i).alias("t"), o.alias("o"))), text, lambda acc, b: F.replace(acc, b.t, b.o)
    )


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({OPEN}[0-9]{{4,}}{CLOSE})"), F.lit(1))


def malformed(text: Column) -> Column:
    """Whether an envelope is opened that no well-formed token accounts for."""
    rest = F.regexp_replace(text, f"{OPEN}[0-9]{{4,}}{CLOSE}", "")
    return F.contains(rest, F.lit(OPEN))


def same_tokens(source: Column, target: Column) -> Column:
    """Multiset equality of tokens."""
    return F.array_sort(tokens(source)) == F.array_sort(tokens(target))


def violation(source: Column, target: Column, keep_order: bool) -> Column:
    """The first broken rule of a protected target, null if none is: counts, envelopes, order."""
    order = F.lit(keep_order) & (tokens(source) != tokens(target))
    return F.when(~same_tokens(source, target), "token_counts").when(malformed(target), "unexpected_token").when(order, "token_order")


TOKEN = f"{OPEN}[0-9]{{4,}}{CLOSE}"


def segments(text: Column) -> Column:
    """array<struct<opaque, text>>: natural text and the tokens between, in order; empty stretches are left out."""
    known = tokens(text)
    pair = lambda t, i: F.array(F.struct(F.lit(False).alias("opaque"), t.alias("text")), F.struct(F.lit(True).alias("opaque"), F.get(known, i).alias("text")))
    return F.filter(F.flatten(F.transform(F.split(text, TOKEN, -1), pair)), lambda s: s.text != "")


def natural_text(text: Column) -> Column:
    """The natural stretches, an LF between them, so that nothing is read across a token."""
    return F.array_join(F.transform(F.filter(segments(text), lambda s: ~s.opaque), lambda s: s.text), "\n")


def slot_violation(source: Column, target: Column, free: Column) -> Column:
    """The first broken rule of protected lines, slot by slot, null if none is.

    Every slot keeps its tokens; those not in `free` keep their order within it.
    """
    fixed = lambda line: F.filter(tokens(line), lambda t: ~F.array_contains(free, t))
    moved = F.exists(F.zip_with(source, target, lambda s, t: ~F.coalesce(same_tokens(s, t), F.lit(False))), lambda x: x)
    turned = F.exists(F.zip_with(source, target, lambda s, t: fixed(s) != fixed(t)), lambda x: x)
    whole = same_tokens(F.array_join(source, "\n"), F.array_join(target, "\n"))
    return F.when(~whole, "token_counts").when(F.size(source) != F.size(target), "slot_count").when(moved, "token_slot").when(turned, "token_order")


def wrapper_holds(lines: Column, begin: Column, end: Column, content: Column) -> Column:
    """Whether a wrapper's two tokens stand in one line, begin first, around natural text (content) or around none."""
    part = lambda line, mark, side: F.call_function("substring_index", line, mark, F.lit(side))
    around = lambda line: F.contains(line, begin) & F.contains(part(line, begin, -1), end)
    filled = lambda line: F.trim(F.regexp_replace(part(part(line, begin, -1), end, 1), TOKEN, "")) != ""
    return F.exists(lines, lambda line: around(line) & (filled(line) == content))
