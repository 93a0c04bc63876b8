"""Dictionary joins: which terms a text holds, and where."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alternation(terms: list[str]) -> str:
    """A pattern that finds the leftmost match and there the longest."""
    return "(" + "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(set(terms), key=lambda t: (-len(t), t))) + ")"


def selected(text: Column, terms: list[str]) -> Column:
    """The terms that leftmost-longest selection takes, in text order, overlaps dropped."""
    return F.regexp_extract_all(text, F.lit(alternation(terms)), F.lit(1))


def entry_numbers(text: Column, terms: list[str]) -> Column:
    """Numbers of the selected entries in file order, each once."""
    number = F.create_map(*(x for i, t in enumerate(terms) for x in (F.lit(t), F.lit(i))))
    return F.array_sort(F.array_distinct(F.transform(selected(text, terms), lambda t: number[t])))


def occurrences(texts: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, term, n): overlapping occurrences of every term, those without left out. One pass over each text for a term."""
    counts = F.array(*(F.struct(F.lit(t).alias("term"), F.regexp_count(F.col(text), F.lit(f"(?={re.escape(t)})")).alias("n")) for t in terms))
    return texts.select(key, F.inline(F.filter(counts, lambda c: c.n > 0)))
