"""Width-bounded line breaks, bracket matching and punctuation repair, as Arrow UDFs."""


import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from glyphmill.functions.udfs import arrow_udf

PAIRS = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "“": "”", "‘": "’"}
#: Marks that are taken for the same, by family.
FAMILIES = ("!！", "?？", ",，、", ".。．", ":：", ";；", "(（", ")）", "[【", "]】", "\"“”「」")
FAMILY = {c: k for k, f in enumerate(FAMILIES) for c in f}
AFTER = set("!！?？,，、.。．:：;；)）]】」』”’")


def char_width(c: str) -> int:
    if unicodedata.category(c) == "Cc":
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


#: Widths of code points, as far as they were asked for.
UNKNOWN = 255
WIDTHS = np.full(sys.maxunicode + 1, UNKNOWN, np.uint8)
SPACE, NEWLINE = ord(" "), ord("\n")
AFTER_CODES = np.array(sorted(map(ord, AFTER)), np.uint32)
#: Characters that are wrapped at once; a longer text is wrapped by itself.
SLICE = 1 << 20


def code_widths(codes: np.ndarray) -> np.ndarray:
    """char_width of every code point."""
    out = WIDTHS[codes]
    if (new := out == UNKNOWN).any():
        for c in np.unique(codes[new]).tolist():
            WIDTHS[c] = char_width(chr(c))
        out = WIDTHS[codes]
    return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range of `size`, end to end."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def wrap_lines(text: str, most: int) -> list[str]:
    """The lines of the text, each with as few breaks as needed that keep it within `most` columns, its parts as even as can be.

    A line may be broken after a space or a closing mark, and between two wide characters. Without a set of safe breaks that
    fits, it stays unchanged. A break takes the place of the spaces at it. All lines are taken together: first the places
    from which one part is enough to the line's end, then those from which two are, and so on.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    widths = code_widths(codes)
    until = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
    ends = np.flatnonzero(codes == NEWLINE)
    begin, end = np.append(0, ends + 1), np.append(ends, len(codes))
    out = text.split("\n")
    wide = until[end] - until[begin] > most
    if not wide.any():
        return out
    a, b, after = codes[:-1], codes[1:], np.isin(codes, AFTER_CODES)
    safe = ((a == SPACE) | after[:-1] | ((widths[:-1] == 2) & (widths[1:] == 2))) & ~after[1:] & (b != SPACE) & (b != NEWLINE)
    breaks = np.flatnonzero(safe) + 1
    # The places of lines: where they begin, may be broken, and end.
    places = np.sort(np.concatenate([begin[wide], breaks[wide[np.searchsorted(ends, breaks)]], end[wide]]))
    full = np.flatnonzero(codes != SPACE)
    at = np.searchsorted(full, places)
    # A part from one place to another goes from the first's opening to the other's closing, without the spaces there.
    opening, closing = np.append(full, len(codes))[at], np.append(0, full + 1)[at]
    left, right = until[opening], until[closing]
    line, first = np.flatnonzero(wide), np.searchsorted(places, begin[wide])
    narrow = np.append(right[1:] - left[:-1] <= most, True)
    last = np.append(first[1:], len(places)) - 1
    narrow[last] = True
    fits = np.logical_and.reduceat(narrow, first)
    keep = np.repeat(fits, last - first + 1)
    opening, closing, left, right = opening[keep], closing[keep], left[keep], right[keep]
    line, size = line[fits], (last - first + 1)[fits]
    last = np.cumsum(size) - 1
    first = last - size + 1
    far = np.minimum(np.searchsorted(right, left + most, "right") - 1, np.repeat(last, size))
    cost, following = np.zeros(len(far), np.int64), np.zeros(len(far), np.int64)
    final = np.zeros(len(far), bool)
    final[last] = True
    start, low = first, last
    while len(start):
        low, before = np.maximum(start, np.searchsorted(far, low)), low
        i, to = _ranges(low, before - low), np.repeat(before, before - low)
        options = far[i] - to + 1
        nth = _ranges(np.zeros(len(i), np.int64), options)
        j = np.repeat(to, options) + nth
        rest = most - np.maximum(0, right[j] - np.repeat(left[i], options))
        ragged = cost[j] + np.where(final[j], 0, rest * rest)
        best = np.minimum.reduceat(ragged << 20 | nth, np.cumsum(options) - options)  # the first of equal ones
        cost[i], following[i] = best >> 20, to + (best & (1 << 20) - 1)
        start, low = start[low > start], low[low > start]
    now, parts = first, []
    own = np.arange(len(first))
    while len(own):
        parts.append((own, now, following[now]))
        now = following[now]
        own, now = own[now < last[own]], now[now < last[own]]
    if parts:
        own, i, j = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(i)
        pieces = [text[x:y] for x, y in zip(opening[i[by]].tolist(), closing[j[by]].tolist())]
        ended = np.cumsum(np.bincount(own)).tolist()
        for k, x, y in zip(line.tolist(), [0, *ended], ended):
            out[k] = "\n".join(pieces[x:y])
    return out


def wrap_texts(texts: list[str], most: int) -> list[str]:
    """The texts with each line wrapped to `most` columns."""
    out, held, size = [], [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= SLICE or i == len(texts) - 1:
            lines, at = wrap_lines("\n".join(held), most), 0
            for x in held:
                n = x.count("\n") + 1
                out.append("\n".join(lines[at : at + n]))
                at += n
            held, size = [], 0
    return out


def wrap(text: str, most: int) -> str:
    return wrap_texts([text], most)[0]


def open_pairs(lines: list[str]) -> list[int]:
    """How many brackets and quotes are still open after each line."""
    stack: list[str] = []
    closers = set(PAIRS.values())
    out = []
    for line in lines:
        for c in line:
            if c in PAIRS:
                stack.append(PAIRS[c])
            elif c in closers and stack and stack[-1] == c:
                stack.pop()
        out.append(len(stack))
    return out


def forced_matches(source: list[int], target: list[int]) -> list[tuple[int, int]]:
    """The pairs of places that are in every longest common subsequence of two family sequences."""
    n, m = len(source), len(target)
    pre = [[0] * (m + 1) for _ in range(n + 1)]
    suf = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            pre[i + 1][j + 1] = pre[i][j] + 1 if source[i] == target[j] else max(pre[i][j + 1], pre[i + 1][j])
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            suf[i][j] = suf[i + 1][j + 1] + 1 if source[i] == target[j] else max(suf[i + 1][j], suf[i][j + 1])
    by_rank: dict[int, list[tuple[int, int]]] = {}
    for i in range(n):
        for j in range(m):
            if source[i] == target[j] and pre[i][j] + 1 + suf[i + 1][j + 1] == pre[n][m]:
                by_rank.setdefault(pre[i][j], []).append((i, j))
    return [p[0] for _, p in sorted(by_rank.items()) if len(p) == 1]


def repair_punctuation(source: str, target: str) -> str:
    """The target with the source's form of every mark whose counterpart is forced. A second run changes nothing."""
    s = [(i, FAMILY[c]) for i, c in enumerate(source) if c in FAMILY]
    t = [(i, FAMILY[c]) for i, c in enumerate(target) if c in FAMILY]
    out = list(target)
    for a, b in forced_matches([f for _, f in s], [f for _, f in t]):
        out[t[b][0]] = source[s[a][0]]
    return "".join(out)


@lru_cache(maxsize=8)
def wrap_to(most: int):
    """A UDF that wraps each line of a text to `most` columns."""

    @arrow_udf("string")
    def wrapped(texts: pd.Series) -> pd.Series:
        some = texts.notna()
        out = pd.Series(None, index=texts.index, dtype=object)
        out[some] = wrap_texts(texts[some].tolist(), most)
        return out

    return wrapped


@arrow_udf("string")
def repaired_punctuation(sources: pd.Series, targets: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or t is None else repair_punctuation(s, t) for s, t in zip(sources, targets)], dtype=object)


@arrow_udf("array<int>")
def open_after_lines(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else open_pairs(t.split("\n")))
