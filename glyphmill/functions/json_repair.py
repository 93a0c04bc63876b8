"""Repair of near-JSON, as an Arrow UDF over a recursive reader.

Repaired: fences around the value, byte order marks and comments, single and curly quotes, bare keys and
values, missing colons, commas and closers, stray commas and colons, raw control characters, bad escapes.
Refused, with the name and place of the error: two candidates or roots, a missing value, a string that
isn't closed, two quoted values with only white space between, numbers that aren't JSON numbers.
"""


import json
import re

import pandas as pd
from glyphmill.functions.udfs import arrow_udf

FENCE = re.compile(r"```[a-zA-Z]*[ \t]*\r?\n(.*?)```", re.S)
NUMBER = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
DEEPEST = 500


class RepairError(ValueError):
    def __init__(self, kind: str, at: int):
        super().__init__(kind)
        self.kind, self.at = kind, at


class _Reader:
    def __init__(self, text: str):
        self.t, self.i = text, 0

    def peek(self) -> str:
        return self.t[self.i : self.i + 1]

    def skip(self) -> None:
        t, n = self.t, len(self.t)
        while self.i < n:
            if t[self.i].isspace() or t[self.i] == "﻿":
                self.i += 1
            elif t.startswith("//", self.i):
                end = t.find("\n", self.i)
                self.i = n if end < 0 else end
            elif t.startswith("/*", self.i):
                end = t.find("*/", self.i + 2)
                self.i = n if end < 0 else end + 2
            else:
                return

    def value(self, depth: int = 0) -> str:
        if depth > DEEPEST:
            raise RepairError("too_deep", self.i)
        self.skip()
        c = self.peek()
        if c == "{":
            return self.object(depth)
        if c == "[":
            return self.array(depth)
        if c in QUOTES and c:
            return self.string(False)
        if c in ("", ",", ":", "}", "]"):
            raise RepairError("missing_value", self.i)
        return self.bare()

    def object(self, depth: int) -> str:
        self.i += 1
        parts: list[str] = []
        while True:
            self.skip()
            c = self.peek()
            if c in (",", ":"):
                self.i += 1
                continue
            if c == "}":
                self.i += 1
                break
            if c in ("", "]"):  # the closer is missing
                break
            key = self.string(True) if c in QUOTES else self.bare_key()
            self.skip()
            if self.peek() == ":":
                self.i += 1
            elif self.peek() in ("", ",", "}", "]"):
                raise RepairError("missing_value", self.i)
            parts.append(f"{key}:{self.value(depth + 1)}")
        return "{" + ",".join(parts) + "}"

    def array(self, depth: int) -> str:
        self.i += 1
        parts: list[str] = []
        comma = True
        while True:
            self.skip()
            c = self.peek()
            if c == ",":
                if comma:
                    raise RepairError("missing_value", self.i)
                comma = True
                self.i += 1
                continue
            if c == "]":
                self.i += 1
                break
            if c in ("", "}"):
                break
            parts.append(self.value(depth + 1))
            comma = False
        return "[" + ",".join(parts) + "]"

    def closes(self, key: bool) -> bool:
        """Whether the quote before the reader's place ends a string, by what follows."""
        start = self.i
        self.skip()
        j, self.i = self.i, start
        c = self.t[j : j + 1]
        if key:
            return c == ":" or c in QUOTES
        if c in QUOTES and c:
            if j > self.i:
                raise RepairError("ambiguous_string_quote", j)
            return False
        return c in ("", ",", "}", "]") or (c in ("{", "[") and j > self.i)

    def string(self, key: bool) -> str:
        end = QUOTES[self.peek()]
        start = self.i
        self.i += 1
        out: list[str] = []
        while self.i < len(self.t):
            c = self.t[self.i]
            self.i += 1
            if c == "\\":
                e = self.t[self.i : self.i + 1]
                if e == "u" and re.match(r"[0-9a-fA-F]{4}", self.t[self.i + 1 : self.i + 5]):
                    pair = re.match(r"u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", self.t[self.i : self.i + 11])
                    code = self.t[self.i : self.i + (11 if pair else 5)]
                    if not pair and 0xD800 <= int(code[1:], 16) <= 0xDFFF:
                        raise RepairError("half_a_surrogate_pair", self.i)
                    out.append(json.loads(f'"\\{code}"'))
                    self.i += len(code)
                elif e and e in '"\\/bfnrt':
                    out.append(json.loads(f'"\\{e}"'))
                    self.i += 1
                elif e == "'":
                    out.append("'")
                    self.i += 1
                else:
                    out.append("\\")
            elif c == end and self.closes(key):
                return json.dumps("".join(out), ensure_ascii=False)
            else:
                out.append(c)
        raise RepairError("unterminated_string", start)

    def bare_key(self) -> str:
        start = self.i
        while self.peek() and self.peek() not in ':,{}[]"' and not self.peek().isspace():
            self.i += 1
        if self.i == start:
            raise RepairError("invalid_key", start)
        return json.dumps(self.t[start : self.i], ensure_ascii=False)

    def bare(self) -> str:
        start = self.i
        while self.peek() and self.peek() not in ",:{}[]" and not self.peek().isspace():
            self.i += 1
        word = self.t[start : self.i]
        if word in ("true", "false", "null") or NUMBER.match(word):
            return word
        if re.match(r"[-+.]?[0-9]", word):
            raise RepairError("invalid_number", start)
        return json.dumps(word, ensure_ascii=False)


def repair(text: str) -> str:
    """The text as compact JSON, or RepairError."""
    fenced = FENCE.findall(text)
    if len(fenced) > 1:
        raise RepairError("multiple_json_candidates", 0)
    body = fenced[0] if fenced else text
    reader = _Reader(body)
    reader.skip()
    if not reader.peek():
        raise RepairError("no_json", reader.i)
    out = reader.value()
    reader.skip()
    if reader.peek():
        raise RepairError("multiple_root_values", reader.i)
    json.loads(out)
    return out


@arrow_udf("json string, error string, at int")
def repair_json(texts: pd.Series) -> pd.DataFrame:
    """Struct of the repaired JSON, or the error's name and place; null in, nulls out."""
    rows = []
    for t in texts:
        if t is None:
            rows.append((None, None, None))
            continue
        try:
            rows.append((repair(t), None, None))
        except RepairError as e:
            rows.append((None, e.kind, e.at))
    return pd.DataFrame(rows, columns=["json", "error", "at"]).astype({"at": "Int32"})
