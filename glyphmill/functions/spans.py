"""Span work that needs exact places: several placeholder rules at once, control codes, binding of raw literals. Arrow UDFs."""


import pandas as pd
import regex
from glyphmill.functions.placeholder import CLOSE, OPEN
from glyphmill.functions.udfs import arrow_udf

#: An escape is the odd one of a run of backslashes, then a letter code with or without an argument, or a mark.
CONTROL_CODE = regex.compile(r"(?<!\\)(?:\\\\)*(\\(?:[A-Za-z]{1,2}\[[^\]\n]*\]|[A-Za-z]{1,2}|[.|!><^$\{\}]))")


class SpanError(ValueError):
    pass


def control_codes(text: str) -> list[tuple[int, int]]:
    return [m.span(1) for m in CONTROL_CODE.finditer(text)]


def protect(text: str, rules: list[str]) -> tuple[str, list[str]]:
    """The text with the spans of all rules as numbered tokens, and the originals.

    A rule with a group `text` wraps: what comes before and after the group is protected, the group stays.
    Reserved envelopes in the text, empty matches, overlaps and spans over line ends are errors.
    """
    if OPEN in text:
        raise SpanError("reserved_token")
    spans = []
    for pattern in rules:
        for m in regex.finditer(pattern, text):
            if m.start() == m.end():
                raise SpanError("empty_match")
            if "text" in m.re.groupindex and m.start("text") >= 0:
                spans += [s for s in ((m.start(), m.start("text")), (m.end("text"), m.end())) if s[0] < s[1]]
            else:
                spans.append(m.span())
    spans.sort()
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
        raise SpanError("overlap")
    if any("\n" in text[a:b] for a, b in spans):
        raise SpanError("line_end_in_span")
    out, at = [], 0
    for k, (a, b) in enumerate(spans):
        out += [text[at:a], f"{OPEN}{k:04d}{CLOSE}"]
        at = b
    return "".join([*out, text[at:]]), [text[a:b] for a, b in spans]


def bind_literals(target: str, originals: list[str]) -> str:
    """Raw originals in a target replaced by the tokens it lacks, where their number leaves no choice.

    Originals that are parts of others wait until those are settled; what stays open is an error.
    """
    missing: dict[str, list[str]] = {}
    for k, o in enumerate(originals):
        if f"{OPEN}{k:04d}{CLOSE}" not in target:
            missing.setdefault(o, []).append(f"{OPEN}{k:04d}{CLOSE}")
    while missing:
        done = False
        for o in sorted(missing, key=len, reverse=True):
            parts = regex.split(f"({OPEN}[0-9]{{4}}{CLOSE})", target)
            places = sum(p.count(o) for p in parts[::2])
            if places == len(missing[o]):
                tokens = iter(missing.pop(o))
                for i in range(0, len(parts), 2):
                    pieces = parts[i].split(o)
                    parts[i] = pieces[0] + "".join(next(tokens) + x for x in pieces[1:])
                target, done = "".join(parts), True
                break
        if not done:
            raise SpanError("ambiguous_literal" if any(o in target for o in missing) else "missing_token")
    return target


def protect_with(rules: list[str]):
    """A UDF: struct(text, originals, error)."""

    @arrow_udf("text string, originals array<string>, error string")
    def protected(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((*protect(t, rules), None) if t is not None else (None, None, None))
            except SpanError as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["text", "originals", "error"])

    return protected


@arrow_udf("array<string>")
def control_code_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [t[a:b] for a, b in control_codes(t)])
