"""Column builders for text: blanks, sizes, widths, scripts, cues and canonical forms. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space without U+000C, which counts as content.
BLANK = r"[\x{9}-\x{b}\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Code points that take two columns.
WIDE = r"[\x{1100}-\x{115f}\x{2e80}-\x{303e}\x{3041}-\x{a4cf}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe30}-\x{fe6f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}]"
#: Kana of runs that are looked for in translations.
KANA = r"\x{3041}-\x{3096}\x{309d}-\x{309f}\x{30a1}-\x{30fa}\x{30fd}-\x{30ff}\x{ff66}-\x{ff9d}"
#: The code points that make a Japanese source, kana letters first.
JAPANESE = (
    r"\x{3041}-\x{3096}\x{309f}\x{30a1}-\x{30fa}\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff6f}\x{ff71}-\x{ff9d}"
    r"\x{3007}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2ee5f}\x{2f800}-\x{2fa1f}\x{30000}-\x{323af}"
)
FULLWIDTH = "，。！？：；（）【】「」"
HALFWIDTH = ",.!?:;()[]\"\""


def lines(text: Column) -> Column:
    """The text's lines, split at LF, empty ones kept."""
    return F.split(text, "\n", -1)


def join_lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def is_blank(text: Column) -> Column:
    return text.rlike(f"^{BLANK}*$")


def quoted_size(text: Column) -> Column:
    """Characters of the text as a compact JSON string, the quotes included."""
    short = F.regexp_count(text, F.lit(r'["\\\x08\x0c\n\r\t]'))
    other = F.regexp_count(text, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]"))
    return 2 + F.length(text) + short + 5 * other


def display_width(text: Column) -> Column:
    """Columns a text takes: wide characters two, control characters none."""
    return F.length(text) + F.regexp_count(text, F.lit(WIDE)) - F.regexp_count(text, F.lit(r"[\x00-\x1f\x7f]"))


def needs_japanese(text: Column) -> Column:
    return text.rlike(f"[{JAPANESE}]")


def needs_english(text: Column, words: int = 2, letters: int = 6) -> Column:
    """Whether a run of Latin words joined by single spaces reaches both thresholds."""
    # Possessive, as Java would otherwise recurse for every word of a run.
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z']++(?: [A-Za-z']++)*+)"), F.lit(1))
    return F.exists(runs, lambda r: (F.size(F.split(r, " ")) >= words) & (F.length(F.regexp_replace(r, "[^A-Za-z]", "")) >= letters))


def kana_residual(text: Column, allowed: list[str], least: int) -> Column:
    """The first run of at least `least` kana once allowed terms are masked; null if there is none."""
    masked = text
    for term in sorted(allowed, key=len, reverse=True):
        masked = F.replace(masked, F.lit(term), F.lit(" " * len(term)))
    return F.nullif(F.regexp_extract(masked, f"([{KANA}]{{{least},}})", 1), F.lit(""))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+)"), F.lit(1))


def word_grams(words: Column, n: int) -> Column:
    """The runs of n words. The list is bound to a lambda's variable, or it would be computed anew for every run."""

    def runs(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.get(F.transform(F.array(words), runs), F.lit(0))


def copied_fragment(source: Column, target: Column, n: int) -> Column:
    """The first n-word run of the source that the target holds too; null if there is none."""
    shared = F.array_intersect(word_grams(word_list(source), n), word_grams(word_list(target), n))
    return F.get(shared, F.lit(0))


def mask_term(text: Column, term: str) -> Column:
    """The term masked where no letter touches it, without regard to ASCII case."""
    return F.regexp_replace(text, f"(?i)(?<![a-z]){term}(?![a-z])", "\u2588" * len(term))


def letters_and_digits(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def script_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\p{IsHan}{2,}|[\p{IsHiragana}\p{IsKatakana}]{2,}|\p{IsLatin}{3,}|\p{IsCyrillic}{3,}|\p{IsGreek}{3,})"), F.lit(1))


def visible(text: Column) -> Column:
    """The text without control shapes such as \\C[1], %1 and {name}."""
    return F.regexp_replace(text, r"\\[A-Za-z]+\[[0-9]*\]|%[0-9]+|\{[A-Za-z_]+\}", "")


def control_shapes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\\[A-Za-z]+\[[0-9]*\]|%[0-9]+|\{[A-Za-z_]+\})"), F.lit(1))


def is_explanation(text: Column) -> Column:
    return text.rlike(r"(?i)^[ \t]*(translation|note|explanation|answer)[ \t]*:")


def sanitized(text: Column) -> Column:
    """One output line: control and bidirectional format characters become spaces."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]", " ")


def is_canonical_id(text: Column) -> Column:
    return text.rlike(r"^(0|[1-9][0-9]*)$")


def language_id(tag: Column) -> Column:
    """Canonical case of a language tag: language lower, script title, region upper."""
    parts = F.split(F.replace(tag, F.lit("_"), F.lit("-")), "-")
    fixed = F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 4, F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 3)))).when(F.length(p) == 2, F.upper(p)).otherwise(F.lower(p)))
    return F.array_join(fixed, "-")


def plain_punctuation(text: Column) -> Column:
    return F.translate(text, FULLWIDTH, HALFWIDTH)


def player_text(text: Column) -> Column:
    return (F.trim(text) != "") & text.rlike(r"\p{L}")


def readable_key(key: Column) -> Column:
    """A key of a readable id: plain keys as they are, others quoted as JSON strings."""
    return F.when(key.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), key).otherwise(F.concat(F.lit('"'), F.regexp_replace(key, r'(["\\])', r"\\$1"), F.lit('"')))


def wrapper(text: Column) -> Column:
    """The name of a tag that wraps the whole text; empty if none does."""
    return F.regexp_extract(text, r"(?s)^<([a-z]+)>.*</\1>$", 1)


def domain_tokens(value: Column) -> Column:
    """The parts of a value listed with the first of , ; | that it holds, lower-cased, each once; nothing unless all 2 or more are plain and of 80 characters at most."""

    def parts(v: Column) -> Column:
        mark = F.when(F.contains(v, F.lit(",")), ",").when(F.contains(v, F.lit(";")), ";").when(F.contains(v, F.lit("|")), "|")
        items = F.transform(F.call_function("split", v, F.concat(F.lit("["), mark, F.lit("]")), F.lit(-1)), lambda p: F.trim(p))
        plain = F.forall(items, lambda p: p.rlike(r"\A[^,;|\r\n]{1,80}\z"))
        return F.when(mark.isNotNull() & plain, F.array_distinct(F.transform(items, F.lower)))

    return F.coalesce(F.get(F.transform(F.array(F.trim(value)), parts), F.lit(0)), F.array().cast("array<string>"))


def reference_tokens(value: Column) -> Column:
    """A value of 80 characters at most, and what it holds in brackets at its head, lower-cased."""
    v = F.trim(value)
    own = F.when((F.length(v) > 0) & (F.length(v) <= 80), F.lower(v))
    head = F.nullif(F.lower(F.trim(F.regexp_extract(v, r"\A\[([^\]\r\n]{1,80})\]", 1))), F.lit(""))
    return F.array_distinct(F.filter(F.array(own, head), lambda x: x.isNotNull()))
