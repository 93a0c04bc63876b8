import json
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import json_repair, layout, placeholder, spans
from glyphmill.functions import text as T


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": [1, 2,]}\n```', {"a": [1, 2]}),
        ("{'a': 'b', c: true}", {"a": "b", "c": True}),
        ('{"a" "b" "c": 1}', None),
        ('{"a": "x" // note\n, /* more */ "b": 2', {"a": "x", "b": 2}),
        ('{"a": "line\nend\\q"}', {"a": "line\nend\\q"}),
        ('{"a": [1 2 3]}', {"a": [1, 2, 3]}),
        ("{“a”: “b”}", {"a": "b"}),
        ('{,"a":1,,}', {"a": 1}),
    ],
)
def test_json_repair(text, value):
    if value is None:
        with pytest.raises(json_repair.RepairError):
            json_repair.repair(text)
    else:
        assert json.loads(json_repair.repair(text)) == value


@pytest.mark.parametrize(
    ("text", "kind"),
    [("```\n1\n```\n```\n2\n```", "multiple_json_candidates"), ('{"a": }', "missing_value"), ("[1,,2]", "missing_value"), ('{"a": "b', "unterminated_string"), ("1 2", "multiple_root_values"), ("[01]", "invalid_number"), ("", "no_json"), ('["a" "b"]', "ambiguous_string_quote")],
)
def test_json_repair_refuses(text, kind):
    with pytest.raises(json_repair.RepairError) as e:
        json_repair.repair(text)
    assert e.value.kind == kind


def test_wrap():
    assert layout.wrap("short", 10) == "short"
    assert layout.wrap("one two three four", 9) == "one two\nthree\nfour" or max(map(len, layout.wrap("one two three four", 9).split("\n"))) <= 9
    assert layout.wrap("unbreakable", 4) == "unbreakable"
    assert layout.wrap("漢字漢字", 4) == "漢字\n漢字"


def wrapped_by_force(text, most):
    """The first of the best choices, from the end, over all places where the line may be broken."""
    width = lambda x: sum(map(layout.char_width, x))
    if width(text) <= most:
        return text
    wide = lambda c: layout.char_width(c) == 2
    safe = lambda a, b: b not in layout.AFTER and b != " " and (a == " " or a in layout.AFTER or (wide(a) and wide(b)))
    points = [0, *(i for i in range(1, len(text)) if safe(text[i - 1], text[i])), len(text)]
    best = {len(points) - 1: (0, 0, [])}
    for i in range(len(points) - 2, -1, -1):
        for j in range(i + 1, len(points)):
            part = text[points[i] : points[j]].strip(" ")
            if width(part) <= most and j in best:
                option = (best[j][0] + 1, best[j][1] + (0 if j == len(points) - 1 else (most - width(part)) ** 2), [part, *best[j][2]])
                if i not in best or option[:2] < best[i][:2]:
                    best[i] = option
    return "\n".join(best[0][2]) if 0 in best else text


def test_wrap_by_force(monkeypatch):
    r = random.Random(4)
    for n in range(400):
        monkeypatch.setattr(layout, "SLICE", r.choice([1, 20, 1 << 20]))
        texts = ["".join(r.choice("ab c  d,.! 漢字。「」(\t\r\x00é\n ") for _ in range(r.randint(0, 50))) for _ in range(4)]
        most = r.choice([1, 2, 3, 5, 8, 13])
        assert layout.wrap_texts(texts, most) == ["\n".join(wrapped_by_force(x, most) for x in t.split("\n")) for t in texts]


def test_wrap_looks_at_a_character_once(monkeypatch):
    asked, width = [], layout.char_width
    monkeypatch.setattr(layout, "char_width", lambda c: asked.append(c) or width(c))
    text = " ".join(["wort", "mot", "漢字"] * 3000)
    assert max(len(x) for x in layout.wrap(text, 60).split("\n")) <= 60
    assert len(asked) <= len(set(text))
    assert layout.open_pairs(["(a", "b)", "]"]) == [1, 0, 0]


def test_punctuation():
    assert layout.repair_punctuation("はい！", "yes!") == "yes！"
    # Two marks of one family in the target: neither is forced.
    assert layout.repair_punctuation("a！", "b! c!") == "b! c!"
    once = layout.repair_punctuation("「x」、y。", '"x", y.')
    assert layout.repair_punctuation("「x」、y。", once) == once


def test_spans():
    text, originals = spans.protect("<b>hi</b> %1", [r"<b>(?P<text>[^<]*)</b>", "%[0-9]"])
    assert originals == ["<b>", "</b>", "%1"] and "hi" in text
    for bad, rules in ((placeholder.OPEN, []), ("aab", ["a+", "ab"]), ("ab", ["x*"]), ("a\nb", ["a\nb"])):
        with pytest.raises(spans.SpanError):
            spans.protect(bad, rules)
    assert spans.bind_literals("%1 and %2", ["%1", "%2"]).count(placeholder.OPEN) == 2
    with pytest.raises(spans.SpanError):
        spans.bind_literals("%1 %1", ["%1"])
    assert spans.control_codes(r"\C[1]a\\n") == [(0, 5)]


def test_columns(spark):
    rows = [("a\tb",), ("　 ",), ("\x0c",), ("漢a",), ('q"\\\n\x01',), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(T.is_blank(F.col("t")).alias("blank"), T.display_width(F.col("t")).alias("w"), T.quoted_size(F.col("t")).alias("q")).collect()
    assert [r.blank for r in got] == [False, True, False, False, False, True]
    assert [r.w for r in got][3] == 3
    assert [r.q for r in got] == [len(json.dumps(t, ensure_ascii=False)) for (t,) in rows]
    res = spark.sql("select 'これはテスト' as t").select(T.kana_residual(F.col("t"), ["テスト"], 2).alias("a"), T.kana_residual(F.col("t"), ["これは", "テスト"], 2).alias("b")).first()
    assert res.a == "これは" and res.b is None


def test_placeholder_columns(spark):
    df = spark.createDataFrame([("x %1 y %2", ["a"])], "t string, u array<string>")
    r = df.select(placeholder.protect(F.col("t"), "%[0-9]").alias("p"), placeholder.spans(F.col("t"), "%[0-9]").alias("o"))
    r = r.select("p", placeholder.restore(F.col("p"), F.col("o")).alias("back"), placeholder.violation(F.col("p"), F.reverse(F.col("p")), True).alias("v"), placeholder.violation(F.col("p"), F.col("p"), True).alias("none")).first()
    assert r.back == "x %1 y %2" and r.v == "token_counts" and r.none is None


def test_json_repair_pairs():
    """Both halves of an escaped pair are read together, and a lone half is refused."""
    high, low = chr(92) + "ud83d", chr(92) + "ude00"
    assert json.loads(json_repair.repair("{a: '" + high + low + "'}")) == {"a": chr(0x1F600)}
    for half in (high, low, high + "x"):
        with pytest.raises(json_repair.RepairError):
            json_repair.repair("{a: '" + half + "'}")


def test_token_numbers_and_kana(spark):
    numbers = spark.createDataFrame([(9,), (1000,), (10000,), (10001,)], "n int").select(placeholder.token(F.col("n")).alias("t"))
    got = [r.t for r in numbers.collect()]
    assert len(set(got)) == 4 and numbers.where(placeholder.malformed(F.col("t"))).count() == 0
    chars = "〇ㇰ𠀋ｦｱｰゝヽー"
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", T.needs_japanese(F.col("c")).alias("x")).collect()
    assert "".join(r.c for r in rows if r.x) == "〇ㇰ𠀋ｦｱ"
