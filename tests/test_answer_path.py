"""The answer path, exports, write-back and the helpers that no query runs, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import profiles
from glyphmill.functions.languages import Language, language, register
from glyphmill.operators import answers, layout_rules, manual, rules, runlog, snapshots
from glyphmill.sources import documents as D
from glyphmill.sources import exports, rewrite, sinks


def listed(*a, **k):
    return [tuple(x) for x in answers.entries(*a, **k)]


def test_entries():
    assert listed('{"0": ["a"], "0": ["b", ""]}') == [(0, "0", ["a"], None, None), (1, "0", ["b", ""], None, None)]
    assert listed('{"0": ["a"],}') == [(0, "0", ["a"], None, None)]  # repaired
    assert listed('{"0": "a", "1": [1], "2": {"x": []}}') == [(i, str(i), None, None, "wrong_value") for i in range(3)]
    assert listed(None) == [(None, None, None, None, "no_answer")] and listed("[1]") == [(None, None, None, None, "wrong_shape")]
    assert listed("")[0][4] == "no_json" and listed("{}") == []


def test_thinking_and_echo():
    assert listed('{"think": "so", "translations": {"0": ["a"]}}', thinking=True) == [(0, "0", ["a"], None, None)]
    assert listed('{"think": " ", "translations": {}}', thinking=True)[0][4] == "empty_thinking"
    for bad in ('{"translations": {}}', '{"think": 1, "translations": {}}', '{"think": "x", "translations": []}', '{"think": "x", "think": "y", "translations": {}}'):
        assert listed(bad, thinking=True)[0][4] == "wrong_shape"
    assert listed('{"0": {"source": ["s"], "translation": ["t"]}, "1": {"translation": ["t"]}}', echo=True) == [(0, "0", ["t"], ["s"], None), (1, "1", None, None, "wrong_echo")]


@pytest.mark.parametrize(
    "text,inside",
    [("```json\n{}\n```", "{}"), (" \n```json \r\n{\n}\r\n  ```  \r\n\n", "{\n}\r"), ("```json\n{}\n``` x", None), ("```json\n{}", None), ("```\n{}\n```", None), ("```json\n{}\n```\n```json\n{}\n```", None), ("```json\n```", ""), ("", None), (None, None)],
)
def test_unfenced(spark, text, inside):
    got = spark.createDataFrame([(text,)], "t string").select(answers.unfenced(F.col("t")).alias("x")).first().x
    assert got == (text if inside is None else inside)


def test_settle(spark):
    asked = spark.createDataFrame([(1, "0", ["a"]), (1, "1", ["b"]), (1, "2", ["c"]), (2, "0", ["d"])], "k int, id string, s array<string>")
    text = '{"0": {"source": ["a"], "translation": ["A"]}, "1": {"source": ["x"], "translation": ["B"]}, "01": {"source": [], "translation": []}, "9": {"source": [], "translation": []}}'
    said = answers.read(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), ["k"], "t", echo=True)
    got = {(r.k, r.id): (r.outcome, r.reason) for r in answers.settle(asked, said, ["k"], "s").collect()}
    assert got == {(1, "0"): ("accepted", None), (1, "1"): ("rejected", "other_echo"), (1, "2"): ("missing", None), (1, "01"): ("invalid", None), (1, "9"): ("unexpected", None), (2, "0"): ("missing", None)}


def edit(steps, text=None, old=None, start=None, stop=None, commands=None):
    return {"steps": steps, "text": text, "old": old, "start": start, "stop": stop, "commands": commands}


def test_rewrite_values():
    body = json.dumps({"a": [{"b": "x"}], "n": json.dumps({"c": ["y", "z"], "d": 1})})
    out = rewrite.applied(rewrite.load(body), [edit(["a", "[0]", "b"], "X", "x"), edit(["n", "|json", "c", "[1]"], "Z"), edit(["n", "|json", "c", "[0]"], "Y")])
    assert json.loads(rewrite.dump(out)) == {"a": [{"b": "X"}], "n": '{"c":["Y","Z"],"d":1}'}
    exact = '{"a":1.50,"b":12345678901234567890123,"c":1e5,"d":null,"e":true}'
    assert rewrite.dump(rewrite.load(exact)) == exact


def test_rewrite_lists():
    items = list("abcdef")
    out = rewrite.applied(list(items), [edit([], start=4, stop=5, commands='["E","E2"]'), edit([], start=1, stop=3, commands="[]"), edit([], start=0, stop=0, commands='["0"]')])
    assert out == ["0", "a", "d", "E", "E2", "f"]


@pytest.mark.parametrize(
    "edits,error",
    [([edit(["x"], "t")], "no_such_place"), ([edit(["a", "[9]"], "t")], "no_such_place"), ([edit(["b"], "t", "other")], "source_changed"), ([edit(["n"], "t")], "not_a_text"), ([edit(["b", "|json", "c"], "t")], "not_nested_json"),
     ([edit(["b"], "t"), edit(["b"], "u")], "doubled_edit"), ([edit(["a"], start=0, stop=2, commands="[]"), edit(["a"], start=1, stop=2, commands="[]")], "overlapping_ranges"), ([edit(["a"], start=0, stop=9, commands="[]")], "no_such_range"), ([edit(["b"], start=0, stop=1, commands="[]")], "not_a_list")],
)
def test_rewrite_refuses(edits, error):
    with pytest.raises(rewrite.EditError, match=error):
        rewrite.applied(rewrite.load('{"a": ["x", "y"], "b": "s", "n": 1}'), edits)


def test_rewrite_keeps_others(spark):
    docs = spark.createDataFrame([(1, '{ "a" : "x" }'), (2, '{ "a" : "x" }'), (3, "no json"), (4, None)], "id int, body string")
    edits = spark.createDataFrame([(i, ["a"], None, "y", None, None, None) for i in (1, 3, 4)], "id int, steps array<string>, old string, text string, start int, stop int, commands string")
    got = {r.id: (r.body, r.error) for r in rewrite.rewrite(docs, "id", "body", edits).collect()}
    assert got == {1: ('{"a":"y"}', None), 2: ('{ "a" : "x" }', None), 3: ("no json", "malformed_json"), 4: (None, "malformed_json")}


def test_exports(spark, tmp_path):
    rows = [("a", ["x", ""], ["y"], "current", "manual", "free", "builtin", None, None), ("b", ["x"], None, "pending", "none", "fixed", "rules", 3, None), ("c", ["x"], None, "rejected", "automatic", "free", None, None, '["z"]')]
    units = spark.createDataFrame(rows, "manual_id string, source array<string>, translation array<string>, state string, origin string, type string, owner string, rule_number long, rejected_candidate_json string")
    exports.export_lines(units).select("value").write.text(f"{tmp_path}/e")
    assert sorted(tuple(r) for r in exports.read_export(spark, f"{tmp_path}/e").collect()) == rows
    line = exports.export_lines(units).where("manual_id = 'a'").first().value
    twice = exports.checked(spark.createDataFrame([(line,), (line,), ("",), ("[]",)], "value string")).collect()
    assert sorted(r.error for r in twice) == ["blank_line", "malformed_json", "repeated_id", "repeated_id"]
    spark.createDataFrame([('{"manual_id":"a"}',), ('{"manual_id":"a"}',)], "value string").write.text(f"{tmp_path}/i")
    assert [r.manual_id for r in exports.read_ids(spark, f"{tmp_path}/i").collect()] == ["a"]
    spark.createDataFrame([('{"manual_id":""}',)], "value string").write.text(f"{tmp_path}/j")
    with pytest.raises(Exception, match="bad id line"):
        exports.read_ids(spark, f"{tmp_path}/j").collect()


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    first = sinks.publish(df, f"{tmp_path}/p")
    second = sinks.publish(df.union(df), f"{tmp_path}/p")
    assert first != second == sinks.current(spark, f"{tmp_path}/p") and sinks.read_published(spark, f"{tmp_path}/p").count() == 6
    tables = {n: spark.createDataFrame([(n, "builtin"), (n, "rules")], "x string, owner string") for n in sinks.OWNED}
    sinks.publish_owned(tables, f"{tmp_path}/o")
    assert {n: t.count() for n, t in sinks.owned(spark, f"{tmp_path}/o", "rules").items()} == dict.fromkeys(sinks.OWNED, 1)
    sinks.append(df, f"{tmp_path}/a")
    sinks.append(df, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 6
    sinks.write_json_lines(df.withColumn("x", F.lit(None).cast("string")), f"{tmp_path}/l", ["id"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/l").sort("value").collect()] == [f'{{"id":{i}}}' for i in range(3)]


def test_set_answers(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, body string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, body string")
    got = snapshots.set_answers(table, new, ["id"], "body").sort("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "kept"), (2, None, "cleared"), (3, "c", "set")]
    with pytest.raises(Exception, match="no such unit: 9"):
        snapshots.set_answers(table, spark.createDataFrame([(9, "x")], "id int, body string"), ["id"], "body").collect()


def test_event_documents(spark, tmp_path):
    command = lambda text: {"code": 101, "indent": 0, "parameters": [text]}
    (tmp_path / "Troops.json").write_text(json.dumps([None, {"pages": [{"list": [command("t")]}]}]))
    (tmp_path / "CommonEvents.json").write_text(json.dumps([None, {"list": [command("c")]}]))
    (tmp_path / "Skills.json").write_text(json.dumps([None, {"name": "n", "message1": " ", "message2": "m"}]))
    docs = D.read_documents(spark, str(tmp_path))
    lists = lambda name, kind: [tuple(r)[1:] for r in D.commands(D.event_lists(docs.where(F.col("name") == name), ["name"], kind), ["name", "event", "page"], "list").collect()]
    assert lists("Troops.json", "troop") == [(1, 0, 0, 101, 0, ["t"])] and lists("CommonEvents.json", "common") == [(1, None, 0, 101, 0, ["c"])]
    found = D.database_fields(D.read_documents(spark, str(tmp_path), ["Skills.json"]), ["name", "message1", "message2"])
    assert sorted((r["index"], r.field, r.text) for r in found.collect()) == [(1, "message2", "m"), (1, "name", "n")]
    maps = spark.createDataFrame([(1, '{"displayName":"Town"}'), (2, '{"displayName":""}'), (3, "{}")], "id int, body string")
    assert [tuple(r) for r in D.map_names(maps, ["id"]).collect()] == [(1, "Town")]


def test_profiles_and_languages(spark):
    units = spark.createDataFrame([("States", "message4"), ("event_dialogue", "speaker"), ("System", "terms.params[3]"), ("System", "terms.messages.expNext"), (None, None)], "file string, field string")
    read = lambda engine: [(r.reader, r.arguments) for r in profiles.with_profile(units, engine, "file", "field").collect()]
    assert read("mv") == [("message", False), ("plain", False), ("extended", False), ("plain", True), ("plain", False)]
    assert read("mz")[:2] == [("message", True), ("extended", False)]
    with pytest.raises(ValueError):
        profiles.profiles(spark, "xp")
    assert language("ja-JP").id == "ja" and language("EN_us").id == "en"
    with pytest.raises(KeyError):
        language("fr")
    with pytest.raises(ValueError):
        register(Language("ja", None, None))


def test_rules_over_files(spark):
    files = spark.createDataFrame([("Map001.json",), ("Troops.json",), ("x.json",)], "file string")
    got = rules.route(files, "file", [{"code": 1}, {"file": "Map*.json"}, {"file": "x.json"}, {"plugin": "p"}]).collect()
    assert sorted(tuple(r) for r in got) == [("Map001.json", 0), ("Map001.json", 1), ("Troops.json", 0), ("x.json", 2)]
    found = spark.createDataFrame([("a", "v"), ("b", " ")], "rule string, value string")
    assert [r.rule for r in rules.unmatched(["a", "b", "c"], found, "rule").sort("rule").collect()] == ["b", "c"]
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "target int, rule string")
    assert [r.target for r in rules.doubled(twice, ["target"], "rule").collect()] == [1]


def test_manual_and_logs(spark, tmp_path):
    units = spark.createDataFrame([("a", "g", "pending"), ("b", "g", "rejected"), ("c", "h", "pending")], "id string, group_id string, status string")
    assert [r.id for r in manual.listing(units, ["pending"], ["a", "b"]).collect()] == ["a"]
    assert sorted((r.asked, r.id) for r in manual.context(units, ["c", "a"]).collect()) == [(0, "c"), (1, "a"), (1, "b")]
    assert sorted(json.loads(r.value)["id"] for r in manual.export_rows(units).collect()) == ["a", "b", "c"]
    totals = spark.createDataFrame([(3, 2, 1, 2, 0, 0, 0, 0), (3, 2, 2, 2, 0, 0, 0, 0)], "planned int, started int, not_started int, complete int, partial int, unavailable int, failed int, cancelled int")
    assert runlog.counters_agree(totals).count() == 1
    (tmp_path / "run.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00Z","sequence":1,"run_id":"r","level":"info","event":"e","payload":"{}"}\n')
    assert runlog.read(spark, str(tmp_path / "run.jsonl")).first().run_id == "r"
    rules_ = spark.createDataFrame([(0,), (1,)], "ord int")
    hits = spark.createDataFrame([("u", 0), ("u", 0)], "unit string, ord int")
    assert sorted(tuple(r) for r in layout_rules.problems(None, rules_, hits, "unit").collect()) == [("no_unit", "1"), ("two_rules", "u")]
    toml = spark.createDataFrame([("a", "free", ['x "q"', ""], None)], "id string, type string, source array<string>, translation array<string>")
    manual.manual_toml(toml, f"{tmp_path}/t")
    import tomllib

    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(f"{tmp_path}/t").collect())
    assert tomllib.loads(text)["translation"][0]["source"] == ['x "q"', ""]
