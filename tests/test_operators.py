import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import claims, dedup, manual, order, packing, relations, rules, snapshots, units, validate
from glyphmill.plans import sqlapi
from glyphmill.sources import documents, jsonl, resources, sinks
from glyphmill.streaming import ordered


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_packing(spark):
    shell = packing.SHELL
    g = spark.createDataFrame([("a", 0, 10), ("a", 1, 10), ("a", 2, 500), ("a", 3, 5), ("b", 0, 10)], "s string, o long, n long")
    out = packing.pack_blocks(g, "s", "o", "n", shell + 21)
    assert rows(out, "s", "o", "block_id") == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 0, 0)]
    assert rows(packing.pack_blocks(g, "s", "o", "n", shell + 20), "s", "o", "block_id")[1] == ("a", 1, 1)


def test_dedup(spark):
    u = spark.createDataFrame([("f", 1, None), ("f", 2, "x"), ("f", 3, None), ("g", 4, None), ("h", 5, "x"), ("h", 6, "y"), ("h", 7, None)], "family string, o long, body string")
    out = {r.family: r.outcome for r in dedup.outcomes(u, "family", "o", "body").collect()}
    assert out == {"f": "reuse", "g": "request", "h": "request"}
    got = {r.o: r.answer for r in dedup.propagate(u, "family", "o", "body").collect()}
    assert got == {1: "x", 2: "x", 3: "x", 4: None, 5: "x", 6: "y", 7: None}


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", "A"), (2, "b", "B"), (3, "c", None)], "id int, text string, body string")
    new = spark.createDataFrame([(1, "a"), (2, "bb"), (4, "d")], "id int, text string")
    assert rows(snapshots.reconcile(old, new, ["id"], "text", "body"), "id", "change") == [(1, "kept"), (2, "changed"), (3, "removed"), (4, "added")]
    p = spark.createDataFrame([(1, "A", "new"), (2, "old", "new"), (3, None, "new")], "id int, expected string, proposed string")
    got = snapshots.compare_and_swap(old, p, ["id"], "body", "expected", "proposed")
    assert rows(got, "id", "outcome") == [(1, "applied"), (2, "conflict"), (3, "applied")]


def test_validate(spark):
    df = spark.createDataFrame(
        [(["a"], ["b"]), (["a"], ["b", "c"]), (["a"], ["b\r"]), (["a", ""], ["b", "x"]), ([""], [" "]), (["a"], ["﻿b"])], "s array<string>, t array<string>"
    )
    assert [r[0] for r in df.select(validate.violation(F.col("s"), F.col("t"))).collect()] == [None, "line_count", "line_character", "blank_slot", "blank_body", "byte_order_mark"]
    e = spark.createDataFrame([("0",), ("1",), ("2",)], "id string")
    a = spark.createDataFrame([("0",), ("1",), ("1",), ("01",), ("9",)], "id string")
    assert rows(validate.bind(e, a, "id"), "id", "outcome") == [("0", "bound"), ("01", "invalid_id"), ("1", "duplicate_id"), ("2", "missing_id"), ("9", "unexpected_id")]


def test_claims(spark):
    p = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["a", "d"])], "o int, steps array<string>")
    c = claims.derive(p, "o", "steps")
    assert rows(claims.conflicts(c, "resource", "o", "access"), "resource", "a", "b") == [("a/b", 1, 2)]


def test_rules(spark):
    d = spark.createDataFrame([(1, '{"a":[{"b":"x"},null,{"b":"y"}],"s":"{\\"k\\":[1,2]}","q r":{"z":"w"}}')], "id int, body string")
    assert rows(rules.extract(d, ["id"], "body", "a[].b"), "at", "value") == [([0], "x"), ([2], "y")]
    assert rows(rules.extract(d, ["id"], "body", "s.k[1]"), "value") == [("2",)]
    assert rows(rules.extract(d, ["id"], "body", '["q r"].z'), "value") == [("w",)]
    assert rules.extract(d, ["id"], "body", "a[9].b").count() == 0
    with pytest.raises(ValueError):
        rules.compile_path("a..b")


def test_events(spark):
    body = '[{"code":101,"indent":0,"parameters":[""]},{"code":401,"indent":0,"parameters":["one"]},{"code":401,"indent":0,"parameters":["two"]},{"code":102,"indent":0,"parameters":["[\\"y\\",\\"n\\"]"]},{"code":402,"indent":0,"parameters":["0"]},{"code":402,"indent":0,"parameters":["1"]},{"code":404,"indent":0,"parameters":[]},{"code":105,"indent":0,"parameters":[]},{"code":405,"indent":0,"parameters":["s"]},{"code":320,"indent":0,"parameters":["1","Ann"]}]'
    c = documents.commands(spark.createDataFrame([(1, body)], "id int, body string"), ["id"], "body")
    assert rows(documents.event_blocks(c, ["id"]), "kind", "lines") == [("dialogue", ["one", "two"]), ("scrolling", ["s"])]
    r = documents.choices(c, ["id"]).first()
    assert r.options == ["y", "n"] and r.branches == 2 and r.closed
    assert rows(documents.renames(c, ["id"]), "text") == [("Ann",)]
    assert list(documents.string_leaves({"a": ["x", {"b": '{"c": "y"}'}]})) == [("$.a[0]", "x"), ("$.a[1].b|json.c", "y")]
    assert [x[2] for x in documents.script_literals("let a = 'x'; // 'no'\nb = /'q'/; c = `t`")] == ["x", "t"]


def test_jsonl(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    good = '{"id":"g1","kind":"k","units":[{"id":"u1","text":"a"},{"id":"u2","text":"b"}]}'
    (root / "a.jsonl").write_text(good + "\n")
    (root / "sub" / "b.jsonl").write_bytes(good.replace("g1", "g2").encode() + b"\r\n")
    (root / "skip.JSONL").write_text("no")
    groups = jsonl.read_groups(spark, str(root))
    assert rows(groups, "path", "id") == [("a.jsonl", "g1"), ("sub/b.jsonl", "g2")]
    assert jsonl.units(groups).count() == 4 and jsonl.repeated_groups(groups).count() == 0
    bad = [
        ("", "blank_line"), ("{", "malformed_json"), ('{"id":"a","id":"b","kind":"k","units":[]}', None), ('{"id":"a","kind":"k"}', "wrong_keys"),
        ('{"id":"a","kind":"k","units":[{"id":"u"}]}', "wrong_unit_keys"), ('{"id":"a","kind":"k","units":[]}', "empty_value"),
        ('{"id":"a","kind":"k","units":[{"id":"u","text":"x"},{"id":"u","text":"y"}]}', "duplicate_unit"), ('{"id":"a","kind":"k","units":[{"id":"u","text":"x\\r"}]}', "control_character"),
    ]
    got = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(bad)], "i int, value string").select("i", jsonl.line_error(F.col("value")).alias("e")).sort("i").collect()
    for r, (_, e) in zip(got, bad):
        assert r.e == e if e else r.e is not None
    jsonl.write_groups(groups, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("path = 'a.jsonl'").first().value == good


def test_resources(spark):
    assert resources.parse('[[term]]\nterm = "a"\ntranslation = "b"', "term") == [{"term": "a", "translation": "b"}]
    for bad in ('[[term]]\nterm = "a"', '[[term]]\nterm = "a"\ntranslation = 1', "[[x]]\na = 1", '[[term]]\nterm = "a"\ntranslation = "b"\nz = 1'):
        with pytest.raises(resources.ResourceError):
            resources.parse(bad, "term")
    assert resources.resource(spark, '[[layout]]\nmax_width = 3\nkinds = ["a"]', "layout").first().kinds == ["a"]


def test_sinks(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    sinks.publish(spark.range(3), root)
    first = sinks.read_published(spark, root)
    sinks.publish(spark.range(5), root)
    assert first.count() == 3 and sinks.read_published(spark, root).count() == 5
    log = sinks.RunLog(str(tmp_path / "log.jsonl"), "r")
    log.write("start")
    log.write("end", terminal=True)
    with pytest.raises(ValueError):
        log.write("late")


def test_order(spark):
    df = spark.createDataFrame([("s", k) for k in (5, 1, 200000, 70000)] + [("t", 9)], "s string, k long")
    assert rows(order.dense_ordinals(df, ["s"], "k", "o"), "s", "k", "o") == [("s", 1, 0), ("s", 5, 1), ("s", 70000, 2), ("s", 200000, 3), ("t", 9, 0)]


def test_similar_pairs(spark, monkeypatch):
    """Against brute force, with tokens in more than 1000 items, equal sets, repeated keys and nulls."""
    r = random.Random(4)
    own = [(k, [r.choice("abcdefgh") for _ in range(r.randint(0, 5))]) for k in range(300)] + [(7, ["a", "b", None]), (301, None), (None, ["a", "b"])]
    sets = {}
    for k, ts in own:
        if k is not None:
            sets.setdefault(k, set()).update(t for t in ts or [] if t)
    d = spark.createDataFrame(own, "k long, ts array<string>")
    for part in (relations.PART, 20):
        monkeypatch.setattr(relations, "PART", part)
        for least in (1, 2, 3):
            expected = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least)
            assert rows(relations.similar_pairs(d, "k", F.col("ts"), least), "a", "b", "shared") == expected
    many = spark.range(1100).select(F.col("id").alias("k"), F.array(F.lit("x"), F.lit("y"), F.concat(F.lit("u"), F.col("id").cast("string"))).alias("ts"))
    assert relations.similar_pairs(many, "k", F.col("ts")).count() == 1100 * 1099 // 2


def test_similar_pairs_folded(spark, monkeypatch):
    """Classes of many parts against brute force; pairs of members are written out after the last join, not by it."""
    sets = {f"k{k}": {"x", "y", "z"} if k % 3 else {"x", "y", str(k % 2)} for k in range(90)} | {"own": {"x", "y"}, "none": {"z", "w"}}
    d = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k string, ts array<string>")
    expected = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2)
    for folded in (1, 7, 128):
        monkeypatch.setattr(relations, "FOLDED", folded, raising=False)
        out = relations.similar_pairs(d, "k", F.col("ts"))
        assert rows(out, "a", "b", "shared") == expected
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert max(plan.find("Generate explode(ka"), plan.find("Generate explode(kb")) in range(plan.index("Join "))


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (9, 8), (8, 7), (7, 6)], "a long, b long")
    assert {r.id: r.component for r in relations.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}


def test_manual(spark):
    u = spark.createDataFrame([("a", "free", ["x"])], "id string, type string, lines array<string>")
    a = spark.createDataFrame([("a", "free", ["x"], ["y"]), ("b", "free", ["x"], ["y"])], "id string, type string, source array<string>, translation array<string>")
    assert rows(manual.check(a, u), "id", "problem") == [("b", "unknown_id")]
    w = spark.createDataFrame([("はい！", "yes!"), ("a", None)], "s string, t string")
    assert rows(manual.write_back(w, "s", "t"), "outcome", "final") == [("adjusted", "yes！"), ("retained", "a")]


def test_sql(spark):
    assert sqlapi.query(spark, "select 1 as a").first().a == 1
    for bad in ("create table t (a int)", "drop table t", "insert into t select 1", "set a=b"):
        with pytest.raises(sqlapi.NotAQuery):
            sqlapi.query(spark, bad)


def test_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, i) for i in range(2)], "f long, i long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = ordered.finalize_in_order(spark, f"{tmp_path}/in", "f long, i long", f"{tmp_path}/out", f"{tmp_path}/check", lambda b: b.where("i = 1"))
    q.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 3 and got.select("batch").distinct().count() == 3


def test_units(spark):
    d = spark.createDataFrame([("s", 3, "a\nb"), ("s", 1, "c"), ("s", 2, None)], "source string, doc_id long, text string")
    got = units.units_of(d.where("text is not null"), "source", "doc_id", "text")
    assert rows(got, "natural_id", "text") == [("s:line1:unit1", "c"), ("s:line2:unit1", "a"), ("s:line2:unit2", "b")]


def test_claims_apart(spark):
    """Steps that hold the separator are not the paths that they look like."""
    p = spark.createDataFrame([(1, ["a/b"]), (2, ["a", "b"]), (3, ["a~1b"])], "o int, steps array<string>")
    whole = {r.o: r.resource for r in claims.derive(p, "o", "steps").where("access = 'exclusive'").collect()}
    assert len(set(whole.values())) == 3


def test_jsonl_blank_last_line(spark, tmp_path):
    from glyphmill.sources import jsonl

    (tmp_path / "x.jsonl").write_bytes(b"1\r\n\r\n")
    assert [r.value for r in jsonl.read_lines(spark, str(tmp_path)).orderBy("line").collect()] == ["1", ""]
