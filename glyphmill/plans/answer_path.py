"""Queries of the answer path: preparation, messages, answers, exports, routing and write-back. They join those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from glyphmill.functions import hashing, placeholder, profiles
from glyphmill.functions import text as T
from glyphmill.operators import answers, claims, prepare, rules, snapshots, terms, validate
from glyphmill.plans.catalog import BLANK_SQL, TERMS, Tables, _domain, _frame, _PAIRS, _pairs, query
from glyphmill.sources import documents as D
from glyphmill.sources import exports, rewrite

DIGITS = "[0-9]+"
_TOKEN = f"'{placeholder.OPEN}' || lpad(cast({{i}} as varchar), cast(greatest(4, length(cast({{i}} as varchar))) as int), '0') || '{placeholder.CLOSE}'"
_PARTS = f"(select doc_id, lang, text, string_split_regex(text, '{DIGITS}') as parts, regexp_extract_all(text, '{DIGITS}') as originals from documents)"
_PROTECTED = f"array_to_string(list_transform(parts, lambda p, i: case when i = 1 then p else {_TOKEN.format(i='(i - 2)')} || p end), '')"
_NATURAL = "array_to_string(list_filter(parts, lambda p: p <> ''), chr(10))"


# -- preparation


@query(f"""select doc_id, {_PROTECTED} as protected, len(originals) as n_tokens, {_NATURAL} as natural from {_PARTS}""")
def segments(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", placeholder.protect(F.col("text"), DIGITS).alias("protected"))
    opaque = F.filter(placeholder.segments(F.col("protected")), lambda s: s.opaque)
    return d.select("doc_id", "protected", F.size(opaque).cast("long").alias("n_tokens"), placeholder.natural_text(F.col("protected")).alias("natural"))


@query(f"""select doc_id, sha256(unhex({_domain('glyphmill/bindings')} || array_to_string(list_transform(originals, lambda o, i: {_frame(_TOKEN.format(i='(i - 1)'))} || {_frame('o')} || {_frame("'number'")} || {_frame('lang')} || {_frame("'preserve'")}
|| {_frame('cast((i - 1) // 2 as varchar)')}), ''))) as binding from {_PARTS}""")
def binding_fingerprints(t: Tables) -> DataFrame:
    """Two spans each make a wrapper, named by the document; the names leave no trace."""
    wrapper = lambda i: F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("-"), F.floor(i / 2).cast("string"))
    one = lambda o, i: F.struct(placeholder.token(i).alias("token"), o.alias("original"), F.lit("number").alias("label"), F.col("lang").alias("scope"), F.lit("preserve").alias("order"), wrapper(i).alias("wrapper"))
    return t.documents.select("doc_id", hashing.bindings_sha256(F.transform(placeholder.spans(F.col("text"), DIGITS), one)).alias("binding"))


_ALTERNATION = terms.alternation(TERMS)
_NEEDED = f"len(list_filter(regexp_extract_all({_NATURAL}, '([A-Za-z'']+(?: [A-Za-z'']+)*)', 1), lambda r: len(string_split(r, ' ')) >= 2 and length(regexp_replace(r, '[^A-Za-z]', '', 'g')) >= 6)) > 0"


@query(f"""select doc_id, md5({_PROTECTED}) as protected, len(originals) as n_originals, {_NEEDED} as needed, len(list_distinct(regexp_extract_all({_NATURAL}, '{_ALTERNATION}', 1))) as n_hits,
case when regexp_matches(text, '^({BLANK_SQL}|\\n)*$') then 'blank' when not {_NEEDED} then 'retained' else 'request' end as state from {_PARTS}""")
def prepared_units(t: Tables) -> DataFrame:
    p = prepare.prepare(t.documents, "text", "en", DIGITS, TERMS)
    return p.select("doc_id", F.md5("protected").alias("protected"), F.size("originals").cast("long").alias("n_originals"), "needed", F.size("hits").cast("long").alias("n_hits"), "state")


RULES = [{"pattern": "[0-9]+"}, {"pattern": "%[0-9]", "scopes": ["user"]}, {"pattern": "<[a-z]+>", "ids": ["1", "2", "30"]}, {"pattern": "x", "scopes": ["assistant", "system"], "ids": ["2", "4"]}]


@query("""select conv_id, turn, ord from conversations, (values (0, null, null), (1, ['user'], null), (2, null, ['1', '2', '30']), (3, ['assistant', 'system'], ['2', '4'])) r(ord, scopes, ids)
where (scopes is null or list_contains(scopes, role)) and (ids is null or list_contains(ids, cast(conv_id as varchar)))""")
def placeholder_rules(t: Tables) -> DataFrame:
    return prepare.applicable_rules(t.conversations, RULES, ["conv_id", "turn"], "conv_id", "role")


_READERS = "case file when 'States' then 'message' when 'Skills' then 'extended' when 'System' then case when field like 'terms.params%' then 'extended' when field = 'terms.messages.victory' then 'message' else 'plain' end else 'plain' end"


@query(f"""with u as (select p_partkey, case p_size % 4 when 0 then 'States' when 1 then 'Skills' when 2 then 'System' else 'Tilesets' end as file,
case p_size % 4 when 0 then 'message1' when 1 then 'message2' when 2 then case p_size % 3 when 0 then 'terms.params[' || p_size || ']' when 1 then 'terms.messages.victory' else 'gameTitle' end else 'name' end as field from part)
select p_partkey, {_READERS} as reader, file = 'States' or file = 'Skills' or field = 'terms.messages.victory' as arguments from u""")
def control_profiles(t: Tables) -> DataFrame:
    by = lambda m, *names: F.element_at(F.array(*names), (F.col("p_size") % m + 1).cast("int"))
    system = by(3, F.concat(F.lit("terms.params["), F.col("p_size").cast("string"), F.lit("]")), F.lit("terms.messages.victory"), F.lit("gameTitle"))
    u = t.part.select("p_partkey", by(4, *map(F.lit, ("States", "Skills", "System", "Tilesets"))).alias("file"), by(4, F.lit("message1"), F.lit("message2"), system, F.lit("name")).alias("field"))
    return profiles.with_profile(u, "mz", "file", "field").select("p_partkey", "reader", "arguments")


@query(f"""select conv_id, turn, sha256(unhex({_domain('glyphmill/game')} || {_frame("'ja'")} || {_frame("'en'")} || {_frame("'builtin'")} || {_frame('role')} || {_frame('cast(conv_id as varchar)')} || {_frame('role')} || {_frame("'free'")}
|| {_frame('text')} || {_frame("'[]'")} || {_frame('cast(turn as varchar)')})) as applicability from conversations""")
def game_applicability(t: Tables) -> DataFrame:
    s = lambda x: F.col(x).cast("string")
    f = hashing.game_applicability(F.lit("ja"), F.lit("en"), F.lit("builtin"), F.col("role"), s("conv_id"), F.col("role"), F.lit("free"), F.col("text"), F.lit("[]"), s("turn"))
    return t.conversations.select("conv_id", "turn", f.alias("applicability"))


@query("""with l as (select p_partkey, replace(p_name, ' ', case p_size % 3 when 0 then ', ' when 1 then ';' else ' ' end) as v, '[' || p_name || '] ' || p_type as r from part)
select p_partkey, case when contains(v, ',') then array_to_string(list_sort(list_distinct(string_split(lower(v), ', '))), '+') when contains(v, ';') then array_to_string(list_sort(list_distinct(string_split(lower(v), ';'))), '+') else '' end as domain,
array_to_string(list_sort([lower(r), lower(regexp_extract(r, '^\\[(.*?)\\]', 1))]), '+') as reference from l""")
def survey_tokens(t: Tables) -> DataFrame:
    mark = F.when(F.col("p_size") % 3 == 0, ", ").when(F.col("p_size") % 3 == 1, ";").otherwise(" ")
    joined = lambda c: F.array_join(F.array_sort(c), "+")
    p = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), mark).alias("v"), F.concat(F.lit("["), "p_name", F.lit("] "), "p_type").alias("r"))
    return p.select("p_partkey", joined(T.domain_tokens(F.col("v"))).alias("domain"), joined(T.reference_tokens(F.col("r"))).alias("reference"))


# -- messages and answers

_UNIT = """'        {' || chr(10) || case when role <> 'user' then '          "id": "' || (turn // 2) || '",' || chr(10) else '' end || '          "role": "' || role || '",' || chr(10) || case when role <> 'user' then '          "type": "free",' || chr(10) else '' end
|| '          "text": [' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda l: '            ' || cast(to_json(l) as varchar)), ',' || chr(10)) || chr(10) || '          ]' || chr(10) || '        }'"""


@query(f"""select conv_id, md5('```json' || chr(10) || '{{' || chr(10) || case when conv_id % 2 = 0 then '  "terminology": [' || chr(10) || '    {{' || chr(10) || '      "source": "the",' || chr(10) || '      "translation": "le"' || chr(10) || '    }}' || chr(10) || '  ],' || chr(10) else '' end
|| '  "groups": [' || chr(10) || '    {{' || chr(10) || '      "kind": "dialogue",' || chr(10) || '      "units": [' || chr(10) || string_agg({_UNIT}, ',' || chr(10) order by turn) || chr(10) || '      ]' || chr(10) || '    }}' || chr(10) || '  ]' || chr(10) || '}}' || chr(10) || '```') as message
from conversations group by conv_id""")
def user_messages(t: Tables) -> DataFrame:
    asked = F.col("role") != "user"
    unit = F.struct("turn", F.when(asked, F.floor(F.col("turn") / 2).cast("string")).alias("id"), "role", F.when(asked, "free").alias("type"), "text")
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    known = F.array(F.struct(F.lit("the").alias("source"), F.lit("le").alias("translation")))
    c = c.withColumn("terms", F.when(F.col("conv_id") % 2 == 0, known).otherwise(F.filter(known, lambda x: F.lit(False))))
    return c.select("conv_id", F.md5(answers.user_message(F.col("terms"), F.array(F.struct(F.lit("dialogue").alias("kind"), "units")))).alias("message"))


def _answers(t: Tables) -> DataFrame:
    """Conversations as answers: fenced, bare, near-JSON (a comma too many), and in a fence with text after it, which no reader takes off."""
    line = F.concat(F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('":')), F.to_json(F.split("text", "\n", -1)))
    c = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x.line), ",").alias("body"))
    body = F.concat(F.lit("{"), "body", F.when(F.col("conv_id") % 4 == 2, ",").otherwise(""), F.lit("}"))
    fenced = F.concat(F.lit(" \n```json \r\n"), body, F.lit("\n```\t\n\n"))
    return c.select("conv_id", F.when(F.col("conv_id") % 4 == 0, fenced).when(F.col("conv_id") % 4 == 3, F.concat(F.lit("```text\n"), body, F.lit("\n```"))).otherwise(body).alias("answer"), body.alias("inside"))


@query("select conv_id, true as taken from conversations group by conv_id")
def unfenced_answers(t: Tables) -> DataFrame:
    """A json fence is taken off, another one stays."""
    a = _answers(t)
    got = answers.unfenced(F.col("answer"))
    return a.select("conv_id", F.when(F.col("conv_id") % 4 == 3, got == F.col("answer")).otherwise(got == F.col("inside")).alias("taken"))


@query("select conv_id, cast(turn as varchar) as id, text, cast(null as varchar) as problem from conversations where conv_id % 4 <> 3")
def read_answers(t: Tables) -> DataFrame:
    """All answers whose fence is of another label are left to repair; what it makes of them isn't compared."""
    found = answers.read(_answers(t), ["conv_id"], "answer")
    return found.where("conv_id % 4 <> 3").select("conv_id", "id", F.array_join("lines", "\n").alias("text"), "problem")


_ENTRIES = f"(select conv_id, turn, s, t, case when turn % 10 = 2 then '0' || turn else cast(turn as varchar) end as aid from {_PAIRS})"


@query(f"""with a as {_ENTRIES}, e as (select conv_id, aid as id, string_split(t, chr(10)) as l from a where turn % 6 <> 4 union all select conv_id, aid, string_split(t, chr(10)) from a where conv_id % 5 = 0 and turn = 0),
r as (select conv_id, cast(turn as varchar) as id, string_split(s, chr(10)) as s from a), n as (select conv_id, id, count(*) as n, any_value(l) as l from e group by all),
j as (select conv_id, id, r.s, n.n, n.l, case when n.n is null then 'missing' when not regexp_matches(id, '^(0|[1-9][0-9]*)$') then 'invalid' when r.s is null then 'unexpected' when n.n > 1 then 'repeated' end as o,
case when len(r.s) <> len(n.l) then 'line_count' when len(list_filter(n.l, lambda x: contains(x, chr(13)))) > 0 then 'line_character' when len(list_filter(n.l, lambda x: contains(x, chr(65279)))) > 0 then 'byte_order_mark'
when len(list_filter(list_zip(r.s, n.l), lambda x: regexp_matches(x[1], '^{BLANK_SQL}*$') <> regexp_matches(x[2], '^{BLANK_SQL}*$'))) > 0 then 'blank_slot' when len(list_filter(n.l, lambda x: not regexp_matches(x, '^{BLANK_SQL}*$'))) = 0 then 'blank_body' end as v from r full join n using (conv_id, id))
select conv_id, id, coalesce(o, case when v is null then 'accepted' else 'rejected' end) as outcome, case when o is null then v end as reason from j""")
def settled_answers(t: Tables) -> DataFrame:
    a = _pairs(t).withColumn("aid", F.when(F.col("turn") % 10 == 2, F.concat(F.lit("0"), F.col("turn").cast("string"))).otherwise(F.col("turn").cast("string")))
    entry = lambda rows, at: rows.select("conv_id", F.lit(at).alias("at"), F.col("aid").alias("id"), T.lines(F.col("t")).alias("lines"), F.lit(None).cast("array<string>").alias("source"), F.lit(None).cast("string").alias("problem"))
    found = entry(a.where("turn % 6 <> 4"), 0).unionByName(entry(a.where("conv_id % 5 = 0 and turn = 0"), 1))
    requests = a.select("conv_id", F.col("turn").cast("string").alias("id"), T.lines(F.col("s")).alias("lines"))
    return answers.settle(requests, found, ["conv_id"], "lines").select("conv_id", "id", "outcome", "reason")


@query("""select conv_id, turn, case turn % 5 when 1 then 'token_order' when 2 then 'token_slot' when 3 then 'token_counts' end as free_none, case turn % 5 when 2 then 'token_slot' when 3 then 'token_counts' end as free_both, turn % 5 <> 1 and turn % 5 <> 2 and turn % 5 <> 3 as wrapped from conversations""")
def slot_orders(t: Tables) -> DataFrame:
    """Two tokens around a text: as they are, turned, one moved to another line, one lost, and one with a line more of plain text."""
    a, b = placeholder.token(F.lit(0)), placeholder.token(F.lit(1))
    x = F.concat(F.lit("t"), F.col("conv_id").cast("string"))
    source = F.array(F.concat(a, x, b), x)
    target = F.when(F.col("turn") % 5 == 1, F.array(F.concat(b, x, a), x)).when(F.col("turn") % 5 == 2, F.array(F.concat(a, x), F.concat(x, b))).when(F.col("turn") % 5 == 3, F.array(F.concat(a, x), x)).otherwise(source)
    rows = t.conversations.select("conv_id", "turn", target.alias("t"), source.alias("s"))
    none = F.array().cast("array<string>")
    holds = placeholder.wrapper_holds(F.col("t"), a, b, F.lit(True))
    return rows.select("conv_id", "turn", placeholder.slot_violation(F.col("s"), F.col("t"), none).alias("free_none"), placeholder.slot_violation(F.col("s"), F.col("t"), F.array(a, b)).alias("free_both"), holds.alias("wrapped"))


@query(f"""with p as {_PAIRS}, a as (select *, conv_id * 1000 + turn as id from p),
v as (select id, string_split(s, chr(10)) as s, string_split(t, chr(10)) as t, turn % 4 as k from a)
select id, case when k = 2 then 'pending' when len(s) <> len(t) or len(list_filter(t, lambda x: contains(x, chr(13)) or contains(x, chr(65279)))) > 0
or len(list_filter(list_zip(s, t), lambda x: regexp_matches(x[1], '^{BLANK_SQL}*$') <> regexp_matches(x[2], '^{BLANK_SQL}*$'))) > 0 or len(list_filter(t, lambda x: not regexp_matches(x, '^{BLANK_SQL}*$'))) = 0 then 'rejected' else 'accepted' end as state from v""")
def accepted_answers(t: Tables) -> DataFrame:
    p = _pairs(t).withColumn("key", (F.col("conv_id") * 1000 + F.col("turn")).cast("string"))
    asked = p.select("key", T.lines(F.col("s")).alias("source"))
    said = p.where("turn % 4 <> 2").select("key", T.lines(F.col("t")).alias("target"))
    return validate.accept(asked, said, "key", "source", "target").select(F.col("key").cast("long").alias("id"), "state")


# -- exports

_STATE = "case doc_id % 3 when 0 then 'current' when 1 then 'pending' else 'rejected' end"


def _units(t: Tables) -> DataFrame:
    by = lambda *c: F.element_at(F.array(*c), (F.col("doc_id") % 3 + 1).cast("int"))
    owner = F.when(F.col("doc_id") % 2 == 0, "builtin").otherwise("rules")
    return t.documents.select(
        F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("manual_id"), T.lines(F.col("text")).alias("source"), F.array("lang").alias("translation"), by(*map(F.lit, ("current", "pending", "rejected"))).alias("state"),
        by(*map(F.lit, ("manual", "none", "automatic"))).alias("origin"), F.lit("free").alias("type"), owner.alias("owner"), F.when(owner == "rules", F.col("doc_id") % 7 + 1).alias("rule_number"),
        F.lit('["x"]').alias("rejected_candidate_json"), "doc_id",
    )


@query(f"""select 'd:' || doc_id as manual_id, cast(null as varchar) as error, len(string_split(text, chr(10))) as n_lines, case when doc_id % 3 = 0 then lang end as body, {_STATE} as state,
case when doc_id % 2 = 1 then doc_id % 7 + 1 end as rule_number, case when doc_id % 3 = 2 then '["x"]' end as candidate from documents""")
def translation_exports(t: Tables) -> DataFrame:
    """Written as lines and read again."""
    back = exports.checked(exports.export_lines(_units(t)))
    return back.select("manual_id", "error", F.size("row.source").cast("long").alias("n_lines"), F.array_join("row.translation", "|").alias("body"), "row.state", "row.rule_number", F.col("row.rejected_candidate_json").alias("candidate"))


@query("""select 'd:' || doc_id as manual_id, case doc_id % 6 when 0 then 'malformed_json' when 1 then 'unknown_key' when 2 then 'missing_key' when 3 then 'current_without_translation' when 4 then 'wrong_origin' when 5 then 'wrong_rule_number' end as error from documents""")
def export_problems(t: Tables) -> DataFrame:
    """Lines broken in six ways."""
    part = lambda s: F.concat(F.lit('{"manual_id":"d:'), F.col("doc_id").cast("string"), F.lit('",' + s + "}"))
    good = '"source":["a"],"translation":null,"state":"pending","origin":"none","type":"free"'
    ways = [good + ",", good + ',"other":1', good.replace('"type":"free"', '"owner":"builtin"'), good.replace("pending", "current").replace("none", "manual"), good.replace("none", "manual"), good + ',"owner":"rules"']
    lines = t.documents.select("doc_id", F.element_at(F.array(*(part(w) for w in ways)), (F.col("doc_id") % 6 + 1).cast("int")).alias("value"))
    return exports.checked(lines).select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("manual_id"), "error")


@query("""select 'd:' || doc_id as manual_id, '{"manual_id":"d:' || doc_id || '","owner":"' || case when doc_id % 2 = 0 then 'builtin"' else 'rules","rule_number":' || (doc_id % 7 + 1) end || '}' as value from documents""")
def ownership_exports(t: Tables) -> DataFrame:
    return exports.ownership_lines(_units(t))


# -- snapshots that changes make


@query("""select doc_id, case when quality is null then lang when doc_id % 2 = 0 then 'q' || quality end as answer, case when quality is null then 'kept' when doc_id % 2 = 0 then 'set' else 'cleared' end as outcome from documents left join labels using (doc_id)""")
def set_answers(t: Tables) -> DataFrame:
    table = t.documents.select("doc_id", F.col("lang").alias("answer"))
    new = t.labels.join(t.documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("answer"))
    return snapshots.set_answers(table, new, ["doc_id"], "answer").select("doc_id", "answer", "outcome")


@query("""select c_custkey, case when c_acctbal < 0 then 'debt' else c_mktsegment end as segment, c_acctbal < 0 as changed from customer where not (c_acctbal > 9000)""")
def updated_rows(t: Tables) -> DataFrame:
    kept = snapshots.delete(t.customer, F.col("c_acctbal") > 9000)
    return snapshots.update(kept, F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("debt")}).select("c_custkey", F.col("c_mktsegment").alias("segment"), "changed")


# -- rules over documents


@query("""select conv_id, turn, path, array_to_string(places, '.') as "at", value from (
select conv_id, turn, 'role' as path, []::bigint[] as places, role as value from conversations union all select conv_id, turn, 'inner.turn', [], cast(turn as varchar) from conversations
union all select conv_id, turn, 'inner.parts[1]', [], cast(turn + 1 as varchar) from conversations union all select conv_id, turn, 'inner.lines[]', [i - 1], l[i] from (select conv_id, turn, l, unnest(generate_series(1, len(l))) as i from (select conv_id, turn, string_split(text, chr(10)) as l from conversations))) where value <> ''""")
def shared_paths(t: Tables) -> DataFrame:
    """Four paths in one pass; the string `inner` is a document of its own."""
    inner = F.to_json(F.struct("turn", T.lines(F.col("text")).alias("lines"), F.array(F.col("turn"), F.col("turn") + 1).alias("parts")))
    docs = t.conversations.select("conv_id", "turn", F.to_json(F.struct("role", inner.alias("inner"))).alias("body"))
    found = rules.extract_many(docs, ["conv_id", "turn"], "body", ["role", "inner.turn", "inner.parts[1]", "inner.lines[]"])
    return found.where("value <> ''").select("conv_id", "turn", "path", F.array_join(F.col("at").cast("array<string>"), ".").alias("at"), "value")


ROUTES = [{"file": "Map*.json"}, {"file": "Map007.json"}, {"code": 101}, {"file": "Items.json"}, {"file": "Map*.json"}]
_FILE = "case p_partkey % 4 when 0 then 'Items.json' when 1 then 'Troops.json' when 2 then 'Other.json' else 'Map' || case when p_size < 10 then '00' else '0' end || p_size || '.json' end"


@query(f"""with f as (select p_partkey, {_FILE} as file from part), m as (select *, file like 'Map%' as map from f)
select p_partkey, file, rule from m, (values (0, 'm'), (1, 'Map007.json'), (2, 'c'), (3, 'Items.json'), (4, 'm')) r(rule, k) where (k = 'm' and map) or k = file or (k = 'c' and (map or file = 'Troops.json'))""")
def routed_rules(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Map"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".json"))
    file = F.element_at(F.array(F.lit("Items.json"), F.lit("Troops.json"), F.lit("Other.json"), name), (F.col("p_partkey") % 4 + 1).cast("int"))
    return rules.route(t.part.select("p_partkey", file.alias("file")), "file", ROUTES)


@query("""select l_suppkey, l_partkey % 50 as step, l_orderkey * 8 + l_linenumber as rule, min(l_orderkey * 8 + l_linenumber) over w as first_rule, case when count(*) over w > 1 then 'duplicate_target' end as error from lineitem window w as (partition by l_suppkey, l_partkey % 50)""")
def merged_targets(t: Tables) -> DataFrame:
    found = t.lineitem.select("l_suppkey", "l_partkey", (F.col("l_partkey") % 50).alias("step"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rule"))
    return rules.merged(found, "l_suppkey", "l_partkey", "step", "rule").select("l_suppkey", "step", "rule", "first_rule", "error")


@query("select l_partkey as resource, case when l_returnflag = 'R' then 'exclusive' else 'intent' end as access, l_orderkey as ord from lineitem")
def ordered_claims(t: Tables) -> DataFrame:
    c = t.lineitem.select(F.col("l_partkey").alias("resource"), F.when(F.col("l_returnflag") == "R", "exclusive").otherwise("intent").alias("access"), F.col("l_orderkey").alias("ord"))
    return claims.ordered(c, "resource", "access", "ord")


# -- system files, event lists and write-back


@query("""select p_partkey, field, text from (select p_partkey, 'gameTitle' as field, p_name as text from part union all select p_partkey, 'currencyUnit', p_type from part union all select p_partkey, 'terms.messages.victory', p_brand from part
union all select p_partkey, 'terms.messages.defeat', p_type from part union all select p_partkey, 'terms.basic[' || (i - 1) || ']', w[i] from (select p_partkey, w, unnest(generate_series(1, len(w))) as i from (select p_partkey, string_split(p_name, ' ') as w from part))
union all select p_partkey, 'elements[1]', p_brand from part) where trim(text) <> ''""")
def system_texts(t: Tables) -> DataFrame:
    messages = F.struct(F.col("p_brand").alias("victory"), F.col("p_type").alias("defeat"))
    body = F.to_json(F.struct(F.col("p_name").alias("gameTitle"), F.col("p_type").alias("currencyUnit"), F.struct(F.split("p_name", " ").alias("basic"), messages.alias("messages")).alias("terms"), F.array(F.lit(None).cast("string"), "p_brand").alias("elements")))
    return D.system_texts(t.part.select("p_partkey", body.alias("body")), ["p_partkey"])


def _maps(t: Tables) -> DataFrame:
    """A map of each conversation: its second event has one page, whose commands are the turns; a parameter of the first holds JSON."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.withColumn("i", F.row_number().over(w) - 1)
    command = F.struct(F.when(F.col("role") == "user", 101).otherwise(401).alias("code"), F.lit(0).alias("indent"), F.array("text").alias("parameters"))
    lists = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", command.alias("c")))), lambda x: x.c).alias("list"), F.min("role").alias("role"))
    page = F.to_json(F.struct(F.array(F.struct("list")).alias("pages")))
    note = F.to_json(F.struct(F.to_json(F.struct(F.col("role").alias("who"), F.lit(1.50).cast("decimal(4,2)").alias("n"))).alias("note")))
    return lists.select("conv_id", F.concat(F.lit('{"displayName":"m","meta":'), note, F.lit(',"events":[null,'), page, F.lit("]}")).alias("body"))


@query("""select conv_id, 1 as event, 0 as page, row_number() over (partition by conv_id order by turn) - 1 as idx, case when role = 'user' then 101 else 401 end as code, text from conversations""")
def map_events(t: Tables) -> DataFrame:
    rows = D.commands(D.event_lists(_maps(t), ["conv_id"], "map"), ["conv_id", "event", "page"], "list")
    return rows.select("conv_id", "event", "page", F.col("idx").cast("long").alias("idx"), "code", F.get("parameters", F.lit(0)).alias("text"))


@query("""with m as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n, text, min(role) over (partition by conv_id) as who from conversations)
select conv_id, cast(null as varchar) as error, 'new ' || any_value(who) as who, '1.50' as n, string_agg(case when i = 0 then '> ' || text else text end, '|' order by i) filter (i < n - 1 or n = 1) || case when any_value(n) > 1 then '|one|two' else '' end as texts from m group by conv_id""")
def rewritten_documents(t: Tables) -> DataFrame:
    """The first command's text set, the last command replaced by two, a nested document edited; numbers stay as they were written."""
    docs = _maps(t).join(t.conversations.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"), F.min("role").alias("who"), F.min_by("text", "turn").alias("first")), "conv_id")
    none = lambda kind: F.lit(None).cast(kind)
    steps = lambda *s: F.array(*map(F.lit, s))
    edit = lambda at, old, text, start, stop, commands: F.struct(at.alias("steps"), old.alias("old"), text.alias("text"), start.alias("start"), stop.alias("stop"), commands.alias("commands"))
    at = ("events", "[1]", "pages", "[0]", "list")
    edits = [
        edit(steps(*at, "[0]", "parameters", "[0]"), F.col("first"), F.concat(F.lit("> "), "first"), none("int"), none("int"), none("string")),
        edit(steps("meta", "note", rewrite.DECODE, "who"), F.col("who"), F.concat(F.lit("new "), "who"), none("int"), none("int"), none("string")),
    ]
    tail = F.lit('[{"code":401,"indent":0,"parameters":["one"]},{"code":401,"indent":0,"parameters":["two"]}]')
    last = edit(steps(*at), none("string"), none("string"), F.col("n") - 1, F.col("n"), tail)
    rows = docs.select("conv_id", F.explode(F.concat(F.array(*edits), F.when(F.col("n") > 1, F.array(last)).otherwise(F.filter(F.array(last), lambda x: F.lit(False))))).alias("e")).select("conv_id", "e.*")
    out = rewrite.rewrite(docs, "conv_id", "body", rows)
    note = F.get_json_object(F.get_json_object("body", "$.meta"), "$.note")
    texts = F.transform(F.from_json(F.get_json_object("body", "$.events[1].pages[0].list"), D.COMMANDS), lambda c: F.get(c.parameters, F.lit(0)))
    return out.select("conv_id", "error", F.get_json_object(note, "$.who").alias("who"), F.regexp_extract(note, r'"n":([0-9.]+)', 1).alias("n"), F.array_join(texts, "|").alias("texts"))
