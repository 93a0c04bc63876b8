"""Every query of the reference's operators over the driver's tables, with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from glyphmill.functions import hashing, json_repair, layout, placeholder, spans
from glyphmill.functions import text as T
from glyphmill.operators import claims, dedup, layout_rules, manual, order, packing, qa, relations, rules, runlog, snapshots, terms, units, validate
from glyphmill.plans import sqlapi
from glyphmill.sources import documents as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TERMS = ["the", "then", "there", "tion", "ation", "ing", "and", "der", "die", "que"]
SPEAKER = r"^([A-Z][a-z]+)(?:[ .,:]|$)"
LANGS = "('en', 'English'), ('de', 'German'), ('fr', 'French'), ('es', 'Spanish')"


class Tables:
    """Tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sqlapi.register(spark, sf_dir)
        return sqlapi.query(spark, sql)

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


# -- units, constraints and hashes

UNITS_SQL = """(select source as scope_id, doc_id as group_id, row_number() over (partition by source order by doc_id) - 1 as group_ord, string_split(text, chr(10)) as ls from documents where text is not null)"""


@query(f"""select scope_id, group_id, group_ord, i - 1 as unit_ord, scope_id || ':line' || (group_ord + 1) || ':unit' || i as natural_id, ls[i] as text
from (select *, unnest(generate_series(1, len(ls))) as i from {UNITS_SQL})""")
def scan_units(t: Tables) -> DataFrame:
    return units.units_of(t.documents.where("text is not null"), "source", "doc_id", "text")


@query("""select 'empty_id' as problem, count(*) filter (turn is null or cast(turn as varchar) = '') as n from conversations
union all select 'control_character', count(*) filter (regexp_matches(text, '[\\r\\x00]')) from conversations
union all select 'null_text', count(*) filter (text is null) from conversations
union all select 'duplicate_unit', count(*) from (select conv_id, turn from conversations group by all having count(*) > 1)""")
def group_constraints(t: Tables) -> DataFrame:
    return units.problems(t.conversations, ["conv_id"], "turn", "text")


@query("select text, count(*) as n from documents group by text having count(*) > 1")
def repeated_keys(t: Tables) -> DataFrame:
    return units.repeated(t.documents, "text")


def _frame(c: str) -> str:
    return f"'01' || lpad(printf('%X', octet_length(encode({c}))), 16, '0') || hex(encode({c}))"


def _domain(d: str) -> str:
    return f"'00' || lpad(printf('%X', octet_length(encode('{d}'))), 16, '0') || hex(encode('{d}'))"


@query(f"select doc_id, sha256(unhex({_domain(hashing.DOMAIN)} || {_frame('lang')} || {_frame('text')})) as fingerprint from documents")
def unit_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.framed_sha256(F.col("lang"), F.col("text")).alias("fingerprint"))


@query(f"""select conv_id, sha256(unhex({_domain(hashing.DOMAIN)} || string_agg({_frame('role')} || {_frame('text')}, '' order by turn))) as context from conversations group by conv_id""")
def group_context_hash(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(hashing.ordered_sha256(F.col("turn"), F.col("role"), F.col("text")).alias("context"))


@query(f"""select source, sha256(unhex({_domain(hashing.DOMAIN)} || string_agg('01' || lpad(printf('%X', 64), 16, '0') || hex(encode(h)), '' order by doc_id))) as asset from
(select source, doc_id, sha256(unhex({_domain(hashing.DOMAIN)} || {_frame('text')})) as h from documents) group by source""")
def tree_fingerprint(t: Tables) -> DataFrame:
    """Two levels: each document's digest, then a source's digests in order."""
    leaf = t.documents.select("source", "doc_id", hashing.framed_sha256(F.col("text")).alias("h"))
    return leaf.groupBy("source").agg(hashing.ordered_sha256(F.col("doc_id"), F.col("h")).alias("asset"))


@query(f"""with c as (select conv_id, sha256(unhex({_domain(hashing.DOMAIN)} || string_agg({_frame('text')}, '' order by turn))) as context from conversations group by conv_id)
select conv_id, turn, sha256(unhex({_domain('glyphmill/automatic')} || {_frame("'ja'")} || {_frame("'en'")} || {_frame('cast(conv_id as varchar)')} || {_frame('cast(turn as varchar)')} || {_frame('text')} || {_frame('context')})) as applicability from conversations join c using (conv_id)""")
def applicability(t: Tables) -> DataFrame:
    c = t.conversations
    context = c.groupBy("conv_id").agg(hashing.ordered_sha256(F.col("turn"), F.col("text")).alias("context"))
    j = c.join(context, "conv_id")
    s = lambda x: F.col(x).cast("string")
    return j.select("conv_id", "turn", hashing.automatic_applicability(F.lit("ja"), F.lit("en"), s("conv_id"), s("turn"), F.col("text"), F.col("context")).alias("applicability"))


@query(f"""select conv_id, turn, sha256(unhex({_domain('glyphmill/manual')} || {_frame("'ja'")} || {_frame("'en'")} || {_frame("'c.jsonl'")} || {_frame('role')} || {_frame('cast(conv_id as varchar)')} || {_frame('cast(turn as varchar)')} || {_frame("'free'")} || {_frame('text')})) as applicability from conversations""")
def manual_applicability(t: Tables) -> DataFrame:
    s = lambda x: F.col(x).cast("string")
    f = hashing.manual_applicability(F.lit("ja"), F.lit("en"), F.lit("c.jsonl"), F.col("role"), s("conv_id"), s("turn"), F.lit("free"), F.col("text"))
    return t.conversations.select("conv_id", "turn", f.alias("applicability"))


SIZE_SQL = "2 + length({c}) + length(regexp_replace({c}, '[^\"\\\\\\x08\\x0c\\n\\r\\t]', '', 'g')) + 5 * length(regexp_replace({c}, '[^\\x01-\\x07\\x0b\\x0e-\\x1f]', '', 'g'))"


@query(f"select doc_id, {SIZE_SQL.format(c='text')} as size from documents")
def stable_sizes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.quoted_size(F.col("text")).cast("long").alias("size"))


# -- text predicates and scalars


@query("""select doc_id, len(list_filter(regexp_extract_all(text, '([A-Za-z'']+(?: [A-Za-z'']+)*)', 1), lambda r: len(string_split(r, ' ')) >= 2 and length(regexp_replace(r, '[^A-Za-z]', '', 'g')) >= 6)) > 0 as needed from documents""")
def needs_translation_en(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.needs_english(F.col("text")).alias("needed"))


JA = "('かな漢字 mixed'), ('plain text'), ('カタカナ'), ('漢字'), ('ー'), (''), ('ｱｲｳ'), ('한글')"


#: First and last code points, in decimals, of what makes a Japanese source.
JAPANESE_CODES = ((12295, 12295), (12353, 12438), (12447, 12447), (12449, 12538), (12543, 12543), (12784, 12799), (13312, 19903), (19968, 40959), (63744, 64255), (65382, 65391), (65393, 65437), (131072, 173791), (173824, 192095), (194560, 195103), (196608, 205743))


@query(f"select t as text, len(list_filter(string_split(t, ''), lambda c: {' or '.join(f'unicode(c) between {a} and {b}' for a, b in JAPANESE_CODES)})) > 0 as needed from (values {JA}) v(t)")
def needs_translation_ja(t: Tables) -> DataFrame:
    return t.spark.sql(f"select * from values {JA} as v(text)").select("text", T.needs_japanese(F.col("text")).alias("needed"))


@query("""select doc_id, len(regexp_extract_all(text, '(\\p{Han}{2,}|[\\p{Hiragana}\\p{Katakana}]{2,}|\\p{Latin}{3,}|\\p{Cyrillic}{3,}|\\p{Greek}{3,})', 1)) as n_tokens,
len(list_distinct(regexp_extract_all(lower(text), '(\\p{Han}{2,}|[\\p{Hiragana}\\p{Katakana}]{2,}|\\p{Latin}{3,}|\\p{Cyrillic}{3,}|\\p{Greek}{3,})', 1))) as n_distinct from documents""")
def script_tokens(t: Tables) -> DataFrame:
    own = T.script_tokens(F.lower("text"))
    return t.documents.select("doc_id", F.size(T.script_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(own)).cast("long").alias("n_distinct"))


BLANK_SQL = T.BLANK


@query(f"""select doc_id, count(*) as n_lines, count(*) filter (regexp_matches(l, '^{BLANK_SQL}*$')) as n_blank from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) group by doc_id""")
def blank_lines(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(T.lines(F.col("text"))).alias("l"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_blank(F.col("l"))).alias("n_blank"))


@query(f"""select doc_id, length(text) + length(regexp_replace(text, '[^{T.WIDE[1:-1]}]', '', 'g')) - length(regexp_replace(text, '[^\\x01-\\x1f\\x7f]', '', 'g')) as width from documents""")
def display_width(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.display_width(F.col("text")).cast("long").alias("width"))


@query("select page_id, length(regexp_replace(lower(html), '[^\\p{L}\\p{N}]', '', 'g')) as stable from pages")
def stable_characters(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(T.letters_and_digits(F.col("html"))).cast("long").alias("stable"))


@query("""select conv_id, turn, regexp_replace(text, '(?i)(^|[^a-z])(the)([^a-z]|$)', '\\1###\\3', 'g') as masked from (select conv_id, turn, regexp_replace(text, ' ', '  ', 'g') as text from conversations)""")
def masked_terms(t: Tables) -> DataFrame:
    text = F.regexp_replace("text", " ", "  ")
    return t.conversations.select("conv_id", "turn", F.replace(T.mask_term(text, "the"), F.lit("█"), F.lit("#")).alias("masked"))


TAGS = "('EN'), ('zh_hant_tw'), ('pt-br'), ('sr-LATN'), ('de-1996'), ('ja')"


@query("select t as tag, c as canonical from (values ('EN','en'), ('zh_hant_tw','zh-Hant-TW'), ('pt-br','pt-BR'), ('sr-LATN','sr-Latn'), ('de-1996','de-1996'), ('ja','ja')) v(t, c)")
def language_ids(t: Tables) -> DataFrame:
    return t.spark.sql(f"select * from values {TAGS} as v(tag)").select("tag", T.language_id(F.col("tag")).alias("canonical"))


@query("select doc_id, translate(replace(replace(text, ',', '，'), '.', '。'), '，。！？：；（）【】', ',.!?:;()[]') as text from documents")
def plain_punctuation(t: Tables) -> DataFrame:
    wide = F.replace(F.replace("text", F.lit(","), F.lit("，")), F.lit("."), F.lit("。"))
    return t.documents.select("doc_id", T.plain_punctuation(wide).alias("text"))


@query("select conv_id, turn, regexp_matches(text, '(?i)^[ \\t]*(translation|note|explanation|answer)[ \\t]*:') as cue, trim(text) <> '' and regexp_matches(text, '\\p{L}') as player from conversations")
def cues(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.is_explanation(F.col("text")).alias("cue"), T.player_text(F.col("text")).alias("player"))


@query("select event_id, regexp_matches(cast(user_id as varchar), '^(0|[1-9][0-9]*)$') as canonical, regexp_matches('0' || user_id, '^(0|[1-9][0-9]*)$') as padded from events")
def canonical_ids(t: Tables) -> DataFrame:
    s = F.col("user_id").cast("string")
    return t.events.select("event_id", T.is_canonical_id(s).alias("canonical"), T.is_canonical_id(F.concat(F.lit("0"), s)).alias("padded"))


@query("select page_id, regexp_replace(html, '[\\x01-\\x1f\\x7f\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]', ' ', 'g') as line from pages")
def sanitized_lines(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.sanitized(F.col("html")).alias("line"))


@query("select p_partkey, case when regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*$') then p_name else '\"' || p_name || '\"' end as key, regexp_extract('<b>' || p_name || '</b>', '(?s)^<(b)>.*</b>$', 1) as tag from part")
def readable_keys(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.readable_key(F.col("p_name")).alias("key"), T.wrapper(F.concat(F.lit("<b>"), "p_name", F.lit("</b>"))).alias("tag"))


# -- terms


def _alternation() -> str:
    return terms.alternation(TERMS)


@query(f"""select doc_id, len(regexp_extract_all(text, '{_alternation()}', 1)) as hits, array_to_string(regexp_extract_all(text, '{_alternation()}', 1)[1:5], ',') as first from documents""")
def term_hits(t: Tables) -> DataFrame:
    own = terms.selected(F.col("text"), TERMS)
    return t.documents.select("doc_id", F.size(own).cast("long").alias("hits"), F.array_join(F.slice(own, 1, 5), ",").alias("first"))


@query(f"""with v(term) as (values {', '.join(f"('{x}')" for x in TERMS)}),
n as (select doc_id, term, (length(text) - length(replace(text, term, ''))) // length(term) as n from documents, v) select doc_id, term, n from n where n > 0""")
def term_occurrences(t: Tables) -> DataFrame:
    return terms.occurrences(t.documents, "doc_id", "text", TERMS).select("doc_id", "term", F.col("n").cast("long").alias("n"))


@query(f"""with v(term) as (values {', '.join(f"('{x}')" for x in TERMS)}),
n as (select doc_id, term, (length(text) - length(replace(text, term, ''))) // length(term) as n from documents, v) select term, sum(n)::bigint as total, count(*) as documents, min(doc_id) as first from n where n > 0 group by term""")
def term_totals(t: Tables) -> DataFrame:
    n = terms.occurrences(t.documents, "doc_id", "text", TERMS)
    return n.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("documents"), F.min("doc_id").alias("first"))


_ENTRY = " ".join(f"when '{x}' then {i}" for i, x in enumerate(TERMS))


@query(f"""select doc_id % 50 as block, array_to_string(list_sort(list_distinct(list(case x {_ENTRY} end))), ',') as terms from (select doc_id, unnest(regexp_extract_all(text, '{_alternation()}', 1)) as x from documents) group by 1""")
def block_terms(t: Tables) -> DataFrame:
    hits = t.documents.select((F.col("doc_id") % 50).alias("block"), terms.entry_numbers(F.col("text"), TERMS).alias("terms")).where("size(terms) > 0")
    return packing.block_terms(hits, ["block"], "terms").select("block", F.array_join(F.col("terms").cast("array<string>"), ",").alias("terms"))


# -- families


@query("select sha256(text) as family, min(doc_id) as representative, count(*) as members, count(*) - 1 as targets from documents group by 1")
def dedup_families(t: Tables) -> DataFrame:
    return dedup.families(t.documents, F.sha2("text", 256), "doc_id")


_BODY = "(select d.doc_id, d.text, d.lang, case when l.quality = 1 then 'body-' || (d.doc_id % 3) end as body from documents d left join labels l using (doc_id))"


def _bodies(t: Tables) -> DataFrame:
    j = t.documents.join(t.labels, "doc_id", "left")
    return j.select("doc_id", "text", "lang", F.when(F.col("quality") == 1, F.concat(F.lit("body-"), (F.col("doc_id") % 3).cast("string"))).alias("body"))


@query(f"""select sha256(text) as family, count(*) as members, count(*) filter (body is null) as unresolved, count(distinct body) as answers,
min(doc_id) filter (body is null) as first_unresolved, min(doc_id) filter (body is not null) as seed,
case when count(*) filter (body is null) = 0 then 'complete' when count(distinct body) = 1 then 'reuse' else 'request' end as outcome from {_BODY} group by 1""")
def dedup_outcome(t: Tables) -> DataFrame:
    return dedup.outcomes(_bodies(t).withColumn("family", F.sha2("text", 256)), "family", "doc_id", "body")


@query(f"""with u as (select *, sha256(text) as family from {_BODY}), s as (select family, min(body) as seed from u group by family having count(distinct body) = 1)
select family, doc_id, body is null and seed is not null as reused, coalesce(body, seed) as answer from u left join s using (family)""")
def propagate_reuse(t: Tables) -> DataFrame:
    out = dedup.propagate(_bodies(t).withColumn("family", F.sha2("text", 256)), "family", "doc_id", "body")
    return out.select("family", "doc_id", "reused", "answer")


@query("""select role, text, case role when 'user' then cast(turn as varchar) else '' end as extra, min(conv_id) as representative, count(*) as members from conversations group by all""")
def role_dedup(t: Tables) -> DataFrame:
    c = t.conversations
    role = F.when(F.col("role") == "user", "choices").otherwise("speaker")
    key = dedup.role_key(role, F.col("text"), F.lit(""), F.col("turn").cast("string"), F.lit(""))
    return c.withColumn("k", key).groupBy("role", "k").agg(F.min("conv_id").alias("representative"), F.count("*").alias("members")).select("role", "k.text", "k.extra", "representative", "members")


# -- packing

TARGET = 1500
_G = f"(select conv_id, turn, {SIZE_SQL.format(c='text')} + length(role) + 32 as size from conversations)"
_PACK = f"""with recursive g as (select conv_id, size, turn, row_number() over (partition by conv_id order by turn) as i from {_G}),
p as (select conv_id, i, turn, 0 as block, {packing.SHELL} + size as used from g where i = 1
union all select g.conv_id, g.i, g.turn, case when p.used <= {TARGET} and p.used + 1 + g.size <= {TARGET} then p.block else p.block + 1 end,
case when p.used <= {TARGET} and p.used + 1 + g.size <= {TARGET} then p.used + 1 + g.size else {packing.SHELL} + g.size end from p join g on g.conv_id = p.conv_id and g.i = p.i + 1)"""


def _packed(t: Tables) -> DataFrame:
    g = t.conversations.select("conv_id", "turn", (T.quoted_size(F.col("text")) + F.length("role") + 32).alias("size"))
    return packing.pack_blocks(g, "conv_id", "turn", "size", TARGET).select("conv_id", "turn", F.col("block_id").cast("long"))


@query(f"{_PACK} select conv_id, turn, block::bigint as block_id from p")
def pack_blocks(t: Tables) -> DataFrame:
    return _packed(t)


_TASKS = f"""{_PACK}, u as (select p.conv_id, p.turn, p.block::bigint as block_id, c.role, row_number() over (partition by c.text order by c.conv_id, c.turn) = 1 as rep from p join conversations c on c.conv_id = p.conv_id and c.turn = p.turn),
w as (select *, max(rep::int) over (partition by conv_id, block_id) as has from u)
select conv_id, block_id, turn, case when rep then sum(rep::int) over (partition by conv_id, block_id order by turn) - 1 end::bigint as task_id from w where has = 1"""


@query(_TASKS)
def assign_task_ids(t: Tables) -> DataFrame:
    c = t.conversations
    first = c.groupBy("text").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    u = _packed(t).join(c, ["conv_id", "turn"]).join(first, "text").withColumn("rep", (F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.turn") == F.col("turn")))
    return packing.assign_task_ids(u, ["conv_id", "block_id"], "turn", "rep").select("conv_id", "block_id", "turn", F.col("task_id").cast("long"))


# -- snapshots

_OLD = "(select doc_id, text, 'body ' || doc_id as body from documents where doc_id % 10 <> 0)"
_NEW = "(select doc_id, case when doc_id % 7 = 0 then text || '!' else text end as text from documents where doc_id % 11 <> 0)"


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents
    old = d.where("doc_id % 10 <> 0").select("doc_id", "text", F.concat(F.lit("body "), F.col("doc_id").cast("string")).alias("body"))
    return old, d.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))


@query(f"""select doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' when o.text = n.text then 'kept' else 'changed' end as change,
case when o.text = n.text then o.body end as body from {_OLD} o full join {_NEW} n using (doc_id)""")
def reconcile(t: Tables) -> DataFrame:
    return snapshots.reconcile(*_snapshots(t), ["doc_id"], "text", "body")


@query("""select d.doc_id, case when l.quality is not null and l.quality = 1 then 'translated' when coalesce(l.toxic, 0) = 1 or (d.lang <> 'en' and l.quality is null) then 'unfinished' when l.quality is not null then 'outdated' else 'not_needed' end as status from documents d left join labels l using (doc_id)""")
def status_list(t: Tables) -> DataFrame:
    j = t.documents.join(t.labels, "doc_id", "left")
    s = snapshots.status(F.col("quality").isNotNull(), F.col("quality") == 1, F.coalesce("toxic", F.lit(0)) == 1, F.col("lang") != "en")
    return j.select("doc_id", s.alias("status"))


@query("select doc_id, quality, toxic from labels where doc_id not in (select doc_id from documents where doc_id % 3 = 0)")
def detached_records(t: Tables) -> DataFrame:
    return snapshots.detached(t.labels, t.documents.where("doc_id % 3 = 0"), ["doc_id"]).select("doc_id", "quality", "toxic")


@query(f"select doc_id, coalesce(case when doc_id % 5 = 0 then 'manual ' || doc_id end, body, text) as text from {_BODY}")
def coalesce_text(t: Tables) -> DataFrame:
    by_hand = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("manual "), F.col("doc_id").cast("string")))
    return _bodies(t).select("doc_id", snapshots.current_text(by_hand, F.col("body"), F.col("text")).alias("text"))


@query(f"""with p as (select doc_id, case when doc_id % 4 = 0 then 'wrong' else body end as expected, 'new ' || doc_id as proposed from {_BODY} where doc_id % 2 = 0)
select b.doc_id, case when p.doc_id is not null and b.body is not distinct from p.expected then p.proposed else b.body end as body,
case when p.doc_id is null then 'untouched' when b.body is not distinct from p.expected then 'applied' else 'conflict' end as outcome from {_BODY} b left join p using (doc_id)""")
def cas_merge(t: Tables) -> DataFrame:
    b = _bodies(t).select("doc_id", "body")
    pending = b.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "wrong").otherwise(F.col("body")).alias("expected"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("proposed"))
    return snapshots.compare_and_swap(b, pending, ["doc_id"], "body", "expected", "proposed").select("doc_id", "body", "outcome")


@query("""select l.doc_id, l.quality, l.toxic from labels l where l.doc_id % 3 <> 0 union all select doc_id, 1, 0 from documents where doc_id % 3 = 0""")
def upsert_rows(t: Tables) -> DataFrame:
    rows = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return snapshots.upsert(t.labels.select("doc_id", "quality", "toxic"), rows, ["doc_id"])


@query("""(select doc_id, 'missing' as side from (select doc_id from documents except all select doc_id from labels)) union all (select doc_id, 'unexpected' from (select doc_id from labels except all select doc_id from documents))""")
def unit_differences(t: Tables) -> DataFrame:
    return snapshots.differences(t.documents, t.labels, ["doc_id"])


@query("""select count(d.doc_id) as expected, count(*) filter (d.doc_id is not null and l.doc_id is not null) as covered, count(*) filter (l.doc_id is null) as missing, count(*) filter (d.doc_id is null) as unexpected
from (select distinct doc_id from documents) d full join (select distinct doc_id from labels) l on d.doc_id = l.doc_id""")
def coverage(t: Tables) -> DataFrame:
    return snapshots.coverage(t.documents, t.labels, ["doc_id"])


_SCHEMA_A = "('documents', 'bigint text'), ('labels', 'bigint int'), ('pages', 'x')"
_SCHEMA_B = "('documents', 'bigint text'), ('labels', 'bigint bigint'), ('extra', 'y')"


@query(f"""select coalesce(a.name, b.name) as name, case when b.name is null then 'missing' when a.name is null then 'unexpected' else 'mismatched' end as finding
from (values {_SCHEMA_A}) a(name, d) full join (values {_SCHEMA_B}) b(name, d) on a.name = b.name where a.d is distinct from b.d""")
def schema_differences(t: Tables) -> DataFrame:
    v = lambda x: t.spark.sql(f"select * from values {x} as v(name, definition)")
    return snapshots.schema_differences(v(_SCHEMA_A), v(_SCHEMA_B))


@query("""select lang, count(*) as planned, count(*) filter (quality = 1) as reused, count(*) filter (toxic = 1) as rejected, count(*) filter (quality is distinct from 1) as remaining from documents left join labels using (doc_id) group by lang""")
def plan_counters(t: Tables) -> DataFrame:
    j = t.documents.join(t.labels, "doc_id", "left").groupBy("lang")
    return j.agg(F.count("*").alias("planned"), F.count_if(F.col("quality") == 1).alias("reused"), F.count_if(F.col("toxic") == 1).alias("rejected"), F.count_if(~F.col("quality").eqNullSafe(1)).alias("remaining"))


# -- claims

_CLAIMS = "(select l_partkey as resource, l_suppkey % 2 as owner, case when l_returnflag = 'R' then 'exclusive' else 'intent' end as access, l_orderkey as ord from lineitem)"


def _claims(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("resource"), (F.col("l_suppkey") % 2).alias("owner"), F.when(F.col("l_returnflag") == "R", "exclusive").otherwise("intent").alias("access"), F.col("l_orderkey").alias("ord"))


@query(f"""with c as (select resource, owner, bool_or(access = 'exclusive') as x from {_CLAIMS} group by all) select a.resource, a.owner as a, b.owner as b from c a join c b on a.resource = b.resource and a.owner < b.owner and (a.x or b.x)""")
def claims_conflict(t: Tables) -> DataFrame:
    return claims.conflicts(_claims(t), "resource", "owner", "access")


@query(f"""select resource, count(*) as claims, count(*) filter (access = 'exclusive') as exclusive, count(distinct owner) as owners, min(ord) filter (access = 'intent') as first_intent,
case when count(*) filter (access = 'exclusive') > 1 then 'several_exclusive' when count(*) filter (access = 'exclusive') = 1 and count(*) > 1 then 'mixed_access' else 'none' end as error from {_CLAIMS} group by resource""")
def claim_summary(t: Tables) -> DataFrame:
    return claims.summary(_claims(t), "resource", "owner", "access", "ord")


@query("""with p as (select p_size % 3 as owner, string_split(p_name, ' ') as s from part), e as (select owner, s, unnest(generate_series(1, len(s))) as i from p)
select distinct owner, array_to_string(s[1:i], '/') as resource, case when i = len(s) then 'exclusive' else 'intent' end as access from e""")
def claim_paths(t: Tables) -> DataFrame:
    return claims.derive(t.part.select((F.col("p_size") % 3).alias("owner"), F.split("p_name", " ").alias("steps")), "owner", "steps")


# -- candidates and answers

_PAIRS = "(select u.conv_id, u.turn, u.text as s, a.text as t from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user')"


def _pairs(t: Tables) -> DataFrame:
    c = t.conversations
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("s")).join(a, ["conv_id", "turn"])


@query(f"""select conv_id, turn, case when len(string_split(s, chr(10))) <> len(string_split(t, chr(10))) then 'line_count' when regexp_matches(t, '[\\r]') then 'line_character' when contains(t, chr(65279)) then 'byte_order_mark'
when len(list_filter(list_zip(string_split(s, chr(10)), string_split(t, chr(10))), lambda x: regexp_matches(x[1], '^{BLANK_SQL}*$') <> regexp_matches(x[2], '^{BLANK_SQL}*$'))) > 0 then 'blank_slot' when regexp_matches(t, '^({BLANK_SQL}|\\n)*$') then 'blank_body' end as violation from {_PAIRS}""")
def validate_candidates(t: Tables) -> DataFrame:
    return _pairs(t).select("conv_id", "turn", validate.violation(T.lines(F.col("s")), T.lines(F.col("t"))).alias("violation"))


@query("""with e as (select cast(conv_id * 10 + turn as varchar) as id from conversations where role = 'user'),
a as (select case when turn % 5 = 0 then '0' else '' end || (conv_id * 10 + turn - 1) as id from conversations where role <> 'user' union all select cast(conv_id * 10 as varchar) from conversations where conv_id % 7 = 0),
n as (select id, count(*) as n from a group by id)
select coalesce(e.id, n.id) as id, coalesce(n.n, 0) as n, case when n.n is null then 'missing_id' when not regexp_matches(n.id, '^(0|[1-9][0-9]*)$') then 'invalid_id' when e.id is null then 'unexpected_id' when n.n > 1 then 'duplicate_id' else 'bound' end as outcome
from (select distinct id from e) e full join n on e.id = n.id""")
def bind_responses(t: Tables) -> DataFrame:
    c = t.conversations
    number = F.col("conv_id") * 10 + F.col("turn")
    expected = c.where("role = 'user'").select(number.cast("string").alias("id"))
    answers = c.where("role <> 'user'").select(F.concat(F.when(F.col("turn") % 5 == 0, "0").otherwise(""), (number - 1).cast("string")).alias("id"))
    answers = answers.unionByName(c.where("conv_id % 7 = 0").select((F.col("conv_id") * 10).cast("string").alias("id")))
    return validate.bind(expected, answers, "id")


# -- findings

_WORDS = "regexp_extract_all(lower({c}), '([a-z]+)', 1)"


def _grams(w: str, n: int) -> str:
    """The n-grams of a list column w."""
    return f"list_transform(generate_series(1, len({w}) - {n - 1}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


_FINDINGS = f"""with p as {_PAIRS}, w as materialized (select conv_id * 1000 + turn as id, s, t, {_WORDS.format(c='s')} as ws, {_WORDS.format(c='t')} as wt from p),
k as materialized (select id, s, t, {_grams('ws', 2)} as gs, {_grams('wt', 2)} as gt from w),
f as (select id, 'lines' as kind from k where len(string_split(s, chr(10))) <> len(string_split(t, chr(10))) union all select id, 'copied' from k where len(list_intersect(gs, gt)) > 0
union all select id, 'blank' from k where regexp_matches(t, '^({BLANK_SQL}|\\n)*$') union all select id, 'width' from k where len(list_filter(string_split(t, chr(10)), lambda x: length(x) > 120)) > 0
union all select id, 'explanation' from k where regexp_matches(t, '(?i)^[ \\t]*(translation|note|explanation|answer)[ \\t]*:') and not regexp_matches(s, '(?i)^[ \\t]*(translation|note|explanation|answer)[ \\t]*:')
union all select id, 'control_shapes' from k where list_sort(regexp_extract_all(s, '(\\\\[A-Za-z]+\\[[0-9]*\\]|%[0-9]+|\\{{[A-Za-z_]+\\}})', 1)) <> list_sort(regexp_extract_all(t, '(\\\\[A-Za-z]+\\[[0-9]*\\]|%[0-9]+|\\{{[A-Za-z_]+\\}})', 1)))"""


def _findings(t: Tables) -> DataFrame:
    pairs = _pairs(t).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "s", "t")
    return qa.findings(pairs, "id", "s", "t", grams=2, most_width=120)


@query(f"{_FINDINGS} select id, kind from f")
def qa_findings(t: Tables) -> DataFrame:
    return _findings(t)


@query(f"""{_FINDINGS}, r as (select kind, id, row_number() over (partition by kind order by id) as r from (select distinct kind, id from f)), e as (select kind, string_agg(cast(id as varchar), ',' order by id) as examples from r where r <= 5 group by kind)
select f.kind, count(*) as n, count(distinct id) as ids, any_value(e.examples) as examples from f join e on e.kind = f.kind group by f.kind""")
def qa_groups(t: Tables) -> DataFrame:
    return qa.grouped(_findings(t), "id")


@query(f"""with wb as materialized (select {_WORDS.format(c='text')} as w from benchmark), wd as materialized (select doc_id, {_WORDS.format(c='text')} as w from documents),
b as (select distinct unnest({_grams('w', 6)}) as g from wb), d as (select doc_id, unnest({_grams('w', 6)}) as g from wd) select doc_id, count(*) as shared from (select distinct doc_id, d.g from d join b on b.g = d.g) group by doc_id""")
def benchmark_overlap(t: Tables) -> DataFrame:
    grams = lambda c: F.explode(T.word_grams(T.word_list(F.col(c)), 6)).alias("g")
    b, d = t.benchmark.select(grams("text")).distinct(), t.documents.select("doc_id", grams("text"))
    return d.join(b, "g").distinct().groupBy("doc_id").agg(F.count("*").alias("shared"))


@query(f"""with w as materialized (select conv_id, turn, {_WORDS.format(c='s')} as ws, {_WORDS.format(c='t')} as wt from {_PAIRS}), k as materialized (select conv_id, turn, {_grams('ws', 2)} as gs, {_grams('wt', 2)} as gt from w)
select conv_id, turn, gs[list_position(list_transform(gs, lambda g: list_contains(gt, g)), true)] as fragment from k""")
def copied_fragments(t: Tables) -> DataFrame:
    return _pairs(t).select("conv_id", "turn", T.copied_fragment(F.col("s"), F.col("t"), 2).alias("fragment"))


@query("select doc_id from documents where trim(text) <> '' and regexp_matches(text, '\\p{L}') and text not in (select text from documents where doc_id % 2 = 0)")
def unextracted_texts(t: Tables) -> DataFrame:
    d = t.documents
    return qa.unextracted(d.select("doc_id", "text"), d.where("doc_id % 2 = 0"), "text").select("doc_id")


@query("""select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'missing' when a.doc_id is null then 'unexpected' else 'form' end as problem
from (select doc_id, text from documents where doc_id % 10 <> 1) a full join (select doc_id, case when doc_id % 6 = 0 then text || '!' else text end as text from documents where doc_id % 10 <> 2) b on a.doc_id = b.doc_id where a.text is distinct from b.text""")
def written_back(t: Tables) -> DataFrame:
    d = t.documents
    actual = d.where("doc_id % 10 <> 2").select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return qa.written_back(d.where("doc_id % 10 <> 1"), actual, ["doc_id"], "text")


@query("""select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'not_exported' when d.doc_id is null then 'undecided' else 'other_owner' end as problem
from (select doc_id, case when lang = 'en' then 1 else 0 end as o from documents) d full join (select doc_id, quality as o from labels) l on d.doc_id = l.doc_id where d.o is distinct from l.o""")
def ownership_audit(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.when(F.col("lang") == "en", 1).otherwise(0).alias("owner"))
    return qa.ownership(d, t.labels.select("doc_id", F.col("quality").alias("owner")), "doc_id")


@query("""select pattern, count(*) as n, count(distinct page_id) as units from (select page_id, regexp_replace(unnest(regexp_extract_all(html, '(\\\\[A-Za-z]+\\[[0-9]*\\]|%[0-9]+|\\{[A-Za-z_]+\\})', 1)), '[0-9]+', 'N', 'g') as pattern from pages) group by pattern""")
def placeholder_candidates(t: Tables) -> DataFrame:
    return qa.placeholder_candidates(t.pages, "html")


# -- placeholders


MAIL = "[a-z0-9._]+@[a-z0-9.]+"
TAG = "<[a-z/!][^<>]*>"


@query(f"select page_id, len(regexp_extract_all(html, '{TAG}')) as spans, true as restored, false as malformed, html as text from pages")
def protect_roundtrip(t: Tables) -> DataFrame:
    safe = placeholder.protect(F.col("html"), TAG)
    p = t.pages.select("page_id", "html", placeholder.spans(F.col("html"), TAG).alias("o"), safe.alias("p"))
    tokens = placeholder.tokens(F.col("p"))
    # Tokens are put back in order, as a page may hold thousands: text between tokens, then originals, are interleaved.
    between = F.split("p", f"{placeholder.OPEN}[0-9]{{4,}}{placeholder.CLOSE}", -1)
    text = F.array_join(F.transform(between, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.get("o", i - 1), x))), "")
    del tokens
    return p.select("page_id", F.size("o").cast("long").alias("spans"), (text == F.col("html")).alias("restored"), placeholder.malformed(F.regexp_replace("p", "[0-9]{5,}", "0000")).alias("malformed"), text.alias("text"))


@query(f"select doc_id, len(regexp_extract_all(text, '{MAIL}')) as spans, text as restored from documents")
def protect_mail(t: Tables) -> DataFrame:
    p = t.documents.select("doc_id", placeholder.spans(F.col("text"), MAIL).alias("o"), placeholder.protect(F.col("text"), MAIL).alias("p"))
    return p.select("doc_id", F.size("o").cast("long").alias("spans"), placeholder.restore(F.col("p"), F.col("o")).alias("restored"))


@query("""select conv_id, turn, list_sort(regexp_extract_all(s, '([a-z]{6,})', 1)) = list_sort(regexp_extract_all(t, '([a-z]{6,})', 1)) as same, array_to_string(list_sort(list_intersect(regexp_extract_all(s, '([a-z]{3,})', 1), regexp_extract_all(t, '([a-z]{3,})', 1))), ',') as shared from """ + _PAIRS)
def token_multisets(t: Tables) -> DataFrame:
    words = lambda c, n: F.regexp_extract_all(F.col(c), F.lit(f"([a-z]{{{n},}})"), F.lit(1))
    return _pairs(t).select("conv_id", "turn", (F.array_sort(words("s", 6)) == F.array_sort(words("t", 6))).alias("same"), F.array_join(F.array_sort(F.array_intersect(words("s", 3), words("t", 3))), ",").alias("shared"))


# -- documents


@query("select event_id, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null")
def json_path_extract(t: Tables) -> DataFrame:
    return rules.extract(t.events, ["event_id"], "props", "k").select("event_id", "value")


@query("""with j as (select conv_id, turn, text as v from conversations), g as (select conv_id, list(v order by turn) as a from j group by conv_id)
select conv_id, i - 1 as place, a[i] as value from (select conv_id, a, unnest(generate_series(1, len(a))) as i from g)""")
def json_each_extract(t: Tables) -> DataFrame:
    """Documents of nested JSON, a JSON string within, taken apart by a path with [] and an implied decode."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x.text.alias("t")))
    docs = t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.to_json(F.struct(items.alias("units"))).alias("inner"))).alias("body"))
    out = rules.extract(docs, ["conv_id"], "body", "inner.units[].t")
    return out.select("conv_id", F.get("at", F.lit(0)).cast("long").alias("place"), "value")


@query("select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title from pages")
def html_title(t: Tables) -> DataFrame:
    return t.pages.select("page_id", D.html_title(F.col("html")).alias("title"))


@query("""select page_id, unnest(regexp_extract_all(html, '(?i)<script[^>]*\\ssrc=["'']([^"'']+)["'']', 1)) as src from pages""")
def html_scripts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(D.html_scripts(F.col("html"))).alias("src"))


@query("select name, ok from (values ('Map001.json', true), ('Map1000.json', true), ('Map0100.json', false), ('Map12.json', false), ('map001.json', false), ('Map000.json', false), ('Map4294967295.json', true), ('Map4294967296.json', false), ('Map001.json.bak', false)) v(name, ok)")
def map_files(t: Tables) -> DataFrame:
    names = ["Map001.json", "Map1000.json", "Map0100.json", "Map12.json", "map001.json", "Map000.json", "Map4294967295.json", "Map4294967296.json", "Map001.json.bak"]
    return t.spark.createDataFrame([(n,) for n in names], "name string").select("name", D.is_map(F.col("name")).alias("ok"))


@query("""with e as (select user_id, event_id, event_type, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id) as block from events)
select user_id, block, count(*) as events, min(event_id) as first from e group by all""")
def block_islands(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("block", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w))
    return e.groupBy("user_id", "block").agg(F.count("*").alias("events"), F.min("event_id").alias("first"))


@query("""with c as (select conv_id, turn, text, case when role = 'user' then 101 else 401 end as code from conversations), b as (select *, sum(case when code = 101 then 1 else 0 end) over (partition by conv_id order by turn) as block from c)
select conv_id, block, string_agg(text, chr(10) order by turn) as text from b where code = 401 and block > 0 group by conv_id, block""")
def event_blocks(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", F.col("turn").alias("idx"), F.when(F.col("role") == "user", D.DIALOGUE).otherwise(D.DIALOGUE_LINE).alias("code"), F.array("text").alias("parameters"))
    out = D.event_blocks(c, ["conv_id"])
    return out.select("conv_id", "block", F.array_join("lines", "\n").alias("text"))


@query("select conv_id, turn, nullif(trim(regexp_extract(text, '^([A-Z][a-z]+)(?:[ .,:]|$)', 1)), '') as speaker from conversations")
def speakers(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", D.speaker(F.col("text"), SPEAKER).alias("speaker"))


@query("""select doc_id, field, text from (select doc_id, 'lang' as field, lang as text from documents union all select doc_id, 'source', source from documents) where trim(text) <> ''""")
def unpivot_fields(t: Tables) -> DataFrame:
    return t.documents.unpivot(["doc_id"], ["lang", "source"], "field", "text").where(F.trim("text") != "")


@query("""select doc_id, regexp_replace(text, '\\n', '|', 'g') as joined, len(string_split(text, chr(10))) as n, length(regexp_replace(text, '[0-9]+', '', 'g')) as literal, array_to_string(regexp_extract_all(text, '([0-9]+)', 1), ',') as slots from documents""")
def recipes(t: Tables) -> DataFrame:
    r = rules.recipe(F.col("text"), "([0-9]+)")
    d = t.documents.select("doc_id", "text", r.alias("r"))
    return d.select("doc_id", F.array_join(T.lines(F.col("text")), "|").alias("joined"), F.size(T.lines(F.col("text"))).cast("long").alias("n"), F.length(F.array_join("r.literals", "")).cast("long").alias("literal"), F.array_join("r.slots", ",").alias("slots"))


# -- relations


@query("""with t as (select distinct p_partkey as k, unnest(string_split(p_name, ' ')) as w from part), c as (select w from t group by w having count(*) >= 2), a as (select x.k as a, y.k as b, count(*) as shared from t x join t y on x.w = y.w and x.k < y.k group by all)
select a, b, shared from a where shared >= 2 and exists (select 1 from t x join t y on x.w = y.w join c on c.w = x.w where x.k = a and y.k = b)""")
def similar_groups(t: Tables) -> DataFrame:
    return relations.similar_pairs(t.part, "p_partkey", F.split("p_name", " "))


@query()
def linked_components(t: Tables) -> DataFrame:
    """Over the links of all orders, for which recursive SQL is too slow; a test compares it with union-find."""
    e = t.orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 500 + 1000000).alias("b"))
    return relations.components(e)


# -- logs


@query("select user_id, event_type, count(*) as n from events group by all")
def runlog_summary(t: Tables) -> DataFrame:
    return runlog.summary(t.events, "user_id", "event_type")


@query("select user_id, max(epoch_us(ts)) filter (event_type = 'purchase') - min(epoch_us(ts)) filter (event_type = 'view') as micros from events group by user_id")
def phase_durations(t: Tables) -> DataFrame:
    return runlog.phases(t.events, "user_id", "event_type", "ts", "view", "purchase")


@query("""select user_id, case when e = 0 then 'no_terminal_event' when e > 1 then 'several_terminal_events' else 'event_after_end' end as problem from
(select user_id, count(*) filter (event_type = 'signup') as e, max(event_id) as last, max(event_id) filter (event_type = 'signup') as fin from events group by user_id) where e <> 1 or fin < last""")
def runlog_broken(t: Tables) -> DataFrame:
    return runlog.broken(t.events, "user_id", "event_type", "event_id", ["signup"])


@query("select event_type, count(*) as n, count(*) filter (value < 0) as skipped, cast(sum(cast(value * 100 as bigint)) as bigint) as cents from (select event_type, floor(value) as value from events) group by event_type")
def skipped_counts(t: Tables) -> DataFrame:
    e = t.events.select("event_type", F.floor("value").alias("value"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 0).alias("skipped"), F.sum((F.col("value") * 100).cast("long")).alias("cents"))


# -- layout rules and orders

_RULES = "(0, 40, ['en'], null, ['3','5']), (1, 30, ['de','fr'], ['src1','src2'], null), (2, 20, null, ['src7'], null)"


@query(f"""select d.doc_id, r.ord, r.w as max_width from documents d join (values {_RULES}) r(ord, w, langs, sources, ex) on (r.langs is null or list_contains(r.langs, d.lang)) and (r.sources is null or list_contains(r.sources, d.source)) and not coalesce(list_contains(r.ex, cast(d.doc_id as varchar)), false)""")
def layout_selectors(t: Tables) -> DataFrame:
    rows = [(0, 40, ["en"], None, ["3", "5"]), (1, 30, ["de", "fr"], ["src1", "src2"], None), (2, 20, None, ["src7"], None)]
    r = t.spark.createDataFrame(rows, "ord int, max_width int, langs array<string>, sources array<string>, exclude_ids array<string>")
    return layout_rules.select(t.documents, r, "doc_id", {"langs": "lang", "sources": "source"})


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey * 8 + l_linenumber) - 1 as ord from lineitem")
def dense_ordinals(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return order.dense_ordinals(rows, ["l_suppkey"], "key", "ord").select("l_orderkey", "l_linenumber", F.col("ord").cast("long").alias("ord"))


@query("select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rank from orders) where rank <= 5")
def top_examples(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 5")


@query("select l_suppkey, min(l_orderkey * 10 + l_linenumber) as first from lineitem group by l_suppkey")
def semantic_order(t: Tables) -> DataFrame:
    """The smallest composite key of each group; keys are arrays and compare element by element."""
    key = order.semantic_key(F.col("l_orderkey"), F.col("l_linenumber"))
    return t.lineitem.groupBy("l_suppkey").agg(F.min(key).alias("k")).select("l_suppkey", (F.get("k", F.lit(0)) * 10 + F.get("k", F.lit(1))).alias("first"))


@query("""with s as (select user_id, event_id, epoch_us(ts) as a, epoch_us(ts) + 3600000000 as b from events) select event_id from (select event_id, a, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as m from s) where m > a""")
def overlapping_spans(t: Tables) -> DataFrame:
    s = t.events.select("user_id", "event_id", runlog.micros("ts").alias("a"), (runlog.micros("ts") + 3600000000).alias("b"))
    return order.running_end_overlap(s, ["user_id"], "a", "b").select("event_id")


# -- what SQL can't express


@query()
def json_repair_report(t: Tables) -> DataFrame:
    """Props made into near-JSON, repaired, and compared with what they were."""
    near = F.replace(F.replace("props", F.lit('"'), F.lit("'")), F.lit("}"), F.lit(",}"))
    out = t.events.select("event_id", "props", json_repair.repair_json(near).alias("r"))
    return out.select("event_id", "r.json", "r.error", (F.regexp_replace("props", "\\s", "") == F.regexp_replace("r.json", "\\s", "")).alias("same"))


@query()
def layout_wrap(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", layout.wrap_to(60)("text").alias("text"))


@query()
def punct_repair(t: Tables) -> DataFrame:
    return _pairs(t).select("conv_id", "turn", layout.repaired_punctuation("s", "t").alias("text"))


@query()
def bracket_depths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", layout.open_after_lines("html").alias("open"))


@query()
def protect_rules(t: Tables) -> DataFrame:
    p = spans.protect_with([r"<(?P<tag>b|i)>(?P<text>[^<]*)</(?P=tag)>", r"%[0-9]+"])
    return t.pages.select("page_id", p("html").alias("p")).select("page_id", "p.text", "p.originals", "p.error")


@query()
def control_codes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", spans.control_code_spans("text").alias("codes"))


@query()
def json_leaves(t: Tables) -> DataFrame:
    body = F.to_json(F.struct("role", F.to_json(F.struct(F.array("text").alias("lines"))).alias("inner")))
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("body"))
    return D.explode_leaves(rows, "id", "body")


@query()
def script_literals(t: Tables) -> DataFrame:
    return D.explode_literals(t.pages, "page_id", "html")


@query()
def write_back_plan(t: Tables) -> DataFrame:
    return manual.write_back(_pairs(t), "s", "t", most_width=80).select("conv_id", "turn", "outcome", "final")


# -- SQL reach

sql_query("sql_semi_join", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
sql_query("sql_anti_join", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
sql_query("sql_theta_join", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_acctbal < b.s_acctbal")
sql_query("sql_full_join", "select coalesce(n_nationkey, -1) as n, count(s_suppkey) as suppliers from nation full join supplier on n_nationkey = s_nationkey group by 1")
sql_query("sql_window", "select o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from orders")
sql_query("sql_set_operations", "(select l_suppkey as k from lineitem where l_returnflag = 'R' intersect select l_suppkey from lineitem where l_returnflag = 'A') except select s_suppkey from supplier where s_suppkey < 5 union all select r_regionkey + 100000 from region")
sql_query("sql_recursive", "with recursive n(i, f) as (select 1, cast(1 as bigint) union all select i + 1, f * (i + 1) from n where i < 15) select i, f from n")
sql_query("sql_group_having", "select l_returnflag, l_linestatus, count(*) as n, min(l_orderkey) as first from lineitem group by l_returnflag, l_linestatus having count(*) > 10")
sql_query("sql_limit_offset", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10 offset 5")
sql_query("sql_cte_case", "with t as (select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size from part) select size, count(*) as n from t group by size")
sql_query("sql_cross_single", "select c_custkey, n from customer cross join (select count(*) as n from region) r")
