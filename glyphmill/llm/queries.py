"""The queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, decontam, embed_dedup, jaccard_join, kd_shard, lm, substring_dedup, toxicity, url_filter, warc
from glyphmill.llm.common import crc_of_id, table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), weights)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", "predicted")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return digests(out)


def digests(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.removal(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shard.shard(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filters, op2_toxicity, op3_lm, op4_jaccard_join, op5_bpe, op6_warc, op7_decontamination, op8_embedding_dedup, op9_substring_dedup, op10_kd_shards)
}

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Every document by every other along its links, from links of both directions.
REACH = "reach(id, other) as (select id, id from nodes union select reach.id, links.b from reach join links on links.a = reach.other)"

#: The other operators hold models, tokenizers or cuts by approximate medians; tests compare them with brute force or bounds.
ORACLES: dict[str, str] = {
    "op4_jaccard_join": f"""with recursive words as (select doc_id, regexp_extract_all({LOWER}, '{WORD}') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < {jaccard_join.GRAM} then [array_to_string(w, ' ')]
else list_distinct(list_transform(generate_series(1, len(w) - {jaccard_join.GRAM - 1}), lambda i: array_to_string(w[i:i + {jaccard_join.GRAM - 1}], ' '))) end as s from words),
sized as (select doc_id, len(s) as n, s from sets), classes as (select list_sort(s) as c, min(doc_id) as doc_id, any_value(n) as n from sized where n > 0 group by 1),
grams as (select doc_id, n, unnest(c) as g from classes), shared as (select x.doc_id as a, y.doc_id as b, x.n + y.n - count(*) as either, count(*) as common from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id
and 100 * least(x.n, y.n) >= {jaccard_join.PERCENT} * greatest(x.n, y.n) group by x.doc_id, y.doc_id, x.n, y.n),
found as (select a, b from shared where 100 * common >= {jaccard_join.PERCENT} * either), links as (select a, b from found union all select b, a from found), nodes as (select doc_id as id from classes), {REACH},
named as (select id, min(other) as component_id from reach group by id)
select s.doc_id, s.n as n_shingles, coalesce(m.component_id, s.doc_id) as component_id from sized s left join classes c on s.n > 0 and list_sort(s.s) = c.c left join named m on m.id = c.doc_id""",
    "op6_warc": f"""with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
k as (select digest, min(page_id) as first from p where n >= {warc.SMALLEST} group by digest)
select page_id, n as payload_bytes, digest as payload_digest, case when first < page_id then 'revisit' else 'response' end as record_type, case when first < page_id then first end as refers_to from p left join k using (digest)""",
    "op8_embedding_dedup": f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
good as materialized (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as size from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from good x join good y on x.vec_id <> y.vec_id where list_inner_product(x.e, y.e) / (x.size * y.size) >= {embed_dedup.THRESHOLD}),
nodes as (select vec_id as id from embeddings), {REACH}, named as (select id, min(other) as component_id from reach group by id), counted as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join named on named.id = vec_id left join counted on counted.a = vec_id""",
    "op9_substring_dedup": f"""with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
places as (select doc_id, len(w) as n, w, unnest(generate_series(1, len(w))) as i from words),
windows as (select doc_id, i, w[i] as word, case when i + {substring_dedup.WINDOW - 1} <= n then array_to_string(w[i:i + {substring_dedup.WINDOW - 1}], ' ') end as key from places),
again as (select doc_id, i, word, (key is not null and row_number() over (partition by key order by doc_id, i) > 1)::int as again from windows),
gone as (select doc_id, i, word, max(again) over (partition by doc_id order by i rows between {substring_dedup.WINDOW - 1} preceding and current row) as gone from again),
cut as (select doc_id, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by i) filter (gone = 0) as kept from gone group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from words left join cut using (doc_id)""",
}
