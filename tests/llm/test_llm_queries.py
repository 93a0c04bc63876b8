"""The registered queries: against their SQL where they have it, else their columns, one row an input row, and what SQL or the library can state."""

import hashlib
import os
import zlib

import duckdb
import public_tokenizers
import pytest

from glyphmill.llm import queries

SF = "/root/testdata/sf0.001"
#: The rules on urls, as (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


def test_urls(spark):
    got = {r.page_id: r for r in queries.op1_url_filters(spark, SF).collect()}
    pages = rows(spark, "pages")
    assert len(got) == len(pages)
    for p in pages:
        r, after = got[p.page_id], (p.url or "").split("://", 1)[1:]
        rest = after[0] if after else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:][: min([rest[end:].find(c) for c in "?#" if c in rest[end:]], default=None)]
        assert (r.host, r.path) == (host, path)
        fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r.rule == (max(fits)[1] if fits else None) and r.verdict in ("allow", "block")
        assert not fits or r.verdict == max(fits)[2]


def test_toxicity(spark):
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, SF).collect()}
    assert set(got) == {r.doc_id for r in rows(spark, "documents")}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_tokens(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in queries.op5_bpe(spark, SF).collect()}
    docs = rows(spark, "documents")
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert tuple(got[d.doc_id][1:4]) == want


def test_shards(spark):
    got = queries.op10_kd_shards(spark, SF).collect()
    docs = {d.doc_id: (d.text or "").encode() for d in rows(spark, "documents")}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in docs.items()}
    slots = {}
    for r in got:
        assert 0 <= r.shard < 24 and r.law in ("bytes", "rows", "key")
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
