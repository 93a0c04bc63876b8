"""The pipeline's stages against brute force, on the smallest documents."""

import hashlib

import public_tokenizers

import corpus_pipeline
from glyphmill.llm import decontam
from test_llm_operators import components, removed, words

SF = "/root/testdata/sf0.001"


def plain(t):
    return b" ".join(t.encode().translate(decontam.LOWER, decontam.PUNCTUATION).split())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, SF)
        assert out.columns == docs.columns
        kept[name] = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
        before = spark.createDataFrame(out.collect(), docs.schema)
    clean = kept["toxicity"]
    assert 0 < len(clean) <= docs.count()
    # One document of each group.
    sets = []
    for _, t, _ in clean:
        w = words(t, True)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = components(len(sets), links)
    lowest = {}
    for (i, _, _), g in zip(clean, group):
        lowest[g] = min(i, lowest.get(g, i))
    single = [x for x, g in zip(clean, group) if lowest[g] == x[0]]
    assert sorted(x[0] for x in kept["ngram_jaccard_join"]) == sorted(x[0] for x in single)
    # No repeated windows.
    want = {i: (k.decode() if n else t) for (i, _, n, k), (_, t, _) in zip(removed([x[:2] for x in single]), single)}
    assert {i: t for i, t, _ in kept["substring_dedup"]} == want and all(len(t) == n for _, t, n in kept["substring_dedup"])
    # No whole benchmark item.
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, t, _ in kept["benchmark_decontamination"]:
        assert not any(b" " + x + b" " in b" " + plain(t) + b" " for x in items)
    # The tokens of what is left.
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()}
    assert set(got) == {i for i, _, _ in kept["benchmark_decontamination"]}
    for i, t, _ in kept["benchmark_decontamination"]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[i].n_tokens == len(ids)
