"""Substring dedup by seeds and extension: words under a repeated window of WINDOW words go.

Every window has an anchor, the smallest hash among its SEED-grams (winnowing). Equal windows have equal
anchors, so a window can only repeat if its anchor does. Anchors that occur in one place, which
almost all do, end the matter for their windows. Around each repeated anchor the match is extended both
ways to all windows that it anchors; of these the ones that also start earlier are kept, and their
union in a document is its maximal repeats of WINDOW words and more.

Places of one anchor, and starts of one window, that meet within a run of documents are settled there; only one of
them goes on to be compared with other runs. So what is shuffled for a hot passage grows with the runs, not with
its copies, and each row goes through one shuffle.

Documents with the same word sequence are one class; its later copies repeat the first one in full and
take no part in the search. Null texts have no words. Rows that repeat id and text start nowhere
earlier than one another and are treated alike; of equal windows in one document the earlier start stays.
Rows without doc_id are left as they are. Very long texts are cut into words piece by piece; other columns may
have any name and stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from glyphmill.llm.common import Scratch, fresh_name, gram_hashes, mix, pieces, signed, trimmed, utf8, word_hashes

WINDOW = 20
SEED = 6
#: Anchors or windows of a run.
RUN = 1 << 18


def class_hash(words: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)


def anchors(words: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The seed-grams' hashes, and for each window the position of its anchor: the leftmost smallest hash."""
    grams = gram_hashes(words, seed)
    if len(words) < window:
        return grams, np.empty(0, np.int64)
    best = np.lib.stride_tricks.sliding_window_view(grams, window - seed + 1).argmin(axis=1)
    return grams, best + np.arange(len(best))


def split_words(text: bytes) -> list[bytes]:
    return [w for piece in pieces(text) for w in piece.split()]


def word_table(docs: DataFrame) -> DataFrame:
    """(doc_id, class, n_words, whole): the digest of all words joined by one space, and the class of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, whole = [], [], []
            for t in utf8(batch.column(1)):
                words = word_hashes(t, lower=False)
                digest, between = hashlib.sha256(), b""
                for piece in pieces(t):
                    if own := piece.split():
                        digest.update(between + b" ".join(own))
                        between = b" "
                n.append(len(words))
                cls.append(class_hash(words))
                whole.append(digest.digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(whole, pa.binary())], ["doc_id", "class", "n_words", "whole"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, class long, n_words long, whole binary")


ROWS = "key long, class long, doc_id long, at int, known array<int>"


class Run:
    """Rows (key, class, doc, at) of a run. Of those with equal keys one goes on; what is settled here comes out as an array for each document."""

    def __init__(self, earliest: bool):
        self.earliest, self.held, self.size = earliest, [], 0

    def add(self, key: np.ndarray, cls: int, doc: int, at: np.ndarray) -> None:
        self.held.append((signed(key), np.full(len(key), cls, np.int64), np.full(len(key), doc, np.int64), at.astype(np.int64)))
        self.size += len(key)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        key, cls, doc, at = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        order = np.lexsort((at, doc, key))
        key, cls, doc, at = key[order], cls[order], doc[order], at[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.cumsum(first) - 1
        later = (doc != doc[first][number]) | (at != at[first][number])
        other = cls != cls[first][number]
        # Starts are settled by an earlier one; texts that share an id have none before the other. Places are settled by any other.
        known = later if self.earliest else np.bincount(number, later | other).astype(bool)[number]
        names = [x.split()[0] for x in ROWS.split(", ")]
        go = np.flatnonzero(first | (other & ~later) if self.earliest else first)
        for a in range(0, len(go), 50_000):
            x = go[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(cls[x]), pa.array(doc[x]), pa.array(at[x].astype(np.int32)), pa.nulls(len(x), pa.list_(pa.int32()))], names)
        if known.any():
            cls, doc, at = cls[known], doc[known], at[known]
            order = np.lexsort((at, cls, doc))
            cls, doc, at = cls[order], doc[order], at[order].astype(np.int32)
            start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (cls[1:] != cls[:-1])]))
            own = mix((doc[start] ^ cls[start]).view(np.uint64))  # settled rows need no partner and are dealt evenly
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(own)), pa.array(cls[start]), pa.array(doc[start]), pa.nulls(len(start), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.append(start, len(at)).astype(np.int32)), pa.array(at))], names,
            )


def anchor_table(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """ROWS of the anchors of every class, with doc_id 0; known: places of anchors that are seen to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), Run(earliest=False)
        for batch in batches:
            texts = utf8(batch.column(0))
            for t in texts:
                words = word_hashes(t, lower=False)
                cls = class_hash(words)
                if len(words) < window or cls in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(cls)
                grams, at = anchors(words, window, seed)
                at = np.unique(at)
                held.add(grams[at], cls, 0, at)
                if held.size >= RUN:
                    yield from held.rows()
        yield from held.rows()

    return docs.where("doc_id is not null").select("text").mapInArrow(trimmed(run), ROWS)


def extended(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """ROWS of the windows around the repeated anchors; known: starts of windows that are seen to start earlier, too. texts: doc_id, class, places, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Run(earliest=True)
        for batch in batches:
            for doc, cls, places, t in zip(*(batch.column(k).to_pylist() for k in range(3)), utf8(batch.column(3))):
                words = word_hashes(t, lower=False)
                if class_hash(words) != cls:
                    continue
                grams, at = anchors(words, window, seed)
                repeated = np.zeros(len(grams), bool)
                repeated[places] = True
                start = np.flatnonzero(repeated[at])
                held.add(gram_hashes(words, window)[start], cls, doc, start)
                if held.size >= RUN:
                    yield from held.rows()
        yield from held.rows()

    return texts.select("doc_id", "class", "places", "text").mapInArrow(trimmed(run), ROWS)


def settled(rows: DataFrame, by: str) -> DataFrame:
    """(class, doc_id, at as an array) of the known rows and of those that `by`, an expression over the rows of a key, tells."""
    rows = rows.select("key", "class", "doc_id", "at", "known", F.expr(by).alias("again"))
    at = F.coalesce("known", F.array("at"))
    return rows.where("known is not null or again").groupBy("class", "doc_id").agg(F.array_distinct(F.flatten(F.collect_list(at))).alias("at"))


def repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The word table, and (doc_id, class, starts): the starts of repeated windows; null starts mean all words.

    Only documents from which something goes are in the second table.
    """
    words = scratch.put(word_table(docs), "words")
    # Copies of a class aren't a repeat: they have the same places.
    twice = "min(if(known is null, class, null)) over k <> max(if(known is null, class, null)) over k or min(at) over k <> max(at) over k"
    found = settled(anchor_table(docs, window, seed), twice.replace("over k", "over (partition by key)"))
    found = scratch.put(found.select("class", F.col("at").alias("places")), "places")
    known = words.where("doc_id is not null")
    first = known.groupBy("class", "n_words").agg(F.min("doc_id").alias("first"))
    seeds = first.join(found, "class").select(F.col("first").alias("doc_id"), "class", "places")
    # Merged at every size, as the places have no bound.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(seeds.hint("shuffle_merge"), "doc_id")
    earlier = "struct(doc_id, at) <> min(if(known is null, struct(doc_id, at), null)) over (partition by key)"
    part = settled(extended(texts, window, seed), earlier).select("doc_id", "class", F.col("at").alias("starts"))
    whole = known.where(F.col("n_words") >= window).join(first, ["class", "n_words"]).where("doc_id <> first").select("doc_id", "class", F.lit(None).cast("array<int>").alias("starts"))
    gone = scratch.put(part.unionByName(whole.distinct()), "gone")
    scratch.drop("places")
    return words, gone


def kept_words(words: list[bytes], starts, window: int = WINDOW) -> list[bytes]:
    """The words that no window of `starts` covers; None covers all."""
    if starts is None:
        return []
    edge = np.zeros(len(words) + 1, np.int32)
    starts = np.unique(np.asarray(starts, np.int64))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def removal(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs (doc_id, text); kept is the SHA-256 digest of the kept words joined by one space."""
    scratch = Scratch(docs.sparkSession, "substring")
    words, gone = repeats(docs, scratch, window, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, cls, starts, t in zip(*(batch.column(k).to_pylist() for k in range(3)), utf8(batch.column(3))):
                if class_hash(word_hashes(t, lower=False)) == cls:
                    own = split_words(t)
                    left = kept_words(own, starts, window)
                    out.append((doc, cls, len(own) - len(left), hashlib.sha256(b" ".join(left)).digest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "class", "n_removed", "left"])

    part = gone.where("starts is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(part.hint("shuffle_merge"), "doc_id").select("doc_id", "class", "starts", "text")
    cut = texts.mapInArrow(trimmed(run), "doc_id long, class long, n_removed long, left binary").distinct()
    none = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    cut = cut.unionByName(gone.where("starts is null").join(words.select("doc_id", "class", "n_words").distinct(), ["doc_id", "class"]).select("doc_id", "class", F.col("n_words").alias("n_removed"), none.alias("left")))
    out = words.join(cut, ["doc_id", "class"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("left", "whole").alias("kept"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs with repeated windows cut out of text and n_chars (where there is such a column) set anew; texts without repeats stay as they are, byte for byte."""
    scratch = Scratch(docs.sparkSession, "substring")
    _, gone = repeats(docs, scratch, window, seed)
    names, name = docs.columns, fresh_name(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, cuts = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            for i in [i for i, c in enumerate(cuts) if c]:
                text = texts[i].encode()
                own = class_hash(word_hashes(text, lower=False))
                for cut in cuts[i]:
                    if cut["class"] == own:
                        texts[i] = b" ".join(kept_words(split_words(text), cut["starts"], window)).decode("utf-8", "replace")
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c is not None for c in cuts])], [*names, f"{name}_changed"])

    # An id has several texts only where rows repeat ids; each text takes the entry of its class.
    side = gone.groupBy(F.col("doc_id").alias(name)).agg(F.collect_list(F.struct("class", "starts")).alias(f"{name}_cuts"))
    side = scratch.put(side, "side")
    scratch.drop("words", "gone")
    joined = docs.join(side.hint("shuffle_merge"), F.col("doc_id").cast("long") == F.col(name), "left")
    schema = StructType([*docs.schema.fields, StructField(f"{name}_changed", BooleanType())])
    out = joined.select(*names, f"{name}_cuts").mapInArrow(trimmed(run), schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(f"{name}_changed"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
