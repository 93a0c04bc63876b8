"""Benchmark decontamination by latent semantic retrieval.

* Features: every word of the benchmark items is a feature of its own, all other words share HASHED
  buckets. Inverse document frequencies come from all documents.
* Latent space: a randomised SVD, one pass for each power step over the TF-IDF passages of all documents, which together
  weigh as WEIGHED documents at most, and the items, which weigh ITEM_WEIGHT each. Words are read once and kept as feature numbers.
* Bound: a text is cut into overlapping parts, so that any place where an item is looked for lies in one of them whole. A part can
  only hold items of which it has LIKELY of the words, in whatever order. That is counted first for all parts and
  items, then again for smaller parts near an item's length, with its answer, and loses nothing, as the checks below ask for more.
* Search: the words of parts that pass for some item are projected, summed in blocks of BLOCK words and compared, as
  windows of whole blocks near an item's length, with these items by cosine. For items of which the space holds
  less than HELD, all windows with LIKELY of the item's words are taken instead.
* Checks: around each run of windows above COSINE the longest common subsequence with the item is taken.
  A document holds an item if the subsequence covers SURE of its words, or covers LIKELY of them
  while the item's answer (its last ANSWER words) is there too for the greater part.

Words are compared in lower case A-Z and without punctuation. Null texts and texts and
items without words match nothing. Repeated items are items of their own, as are repeated documents; a row without doc_id is searched
as any other. Items are taken in groups of MOST_ITEMS, so what tasks are sent is bounded. Of a document's places that hold an item
the one with the largest coverage is reported, the first of equal ones. Very long texts are searched whole, a slice by itself;
other columns may have any name. Empty tables give no matches and leave documents as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, distinct_words, slices, trimmed, utf8

PUNCTUATION = b".,;:!?*%$&#()[]{}<>\"'-"
LOWER = bytes(range(256)).lower()
HASHED = 4096
RANK, EXTRA, POWER = 96, 16, 1
WEIGHED = 3000
PASSAGE = 40
ITEM_WEIGHT = 30.0
BLOCK = 8
COSINE = 0.5
SURE, LIKELY, ANSWER = 0.8, 0.5, 6
MOST_ITEMS = 2000
HELD = 0.5
#: Rows of the thin matrix that are summed as one, and rows whose weighted sums are taken at once.
ROWS, TOGETHER = 256, 8
#: Of so many features, the most frequent ones, passages are multiplied as whole columns.
COLUMNS = 256
#: Words that most items hold, in a table.
COMMON = 64
#: Words that are searched at once for an item, and passages that are multiplied at once.
LONGEST = 2048
SLICE = 256 << 10


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts, end to end: numbers of different words, those words' 64-bit hashes, and where texts begin and end."""
    at, _, h, ends = distinct_words([t.translate(LOWER, PUNCTUATION) for t in texts])
    return at, h, ends


@dataclass(frozen=True)
class Features:
    """Feature numbers: HASHED buckets first, then the benchmark's own words, by hash."""

    own: np.ndarray

    @property
    def size(self) -> int:
        return HASHED + len(self.own)

    @property
    def kind(self) -> type:
        """In which its numbers are kept."""
        return np.uint16 if self.size <= 1 << 16 else np.uint32

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = (h % np.uint64(HASHED)).astype(np.int64)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
            out = np.where(self.own[at] == h, HASHED + at, out)
        return out

    def read(self, texts: list[bytes]) -> list[np.ndarray]:
        """The feature numbers of each text's words."""
        at, h, ends = hashes(texts)
        return np.split(self(h)[at], ends[1:-1])


def feature_numbers(docs: DataFrame, features: Features) -> DataFrame:
    """(words, doc_id): the feature numbers of each document's words, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in slices(batch, texts, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(features.kind).tobytes() for x in features.read(texts[a:b])], pa.binary()), batch.column(1).slice(a, b - a)], ["words", "doc_id"])

    return docs.select("text", F.col("doc_id").cast("long")).mapInArrow(trimmed(run), "words binary, doc_id long")


def _numbers(batch: pa.RecordBatch, features: Features, size: int = SLICE) -> Iterator[list[np.ndarray]]:
    """The feature numbers of a batch's documents, those of about `size` bytes at a time."""
    texts = batch.column(0).to_pylist()
    for a, b in slices(batch, texts, size):
        yield [np.frombuffer(x, features.kind).astype(np.int64) for x in texts[a:b]]


def document_frequencies(words: DataFrame, features: Features) -> np.ndarray:
    """In how many documents each feature occurs, and last the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(features.size + 1, np.int64)
        for batch in batches:
            for own in _numbers(batch, features):
                for c in range(0, len(own), 128):
                    held = np.zeros((128, features.size), bool)
                    for row, x in zip(held, own[c : c + 128]):
                        row[x] = True
                    counts[:-1] += held.sum(axis=0)
                counts[-1] += len(own)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["feature", "n"])

    out = np.zeros(features.size + 1)
    for r in words.select("words").mapInArrow(trimmed(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r.feature] = r.n
    return out


def _sums(table: np.ndarray, at: np.ndarray, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For runs of `size`, end to end, the sums of the table's rows `at` times their weights."""
    n = -(-size // TOGETHER)
    place = np.arange(len(at)) + np.repeat((np.cumsum(n) - n) * TOGETHER - (np.cumsum(size) - size), size)
    rows, weights = np.zeros(n.sum() * TOGETHER, np.int64), np.zeros(n.sum() * TOGETHER, np.float32)
    rows[place], weights[place] = at, weight
    weights = weights.reshape(-1, 1, TOGETHER)
    parts = np.empty((len(weights), table.shape[1]), np.float32)
    for a in range(0, len(parts), 256):
        own = weights[a : a + 256]
        taken = np.take(table, rows[a * TOGETHER : (a + 256) * TOGETHER], axis=0, mode="clip").reshape(len(own), TOGETHER, -1)
        np.matmul(own, taken, out=parts[a : a + 256, None])
    first = np.cumsum(n) - n
    out = parts[first]
    for k in range(1, int(n.max(initial=1))):
        more = np.flatnonzero(n > k)
        out[more] += parts[first[more] + k]
    return out


def _multiply(words: np.ndarray, size: np.ndarray, idf: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """Adds A'A basis to out, for the rows of A, the TF-IDF vectors of passages of `size` words, end to end, scaled to length 1.

    The most frequent features, those with the smallest idf, are multiplied as whole columns, the others one by one.
    """
    size = size[size > 0]
    if not len(size):
        return
    term, tf = np.unique(np.repeat(np.arange(len(size)), size) << 32 | words, return_counts=True)
    passage, feature = term >> 32, term & 0xFFFFFFFF
    runs = lambda x: np.flatnonzero(np.append(True, np.diff(x) > 0))
    lengths = lambda first, n: np.diff(np.append(first, n))
    first = runs(passage)
    x = tf * idf[feature]
    x = (x / np.maximum(np.sqrt(np.add.reduceat(x * x, first)), 1e-30)[passage]).astype(basis.dtype)
    often = np.argpartition(idf, min(COLUMNS, len(idf)) - 1)[:COLUMNS]
    column = np.full(len(idf), -1)
    column[often] = np.arange(len(often))
    column = column[feature]
    whole = column >= 0
    held = np.zeros((len(size), len(often)), basis.dtype)
    held[passage[whole], column[whole]] = x[whole]
    along = held @ basis[often]
    passage, feature, x = passage[~whole], feature[~whole], x[~whole]
    if len(x):
        first = runs(passage)
        along[passage[first]] += _sums(basis, feature, x, lengths(first, len(x)))
        by = np.argsort(feature.astype(np.uint16) if len(idf) <= 1 << 16 else feature, kind="stable")
        first = runs(feature[by])
        out[feature[by][first]] += _sums(along, passage[by], x[by], lengths(first, len(x)))
    out[often] += held.T @ along


def _passages(lengths: np.ndarray) -> np.ndarray:
    """The sizes of the texts' passages: PASSAGE words, and what remains at a text's end, with the passage before it where it is short."""
    n = np.where(lengths > 0, np.maximum(1, (lengths + PASSAGE // 2 - 1) // PASSAGE), 0)
    out = np.full(n.sum(), PASSAGE, np.int64)
    out[np.cumsum(n)[n > 0] - 1] = (lengths - (n - 1) * PASSAGE)[n > 0]
    return out


def latent_space(words: DataFrame, items: list[np.ndarray], features: Features, idf: np.ndarray, weight: float) -> np.ndarray:
    """Leading right singular vectors of the passages, features by rank, by randomised subspace steps. words: feature_numbers of all documents.

    A step multiplies on the executors. Each task sends its part of one thin matrix in blocks of rows to those that sum them, in the
    order of the tasks. The last product gives the vectors, too: for its basis Q, A'A is taken for (A'A Q) (Q'A'A Q)^-1 (A'A Q)'.
    """
    spark = words.sparkSession
    rank = min(RANK + EXTRA, features.size)
    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((features.size, rank)))[0].astype(np.float32)
    flat, size = np.concatenate(items), np.array([len(x) for x in items])
    names = ["block", "task", "part"]
    for step in range(POWER + 1):
        sent = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sent.value.shape)
            for batch in batches:
                for own in _numbers(batch, features):
                    flat, size = np.concatenate(own), _passages(np.array([len(x) for x in own]))
                    ends = np.append(0, np.cumsum(size))
                    for a in range(0, len(size), LONGEST):
                        some = size[a : a + LONGEST]
                        _multiply(flat[ends[a] : ends[a + len(some)]], some, idf, sent.value, total)
            parts = [total[a : a + ROWS] for a in range(0, len(total), ROWS)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, part in zip(batch.column(0).to_pylist(), batch.column(2)):
                    totals[k] = totals.get(k, 0) + np.frombuffer(part.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.nulls(len(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names)

        parts = words.select("words").mapInArrow(trimmed(run), "block int, task int, part binary").repartition("block").sortWithinPartitions("block", "task")
        product = np.zeros(basis.shape)
        for r in parts.mapInArrow(trimmed(added), "block int, task int, part binary").collect():
            product[r.block * ROWS : (r.block + 1) * ROWS] = np.frombuffer(r.part).reshape(-1, rank)
        product *= weight
        sent.unpersist()
        own = np.zeros(basis.shape)
        _multiply(flat, size, idf, basis, own)
        product += ITEM_WEIGHT**2 * own
        if step < POWER:
            basis = np.linalg.qr(product)[0].astype(np.float32)
    values, vectors = np.linalg.eigh((m := basis.T @ product) + m.T)
    some = values > 1e-9 * max(values.max(), 1e-300)
    left, _, _ = np.linalg.svd(product @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)
    return left[:, : min(RANK, rank)].astype(np.float32)


def _stretch(length: int) -> int:
    """Words of text in which an item of this length is looked for."""
    return length + length // 2 + 2 * BLOCK


def common_subsequence(item: list, text: list) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the range of text in which it grows."""
    masks = places(item)
    return grown(len(item), [(j, masks[w]) for j, w in enumerate(text) if w in masks])


def places(item: list) -> dict:
    """For each word of the item its places, as bits."""
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def grown(size: int, hits: list[tuple[int, int]]) -> tuple[int, int, int]:
    """The longest common subsequence of an item of `size` words and the hits (place in the text, places in the item)."""
    full = (1 << size) - 1
    state, first, last = full, -1, -1
    for j, mask in hits:
        u = state & mask
        after = ((state + u) | (state - u)) & full
        if after != state:
            if after.bit_count() < state.bit_count():
                first, last = (j if first < 0 else first), j
            state = after
    return size - state.bit_count(), first, last


@dataclass(frozen=True)
class Index:
    """What tasks are sent: the words' latent vectors and the items."""

    features: Features
    vectors: np.ndarray  # feature by rank, scaled by idf, and a last row of zeros
    ids: list[int]
    latent: np.ndarray  # item by rank, length 1
    widths: np.ndarray  # blocks of an item's window
    held: np.ndarray  # share of the length of an item's vector that lies in the space
    codes: list[list[int]]  # the items as feature numbers
    masks: list[dict[int, int]]
    # How often each item has each of its words: a table for the words of most items, and lists for the others, k from first[k] to first[k + 1].
    common: np.ndarray
    table: np.ndarray
    first: np.ndarray
    holders: np.ndarray
    times: np.ndarray
    # The items' different words have numbers (slots, -1 for words of others), and counts, in the item and in its answer.
    slots: np.ndarray
    often: np.ndarray
    often_last: np.ndarray
    length: np.ndarray
    stretch: np.ndarray  # words of text in which an item is looked for

    def possible(self, numbers: list[np.ndarray]) -> np.ndarray:
        """Text by item: whether the text has LIKELY of the item's words, each counted as often as the item has it."""
        seen = np.zeros((len(numbers), len(self.features.own)), bool)
        flat = np.concatenate(numbers)
        text = np.repeat(np.arange(len(numbers)) * seen.shape[1], [len(x) for x in numbers])
        own = flat >= HASHED
        seen.ravel()[flat[own] + text[own] - HASHED] = True
        counts = seen[:, self.common].astype(np.float32) @ self.table
        seen[:, self.common] = False
        at = np.flatnonzero(seen)
        text = at // max(1, seen.shape[1])
        word = at - text * seen.shape[1]
        n = np.diff(self.first)[word]
        at = np.arange(n.sum()) + np.repeat(self.first[word] - (np.cumsum(n) - n), n)
        rest = np.bincount(np.repeat(text, n) * len(self.codes) + self.holders[at], self.times[at], len(numbers) * len(self.codes))
        return counts + rest.reshape(counts.shape) >= LIKELY * self.length

    def near(self, parts: list[np.ndarray], possible: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, item, start) of stretches twice as long as those that are checked, which hold words enough of the item and its answer, each as often as the item has it."""
        part, item = np.nonzero(possible)
        out = []
        size_of = np.array([len(x) for x in parts])
        step = max(1, (1 << 22) // max(1, max(size_of) + self.slots.shape[1] * 8))
        # The parts' words that some item has.
        flat, begin = np.concatenate(parts), np.cumsum(size_of) - size_of
        place = np.flatnonzero(flat >= HASHED)
        number = flat[place] - HASHED
        first = np.searchsorted(place, begin)
        hits = np.diff(np.append(first, len(place)))
        slots, width = self.slots.ravel(), self.often.shape[1]
        for a in range(0, len(part), step):
            p, k = part[a : a + step], item[a : a + step]
            size = self.stretch[k]
            row = np.repeat(np.arange(len(p)), hits[p])
            at = np.arange(len(row)) + np.repeat(first[p] - (np.cumsum(hits[p]) - hits[p]), hits[p])
            slot = slots[np.repeat(k * self.slots.shape[1], hits[p]) + number[at]]
            some = np.flatnonzero(slot >= 0)
            row, at, slot = row[some], at[some], slot[some]
            pieces_ = np.maximum(1, -(-size_of[p] // size) - 1)  # each from a multiple of the size, of twice the size
            base = np.cumsum(pieces_ + 1) - (pieces_ + 1)
            j = (place[at] - begin[p[row]]) // size[row]
            counts = np.bincount((base[row] + j) * width + slot, minlength=(pieces_ + 1).sum() * width).reshape(-1, width)
            own = np.repeat(np.arange(len(p)), pieces_)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces_) - pieces_, pieces_)
            held = np.minimum(counts[base[own] + nth] + counts[base[own] + nth + 1], self.often[k[own]])
            count, tail = held.sum(axis=1), np.minimum(held, self.often_last[k[own]]).sum(axis=1)
            length = self.length[k[own]]
            keep = np.flatnonzero((count >= SURE * length) | ((count >= LIKELY * length) & (2 * tail > np.minimum(ANSWER, length))))
            out.append((p[own[keep]], k[own[keep]], nth[keep] * size[own[keep]]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (part, item, part)

    def search(self, units: list[np.ndarray], items: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(unit number, cosine, first and last word) of each run of windows above COSINE. units: feature numbers, each with an item."""
        blocks = np.array([-(-len(x) // BLOCK) for x in units])
        blocks = np.where(blocks > 16, -(-blocks // 16) * 16, blocks)  # so that there are not too many sizes
        widths = np.minimum(self.widths[items], blocks)
        order = np.lexsort((widths, blocks))
        cuts = np.flatnonzero((np.diff(blocks[order]) != 0) | (np.diff(widths[order]) != 0)) + 1
        for same in np.split(order, cuts):
            n, width = int(blocks[same[0]]), int(widths[same[0]])
            for a in range(0, len(same), step := max(1, 4096 // n)):
                own = same[a : a + step]
                words = np.full((len(own), n * BLOCK), self.features.size)  # which has a vector of zeros
                for row, k in zip(words, own):
                    row[: len(units[k])] = units[k]
                sums = np.zeros((len(own), n + 1, self.vectors.shape[1]), np.float32)
                words = words.reshape(-1, BLOCK)
                parts = np.empty((len(words), self.vectors.shape[1]), np.float32)
                for x in range(0, len(words), 256):  # few enough to stay in the cache
                    np.add.reduce(np.take(self.vectors, words[x : x + 256], axis=0, mode="clip"), axis=1, out=parts[x : x + 256])
                sums[:, 1:] = parts.reshape(len(own), n, -1)
                np.cumsum(sums, axis=1, out=sums)
                z = sums[:, width:] - sums[:, :-width]
                cosine = (z @ self.latent[items[own]][:, :, None])[:, :, 0] / np.maximum(np.sqrt(np.einsum("ijk,ijk->ij", z, z)), 1e-9)
                row, place = np.nonzero(cosine >= COSINE)
                cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(place) > width)) + 1
                for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(row)]):
                    if x < y:
                        k = int(own[row[x]])
                        yield k, float(cosine[row[x], place[x:y]].max()), int(place[x]) * BLOCK, min(len(units[k]), int(place[y - 1] + width) * BLOCK)

    def search_words(self, numbers: np.ndarray, item: int) -> Iterator[tuple[float, int, int]]:
        """(cosine, first and last word) of each run of windows that hold LIKELY of the item's words."""
        own = np.array(self.codes[item])
        n, size = len(numbers), _stretch(len(own))
        hits = np.concatenate([[0], np.cumsum(np.isin(numbers, own))])
        start = np.arange(max(1, n - size + 1))
        start = start[hits[np.minimum(start + size, n)] - hits[start] >= LIKELY * len(own)]
        for run in np.split(start, np.flatnonzero(np.diff(start) > size) + 1) if len(start) else ():
            a, b = int(run[0]), min(n, int(run[-1]) + size)
            z = self.vectors[numbers[a:b]].sum(axis=0)
            yield float(z @ self.latent[item] / max(1e-9, np.linalg.norm(z))), a, b

    def found(self, numbers: list[np.ndarray]) -> Iterator[tuple[int, int, float, int, int]]:
        """Both searches, over the stretches of texts that can hold items."""
        step = int(self.stretch.max())
        cut = [(t, a) for t, x in enumerate(numbers) for a in range(0, max(1, len(x) - step), step)]
        parts = [numbers[t][a : a + 2 * step] for t, a in cut]
        part, item, start = self.near(parts, self.possible(parts))
        good = self.held[item] >= HELD
        if good.any():
            text, offset = np.array(cut).T
            text, k, begin = text[part[good]], item[good], offset[part[good]] + start[good]
            order = np.lexsort((begin, k, text))
            text, k, begin = text[order], k[order], begin[order]
            # Stretches of one item that overlap are searched as one, of LONGEST words and a stretch at most.
            apart = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(k) != 0) | (np.diff(begin) > 2 * self.stretch[k[1:]])])
            run = np.cumsum(apart) - 1
            far = (begin - begin[apart][run]) // LONGEST
            first = np.flatnonzero(apart | np.concatenate([[True], np.diff(far) != 0]))
            last = np.append(first[1:], len(k)) - 1
            units = [numbers[t][a:b] for t, a, b in zip(text[first].tolist(), begin[first].tolist(), (begin[last] + 2 * self.stretch[k[last]]).tolist())]
            for i, cosine, a, b in self.search(units, k[first]):
                x = int(begin[first[i]])
                yield int(text[first[i]]), int(k[first[i]]), cosine, x + a, x + b
        for p, k, s in zip(part[~good].tolist(), item[~good].tolist(), start[~good].tolist()):
            t, x = cut[p]
            for cosine, a, b in self.search_words(numbers[t][x + s : x + s + 2 * int(self.stretch[k])], k):
                yield t, k, cosine, x + s + a, x + s + b

    def matches(self, numbers: list[np.ndarray]) -> list[list[tuple[int, float, float, bool, int, int]]]:
        """For each text, given by its words' feature numbers, (item_id, cosine, coverage, answer found, first and last word) of the items that it holds."""
        best: list[dict[int, tuple]] = [{} for _ in numbers]
        some = [i for i, x in enumerate(numbers) if len(x)]
        for t, k, cosine, a, b in self.found([numbers[i] for i in some]) if some and self.codes else ():
            words, item, found = numbers[some[t]], self.codes[k], best[some[t]]
            # A run is checked in overlapping stretches not much longer than the item, so words strewn about don't add up.
            a, b, size = max(0, a - BLOCK), min(len(words), b + BLOCK), _stretch(len(item))
            slot = np.where(words[a:b] >= HASHED, self.slots[k, np.maximum(words[a:b] - HASHED, 0)], -1)
            at = np.flatnonzero(slot >= 0)
            hits = list(zip((at + a).tolist(), map(self.masks[k].__getitem__, words[a:b][at].tolist())))
            for s in range(a, max(a + 1, b - size + size // 4), max(1, size // 4)):
                own = [x for x in hits if s <= x[0] < s + size]
                if len(own) < LIKELY * len(item):
                    continue
                length, _, last = grown(len(item), own)
                cover = length / len(item)
                if cover < LIKELY or (k in found and cover <= found[k][2]):
                    continue
                # Read backwards from there, the passage's last growth is its beginning.
                first = last - common_subsequence(item[::-1], words[s : last + 1][::-1].tolist())[2]
                tail = item[-ANSWER:]
                answer = 2 * common_subsequence(tail, words[first : min(b, s + size)].tolist())[0] > len(tail)
                if cover >= SURE or answer:
                    found[k] = (self.ids[k], cosine, cover, answer, first, last)
        return [list(x.values()) for x in best]


def build(docs: DataFrame, ids: list[int], texts: list[bytes]) -> tuple[Index, Scratch, DataFrame]:
    """The index of items, and the scratch and table of the documents' feature_numbers, which the caller drops."""
    number, h, ends = hashes(texts)
    words = np.split(h[number], ends[1:-1]) if texts else []
    keep = [i for i, w in enumerate(words) if len(w)]
    ids, words = [ids[i] for i in keep], [words[i] for i in keep]
    features = Features(np.unique(h[number]))
    scratch = Scratch(docs.sparkSession, "words")
    written = scratch.put(feature_numbers(docs, features), "words")
    counts = document_frequencies(written, features)
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 1)).astype(np.float32) + 0.1
    at = [features(w) for w in words]
    weight = min(1, WEIGHED / max(1, counts[-1]))
    vectors = latent_space(written, at, features, idf, weight) * idf[:, None] if words else np.zeros((features.size, 1), np.float32)
    latent = np.array([vectors[a].sum(axis=0) for a in at], np.float32).reshape(len(at), vectors.shape[1])
    lengths = np.array([np.linalg.norm(np.bincount(a, idf[a])) for a in at])
    held = np.linalg.norm(latent, axis=1) / np.maximum(lengths, 1e-9)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    # Three widths are enough: the window holds the item with its blocks' ends.
    widths = np.array([next((x for x in (3, 5, 8) if x * BLOCK >= len(w) + BLOCK // 2), -(-len(w) // BLOCK) + 1) for w in words], np.int64)
    entries = [np.unique(a - HASHED, return_counts=True) for a in at]
    word = np.concatenate([w for w, _ in entries]) if at else np.empty(0, np.int64)
    holders = np.repeat(np.arange(len(at)), [len(w) for w, _ in entries])
    times = np.concatenate([n for _, n in entries]) if at else np.empty(0, np.int64)
    common = np.argsort(-np.bincount(word, minlength=len(features.own)), kind="stable")[:COMMON]
    table = np.zeros((len(common), len(at)), np.float32)
    place = np.full(len(features.own), -1)
    place[common] = np.arange(len(common))
    known = place[word] >= 0
    table[place[word[known]], holders[known]] = times[known]
    by = np.argsort(word[~known], kind="stable")
    first = np.searchsorted(word[~known][by], np.arange(len(features.own) + 1))
    slots = np.full((len(at), len(features.own)), -1, np.int16 if max(map(len, words), default=0) < 1 << 15 else np.int32)
    often = np.zeros((2, len(at), max((len(w) for w, _ in entries), default=0)), np.int32)
    for i, (w, n) in enumerate(entries):
        slots[i, w] = np.arange(len(w))
        often[0, i, : len(w)] = n
        often[1, i, : len(w)] = np.bincount(slots[i, at[i][-ANSWER:] - HASHED], minlength=len(w))
    codes = [a.tolist() for a in at]
    length = np.array([len(w) for w in words], np.int64)
    stretch = np.array([_stretch(n) + 2 * BLOCK for n in length.tolist()], np.int64)
    index = Index(features, np.vstack([vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32), ids, latent, widths, held, codes, [places(c) for c in codes], common, table, first, holders[~known][by], times[~known][by], slots, *often, length, stretch)
    return index, scratch, written


def _groups(benchmark: DataFrame) -> Iterator[tuple[list[int], list[bytes]]]:
    """The items in groups, in the order of their ids; one group is on the driver at a time."""
    rows = benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text")
    ids, texts = [], []
    for r in rows.toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text.encode())
        if len(ids) == MOST_ITEMS:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Index, Scratch, DataFrame]]:
    """The indexes to search, with each item in one of them, and what build gives with them."""
    for ids, texts in _groups(benchmark):
        yield build(docs, ids, texts)


MATCHES = "doc_id long, item_id long, cosine double, coverage double, answer boolean, first_word int, last_word int"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, coverage, answer, first_word, last_word): which documents hold which items."""
    out = None
    for found, scratch, words in indexes(docs, benchmark):
        index = docs.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.int32()]
            for batch in batches:
                found = [x for some in _numbers(batch, own.features, SLICE // 4) for x in own.matches(some)]
                rows = [(doc, *m) for doc, x in zip(batch.column(1).to_pylist(), found) for m in x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in MATCHES.split(", ")])

        part = scratch.put(words.mapInArrow(trimmed(run), MATCHES), "matches")
        scratch.drop("words")
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], MATCHES) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; rows and columns are otherwise unchanged."""
    names = docs.columns
    for found, scratch, _ in indexes(docs, benchmark):
        scratch.drop("words")
        index = docs.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                texts = utf8(batch.column(names.index("text")))
                yield batch.filter(pa.array([not x for a, b in slices(batch, texts, SLICE) for x in own.matches(own.features.read(texts[a:b]))], pa.bool_()))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs
