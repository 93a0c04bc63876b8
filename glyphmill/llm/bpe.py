"""Byte-level BPE encoding by speculation, and decoding.

A pre-token is first cut greedily into the longest vocabulary entries. The cut equals the result of the
merges exactly if every two neighbours in it stay apart when merged alone, so all neighbouring pairs
of a batch are tested at once with array operations, and only pre-tokens with a failing pair go
through the merges themselves.

The vocabulary file is a parameter and is opened by each Python worker; nothing is trained. Texts that
are null count as empty and give no ids. The strings of special tokens in a text become those tokens.
Bytes that are no UTF-8 after decoding become U+FFFD, as in a lossy conversion.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glyphmill.llm.common import slices, trimmed, utf8

#: The pre-token pattern of byte-level BPE, white space written as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MOST_CACHED = 300_000
SLICE = 2 << 20


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        text = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
        self.id_of = {text[t]: k for t, k in vocab.items() if t in text}
        size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * size
        for b, k in self.id_of.items():
            self.bytes_of[k] = b
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, k in self.special.items():
            self.bytes_of[k] = t.encode()
        # The longest entry that begins with three given bytes.
        self.longest: dict[bytes, int] = {}
        for b in self.id_of:
            self.longest[b[:3]] = max(len(b), self.longest.get(b[:3], 0))
        # Ranks are the order of the merges; a byte has none and is its own two halves.
        self.rank_of: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_at = np.full(size, -1, np.int64)
        self.halves = np.column_stack([np.arange(size)] * 2)
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (m.split(" ") if isinstance(m, str) else m)
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank_of[x, y] = (r, z)
            if self.made_at[z] < 0:
                self.made_at[z] = r
                self.halves[z] = x, y
        keys = np.array([x << 32 | y for x, y in self.rank_of], np.int64)
        ranks = np.array([r for r, _ in self.rank_of.values()], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.short_ranks = {x << 32 | y: r for (x, y), (r, _) in self.rank_of.items()}
        self.made_by = {r: z for r, z in self.rank_of.values()}

    # -- speculation and verification

    def greedy(self, word: bytes) -> list[int]:
        """The longest vocabulary entry at each place, from the left."""
        out, i, n, ids = [], 0, len(word), self.id_of
        while i < n:
            for j in range(min(n, i + self.longest.get(word[i : i + 3], 2)), i, -1):
                k = ids.get(word[i:j])
                if k is not None:
                    out.append(k)
                    i = j
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of left + right ends in exactly [left, right], for arrays of ids.

        Walks back through the merges of both: at each step the inner halves that faced each other
        must not have had a merge of their own that came before the step's merge. On equal ranks the
        merge further left comes first.
        """
        left, right = left.astype(np.int64), right.astype(np.int64)
        good = np.ones(len(left), bool)
        limit = np.full(len(left), 1 << 40, np.int64)  # merges of a lower rank would have come first
        todo = np.arange(len(left))
        while len(todo):
            a, b = left[todo], right[todo]
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], 1 << 41)
            bad = rank < limit[todo]
            good[todo[bad]] = False
            todo, a, b = todo[~bad], a[~bad], b[~bad]
            ra, rb = self.made_at[a], self.made_at[b]
            whole = (ra < 0) & (rb < 0)  # two bytes: nothing is left to undo
            todo, a, b, ra, rb = todo[~whole], a[~whole], b[~whole], ra[~whole], rb[~whole]
            undo_left = ra > rb  # the later merge is undone first; of equal ones the right
            limit[todo] = np.where(undo_left, ra, rb + 1)
            left[todo] = np.where(undo_left, self.halves[a, 1], a)
            right[todo] = np.where(undo_left, b, self.halves[b, 0])
        return good

    def merged(self, word: bytes) -> list[int]:
        """The exact result: the lowest-ranked merge first, of equal ones the leftmost."""
        return self._merged_short(word) if len(word) <= 64 else self._merged_long(word)

    def _merged_short(self, word: bytes) -> list[int]:
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        rank, none = self.short_ranks.get, 1 << 40
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [self.made_by[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merged_long(self, word: bytes) -> list[int]:
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        before = list(range(-1, len(ids) - 1))
        after = [*range(1, len(ids)), -1]
        heap = [(self.rank_of[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            found = self.rank_of.get((ids[i], ids[j])) if j >= 0 else None
            if not found or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := self.rank_of.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (p[0], a))
        return [k for k in ids if k >= 0]

    def learn(self, needed: set[str]) -> None:
        """Put the ids of pre-tokens into the cache: propose, test all pairs, merge those that fail."""
        if len(self.cache) > MOST_CACHED:
            self.cache = {w: self.cache[w] for w in needed if w in self.cache}
        words = [w for w in needed if w not in self.cache]
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guess = [self.greedy(b) for b in raw]
        flat = np.fromiter(chain.from_iterable(guess), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(g) for g in guess])
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique(flat[:-1][inner] << 32 | flat[1:][inner], return_inverse=True)
        fails = ~self.apart(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        for k in set(owner[1:][inner][fails].tolist()):
            guess[k] = self.merged(raw[k])
        self.cache.update((w, tuple(g)) for w, g in zip(words, guess))

    # -- texts

    def encode_batch(self, texts: list[str], special: bool = True) -> list[list[int]]:
        """The texts' ids. special: strings of special tokens become those, else they are ordinary text."""
        split = self.split_special if special else None
        parts = [[self.pattern.findall(t)] if split is None or not split.search(t) else [s if s in self.special else self.pattern.findall(s) for s in split.split(t)] for t in texts]
        self.learn(set(chain.from_iterable(p for own in parts for p in own if isinstance(p, list))))
        known = self.cache
        out = []
        for own in parts:
            ids: list[int] = []
            for p in own:
                if isinstance(p, list):
                    ids.extend(chain.from_iterable(map(known.__getitem__, p)))
                else:
                    ids.append(self.special[p])
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", decode: bool = True) -> DataFrame:
    """(key, ids) for every row of docs (key, text), and the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(batch, texts, SLICE):
                ids = bpe.encode_batch([t.decode("utf-8", "replace") for t in texts[a:b]])
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                if decode:
                    columns.append(pa.array([bpe.decode(i) for i in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "ids", "decoded"][: 3 if decode else 2]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(trimmed(run), f"{key} {kind}, ids array<int>" + ", decoded string" * decode)
