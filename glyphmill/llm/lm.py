"""Language-model scores: a causal self-attention model over subword ids, trained and run in numpy.

A text is its words in lower case A-Z, then one end. A word's subword ids, of a space and the word, come from a
public vocabulary. An id's probability is a mixture of two distributions:

* attention: one masked self-attention layer over the window's earlier tokens gives a distribution of
  classes of ids, and the class one of its ids;
* neighbours: the id after the id before it, with absolute discounting down to single ids.

A word's probability from its ids is that of its first id among those that can begin a word, times those of its other ids,
times that of the word's end, which is that some id that begins a word, or the text's end, comes next. So the words' probabilities add up
to 1 at most. It is mixed with the word's share among all training tokens, which counts every word, however rare.

Counts of words, ids and neighbouring ids come from every training document; so do the classes, the
distributions within classes, the layer's weights and the mixtures. Only the PAIRS most frequent neighbours have a probability of their own.
The layer is trained once on every window of every training text, in ROUNDS: each task steps through its texts from common
weights, and the tasks' weights are averaged by their windows before the next round. What the layer gave for each window before it
stepped on it, and the counts without the token itself, give the mixtures, by one histogram of ratios over all
training tokens each. Windows overlap and each token is scored once, with at least
WINDOW - STRIDE tokens before it where the text has them.

Texts are cut into words and encoded once, into blocks that hold the ids of their own words; counting, rounds and scoring read these.

The base score is that of single words with one added to each count. Frequent words, a bounded number, are
looked up where the text is read; the others are joined with the counts. Null texts count as empty and
hold just the end. Without training documents all counts are 0 and ids are equally likely. Repeated rows and ids are
rows of their own, and words of equal counts need no order. Very long texts are scored in windows like all others, a slice by itself; other columns than
doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphmill.llm.common import Scratch, crc_of_id, distinct_words, runs, trimmed

END = 50256
IDS = END + 1
TOP = 3000  # ids with a vector and a class of their own choice
CLASSES, RARE = 44, 4
WIDTH, HIDDEN = 16, 32
WINDOW, STRIDE = 32, 24
#: Of 16 parts of the training texts, the first one of each round, and the rates of their steps.
ROUNDS = ((0, 0.01), (1, 0.005), (4, 0.0025), (16, 0))
#: Windows of a step, and of the first steps of a task.
BATCH, FIRST_BATCH, FIRST_STEPS = 128, 32, 500
GROUP = 8  # windows of one product
#: Bins of a histogram of ratios, and how many of them double the ratio.
BINS, DOUBLED = 4096, 32
PART = 4096
DISCOUNT = 0.75
PAIRS = 1 << 20
HEAD = 1 << 19
SLICE, ROW = 1 << 20, 16  # bytes of a block, and what a text counts beside its own
SCORED_AT_ONCE = 128
RUN = 8 << 20
MOST_CACHED = 1_200_000


def plain(column: pa.Array) -> tuple[pa.Array, list[int]]:
    """The texts, null as empty, and their lengths in bytes."""
    texts = pc.fill_null(column, "")
    return texts, pc.binary_length(texts).to_pylist()


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run of `size`, end to end."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


@dataclass
class Texts:
    """The words of texts laid end to end, each text with its end; a word is a number."""

    number: np.ndarray
    words: np.ndarray  # of each text, its end counted


@dataclass
class Words:
    """Subword ids of words. Words have numbers, and the ids of word k are flat[first[k] : first[k] + size[k]]. Word 0 is the end."""

    hash: np.ndarray
    size: np.ndarray
    flat: np.ndarray
    first: np.ndarray

    def places(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The places in flat of the texts' ids, and where each word's begin."""
        size = self.size[t.number]
        return ragged(self.first[t.number], size), np.cumsum(size) - size


class Coder(Words):
    """The words met so far, all forgotten when they are too many."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.begins = np.array([k == END or (self.tokenizer.id_to_token(k) or "").startswith(space) for k in range(IDS)])
        self.forget()

    def forget(self) -> None:
        self.known, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.hash, self.first, self.size, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64), np.full(1, END, np.int64)

    def read(self, texts: list[bytes] | pa.Array) -> Texts:
        at, words, h, ends = distinct_words([t.lower() for t in texts] if isinstance(texts, list) else pc.ascii_lower(texts))
        if len(self.known) > MOST_CACHED:
            self.forget()
        place = np.searchsorted(self.known, h)
        here = np.minimum(place, max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[here] != h) if len(self.known) else np.arange(len(h))
        if len(new):
            new = new[np.unique(h[new], return_index=True)[1]]  # in order of the hashes
            ids, size = self.encode(words.take(pa.array(new)).to_pylist())
            numbers = len(self.size) + np.arange(len(new))
            self.first = np.append(self.first, len(self.flat) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.hash = np.append(self.hash, h[new].view(np.int64))
            self.flat = np.append(self.flat, ids)
            self.known, self.numbers = np.insert(self.known, place[new], h[new]), np.insert(self.numbers, place[new], numbers)
            here = np.searchsorted(self.known, h)
        number = self.numbers[here] if len(h) else np.empty(0, np.int64)
        return Texts(np.insert(number[at], ends[1:], 0), np.diff(ends) + 1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each word, end to end, and their numbers. Many words are encoded as one text, in which ids that hold a space show where words begin."""
        ids, sizes = [], []
        for a in range(0, len(words), 4096):
            some = words[a : a + 4096]
            joined = " " + " ".join(some)
            own = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)  # without the places in the text
            start = np.flatnonzero(self.begins[own])
            # Other white space within words could be split otherwise next to a space.
            if len(joined.split()) == len(start) == len(some) and not start[0]:
                ids.append(own)
                sizes.append(np.diff(np.append(start, len(own))))
            else:
                each = [x.ids for x in self.tokenizer.encode_batch_fast([" " + w for w in some], add_special_tokens=False)]
                sizes.append(np.array([len(x) for x in each], np.int64))
                ids.append(np.fromiter(chain.from_iterable(each), np.int64, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)


@lru_cache(maxsize=1)
def coder(vocabulary: str) -> Coder:
    """One for all tasks of a worker."""
    return Coder(vocabulary)


# -- texts in subword ids, written once


CODED = "round int, doc_id array<long>, words binary, number binary, hash binary, size binary, flat binary"


def coded(docs: DataFrame, vocabulary: str, held_out: Column | None = None) -> DataFrame:
    """Blocks of about SLICE bytes of texts of one round, -1 where they are held out, each with the ids of its own words.

    docs: (doc_id, text). They are encoded here and nowhere else: counting, every round and scoring read the blocks.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    number = sum((part >= low).cast("int") for low, _ in ROUNDS) - 1
    number = number if held_out is None else F.when(held_out, -1).otherwise(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, waiting = coder(vocabulary), {}

        def blocks(k: int, rows: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
            texts, lengths = plain(rows.column(1))
            lengths = [n + ROW for n in lengths]
            for a, b in runs(lengths, SLICE):
                if not last and sum(lengths[a:b]) < SLICE:
                    return rows.take(pa.array(range(a, b)))  # a copy, so that the others can go
                yield coded_block(code, k, rows.column(0).slice(a, b - a), code.read(texts.slice(a, b - a)))

        for batch in batches:
            number = batch.column(2).to_numpy()
            for k in np.unique(number).tolist():
                rows = batch.take(pa.array(np.flatnonzero(number == k)))
                waiting[k] = yield from blocks(k, pa.concat_batches([waiting[k], rows]) if waiting.get(k) else rows, False)
        for k, rows in waiting.items():
            if rows:
                yield from blocks(k, rows, True)

    return docs.select(F.col("doc_id").cast("long"), "text", number.alias("round")).mapInArrow(trimmed(run), CODED)


def coded_block(code: Coder, k: int, doc_ids: pa.Array, t: Texts) -> pa.RecordBatch:
    times = np.bincount(t.number)
    own = np.flatnonzero(times[1:]) + 1
    own = np.append(0, own[np.argsort(code.hash[own])])  # sorted, they are found faster
    times[own] = np.arange(len(own))
    number, size = times[t.number], code.size[own]
    flat = code.flat[ragged(code.first[own], size)]
    parts = t.words.astype(np.int32), number.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32), code.hash[own], size.astype(np.int32), flat.astype(np.uint16)
    ids = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), ids, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], [x.split()[0] for x in CODED.split(", ")])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Texts, Words]]:
    """The ids of documents, their texts and words, of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            words, number, hashes, size, flat = (batch.column(name)[k].as_buffer() for name in ("words", "number", "hash", "size", "flat"))
            words, size = np.frombuffer(words, np.int32).astype(np.int64), np.frombuffer(size, np.int32).astype(np.int64)
            number = np.frombuffer(number, np.uint16 if len(size) <= 1 << 16 else np.uint32).astype(np.int64)
            own = Words(np.frombuffer(hashes, np.int64), size, np.frombuffer(flat, np.uint16).astype(np.int64), np.cumsum(size) - size)
            yield batch.column("doc_id")[k].values, Texts(number, words), own


def in_blocks(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs, (doc_id, text) or blocks already."""
    return docs if "flat" in docs.columns else coded(docs, vocabulary)


# -- what is gathered from all training documents


def gather(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(kind, key, n): counts of words by hash (0), ids (1), pairs of neighbouring ids (2) and documents (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, pairs = [], [], []
        ids, documents = np.zeros(IDS, np.int64), 0

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

        def counted() -> Iterator[pa.RecordBatch]:
            keys, back = np.unique(np.concatenate(words), return_inverse=True)
            yield rows(0, keys, np.bincount(back, np.concatenate(counts), len(keys)).astype(np.int64))
            yield rows(1, np.flatnonzero(ids), ids[ids > 0])
            yield rows(2, *np.unique(np.concatenate(pairs), return_counts=True))
            yield rows(3, np.zeros(1, np.int64), np.array([documents]))

        coder.cache_clear()  # encoding has ended
        for _, t, block in blocks_of(batches):
            words.append(block.hash[1:])
            counts.append(np.bincount(t.number, minlength=len(block.hash))[1:])
            own = block.flat[block.places(t)[0]]
            ids += np.bincount(own, minlength=IDS)
            pairs.append(np.append(END, own[:-1]) << 32 | own)
            documents += len(t.words)
            if len(words) >= RUN // SLICE:
                yield from counted()
                words, counts, pairs = [], [], []
                ids, documents = np.zeros(IDS, np.int64), 0
        if documents:
            yield from counted()

    return in_blocks(docs, vocabulary).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Counts:
    ids: np.ndarray  # by id
    pair_keys: np.ndarray  # sorted, before << 32 | id
    pair_counts: np.ndarray
    head: np.ndarray  # sorted hashes of frequent words
    head_counts: np.ndarray
    words: int  # training tokens
    distinct: int
    documents: int


def counts_of(gathered: DataFrame) -> Counts:
    top = lambda kind, most: gathered.where(F.col("kind") == kind).orderBy(F.desc("n"), "key").limit(most).select("key", "n").toArrow()
    arrays = lambda t: (t.column("key").to_numpy(), t.column("n").to_numpy())
    totals = {r.kind: r for r in gathered.where("kind in (0, 3)").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    ids = np.zeros(IDS)
    at, n = arrays(top(1, IDS))
    ids[at] = n
    pair_keys, pair_counts = arrays(top(2, PAIRS))
    order = np.argsort(pair_keys)
    head, head_counts = arrays(top(0, HEAD))
    by = np.argsort(head)
    documents = totals[3].n if 3 in totals else 0
    words, distinct = (totals[0].n, totals[0].d) if 0 in totals else (0, 0)
    return Counts(ids, pair_keys[order], pair_counts[order].astype(float), head[by], head_counts[by], words + documents, distinct + (documents > 0), documents)


# -- the model


def _classes(c: Counts) -> tuple[np.ndarray, np.ndarray]:
    """A class for every id, and the number of its vector. Frequent ids are grouped by what comes before them."""
    by = np.argsort(-c.ids, kind="stable")
    place = np.empty(IDS, np.int64)
    place[by] = np.arange(IDS)
    before, after = c.pair_keys >> 32, c.pair_keys & 0xFFFFFFFF
    inner = (place[before] < TOP) & (place[after] < TOP)
    m = np.zeros((TOP, TOP), np.float32)
    m[place[after[inner]], place[before[inner]]] = np.sqrt(c.pair_counts[inner])
    m = np.hstack([m, m.T])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-6)
    rng = np.random.default_rng(11)
    q = np.linalg.qr(m @ (m.T @ (m @ rng.standard_normal((m.shape[1], 24)).astype(np.float32))))[0]
    x = m @ (m.T @ q)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    centres = x[np.linspace(0, TOP - 1, CLASSES).astype(int)]
    for _ in range(25):
        own = (x @ centres.T).argmax(axis=1)
        for k in range(CLASSES):
            if (own == k).any():
                centres[k] = x[own == k].mean(axis=0)
    cls = np.empty(IDS, np.int64)
    cls[by[:TOP]] = own
    rest = np.arange(TOP, IDS)
    cls[by[TOP:]] = CLASSES + np.minimum(RARE - 1, np.floor(np.log2(1 + (rest - TOP) / TOP)).astype(np.int64))
    return cls, np.where(place < TOP, place, TOP + cls)


def _softmax(x: np.ndarray, tame: bool) -> np.ndarray:
    """In place. tame: exponents need not be made smaller first."""
    if not tame:
        x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x @ np.ones((x.shape[-1], 1), x.dtype)
    return x


def _length(x: np.ndarray) -> float:
    """That of the longest row."""
    return float(np.sqrt(np.square(x).sum(axis=-1)).max())


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b over all rows. By groups of windows, as one product of so long and narrow matrices is slow, and one for each window is many."""
    whole = len(a) // GROUP * GROUP
    grouped = lambda x, n: x.reshape(-1, n * x.shape[1], x.shape[2])
    out = (grouped(a[:whole], GROUP).transpose(0, 2, 1) @ grouped(b[:whole], GROUP)).sum(axis=0)
    return out + grouped(a[whole:], len(a) - whole)[0].T @ grouped(b[whole:], len(a) - whole)[0] if whole < len(a) else out


class Attention:
    """h = soft(x A + softmax(q k' + distance) v O + b), soft(z) = z / (1 + |z|); classes = softmax(h U + c)."""

    def __init__(self, rows: int, classes: int):
        r = np.random.default_rng(3)
        n = lambda *s: (r.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        self.p = {
            "e": (r.standard_normal((rows, WIDTH)) * 0.5).astype(np.float32), "q": n(WIDTH, WIDTH), "k": n(WIDTH, WIDTH), "v": n(WIDTH, WIDTH),
            "d": np.zeros(WINDOW, np.float32), "a": n(WIDTH, HIDDEN), "o": n(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
            "u": n(HIDDEN, classes), "c": np.zeros(classes, np.float32),
        }
        away = np.arange(WINDOW)[-STRIDE:, None] - np.arange(WINDOW)[None, :]
        self.future, self.away = away < 0, np.maximum(away, 0)
        self.place = np.arange(rows * WIDTH).reshape(rows, WIDTH)

    def forward(self, rows: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Class logits of the last STRIDE places of each window. rows: the id before each place; valid: inside the text."""
        p = self.p
        # The products of weights are taken first: q k' is xs (q k') x', and what the weights w make of v goes through v o.
        x = np.take(p["e"], rows, axis=0, mode="clip")
        xs = np.ascontiguousarray(x[:, -STRIDE:])
        qk = p["q"] @ p["k"].T * np.float32(WIDTH**-0.5)
        q = (xs.reshape(-1, WIDTH) @ qk).reshape(xs.shape)
        s = q @ x.transpose(0, 2, 1)
        tame = max(float(s.max(initial=0)), -float(s.min(initial=0))) + float(np.abs(p["d"]).max()) < 80  # every place sees one of the text's at least
        s += np.where(self.future, np.float32(-1e9), p["d"][self.away])
        if len(short := np.flatnonzero(~valid.all(axis=1))):
            s[short] += np.where(valid[short], np.float32(0), np.float32(-1e9))[:, None, :]
        w = _softmax(s, tame)
        xo = np.empty((*xs.shape[:2], 2 * WIDTH), np.float32)
        xo[:, :, :WIDTH] = xs
        np.matmul(w, x, out=xo[:, :, WIDTH:])
        ao = np.vstack([p["a"], p["v"] @ p["o"]])
        h = xo.reshape(-1, 2 * WIDTH) @ ao
        h += p["b"]
        slope = np.abs(h)
        slope += 1
        np.reciprocal(slope, out=slope)
        h *= slope
        logits = h @ p["u"]
        logits += p["c"]
        return logits, (x, xs, qk, q, w, xo, ao, h, slope)

    def step(self, rows, valid, goal, begins, rate, state, t) -> tuple[np.ndarray, np.ndarray]:
        """One Adam step on the class of each scored place; goal is -1 outside the text.

        What it gave before, for the places inside: the probability of the goal, and that of an id that begins a word.
        """
        p = self.p
        if not state:  # one array for all of a kind, of which each name has a view
            self.flat = [np.zeros(sum(y.size for y in p.values()), np.float32) for _ in range(3)]
            views, a = [{} for _ in self.flat], 0
            for name, y in p.items():
                for view, of in zip(views, self.flat):
                    view[name] = of[a : a + y.size].reshape(y.shape)
                a += y.size
            self.grad = views[0]
            state |= {name: (views[1][name], views[2][name]) for name in p}
        logits, (x, xs, qk, q, w, xo, ao, h, slope) = self.forward(rows, valid)
        g, d = logits, self.grad
        if not float((np.abs(p["u"]).sum(axis=0) + np.abs(p["c"])).max()) < 80:
            g -= g.max(axis=1, keepdims=True)
        np.exp(g, out=g)
        total = g @ np.stack([np.ones(len(begins), np.float32), begins.astype(np.float32)], axis=1)
        goal = goal.reshape(-1)
        inside = np.flatnonzero(goal >= 0)
        at = inside * g.shape[1] + goal[inside]
        sums = total[inside]
        given = g.ravel()[at] / sums[:, 0], sums[:, 1] / sums[:, 0]
        each = np.float32(1 / max(1, len(inside)))
        g *= ((goal >= 0) * each / total[:, 0])[:, None].astype(np.float32)
        g.ravel()[at] -= each
        in_windows = lambda y: y.reshape(*xs.shape[:2], -1)
        ones = np.ones(len(g), np.float32)
        d["u"][:], d["c"][:] = _cross(in_windows(h), in_windows(g)), ones @ g
        dh = g @ p["u"].T
        slope *= slope
        dh *= slope
        dao = _cross(xo, in_windows(dh))
        d["a"][:], d["b"][:] = dao[:WIDTH], ones @ dh
        d["v"][:], d["o"][:] = dao[WIDTH:] @ p["o"].T, p["v"].T @ dao[WIDTH:]
        dxo = in_windows(dh @ ao.T)
        o, do = xo[:, :, WIDTH:], dxo[:, :, WIDTH:]
        ds = do @ x.transpose(0, 2, 1)
        dx = w.transpose(0, 2, 1) @ do
        # The sum of weights times their gradients is that of the output times its own.
        ds -= np.einsum("ijk,ijk->ij", o, do)[:, :, None]
        ds *= w
        d["d"][:] = np.bincount(self.away.ravel(), ds.sum(axis=0).ravel(), WINDOW)
        dx += ds.transpose(0, 2, 1) @ q
        dq = ds @ x
        dqk = _cross(xs, dq) * np.float32(WIDTH**-0.5)
        d["q"][:], d["k"][:] = dqk @ p["k"], dqk.T @ p["q"]
        dx[:, -STRIDE:] += (dq.reshape(-1, WIDTH) @ qk.T).reshape(xs.shape)
        dx[:, -STRIDE:] += dxo[:, :, :WIDTH]
        place = np.take(self.place, rows.ravel(), axis=0, mode="clip")
        d["e"][:] = np.bincount(place.ravel(), dx.ravel(), p["e"].size).reshape(p["e"].shape)
        grad, m, s2 = self.flat
        m *= np.float32(0.9)
        m += np.float32(0.1) * grad
        s2 *= np.float32(0.98)
        grad *= grad
        grad *= np.float32(0.02)
        s2 += grad
        by = np.multiply(s2, np.float32(1 / (1 - 0.98**t)), out=grad)
        np.sqrt(by, out=by)
        by += np.float32(1e-7)
        np.divide(m, by, out=by)
        by *= np.float32(rate / (1 - 0.9**t))
        for name, change in d.items():
            p[name] -= change
        return given


class Tables:
    """The trained layer with its products taken once for every vector, for scoring."""

    def __init__(self, net: Attention, begins: np.ndarray):
        p = net.p
        self.x, self.q = p["e"], p["e"] @ (p["q"] @ p["k"].T * np.float32(WIDTH**-0.5))
        self.ao, self.b, self.u, self.c = np.vstack([p["a"], p["v"] @ p["o"]]), p["b"], p["u"], p["c"]
        self.bias = np.where(net.future, np.float32(-1e9), p["d"][net.away])
        self.sums = np.stack([np.ones(len(begins)), begins], axis=1).astype(np.float32)
        # Bounds below which exponents need not be made smaller first.
        self.tame = _length(self.q) * _length(self.x) + float(np.abs(p["d"]).max()) < 80, float((np.abs(self.u).sum(axis=0) + np.abs(self.c)).max()) < 80

    def __call__(self, rows: np.ndarray, valid: np.ndarray, goals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the last STRIDE places of each window the probability of the goal's class, and that of an id that begins a word."""
        own = rows[:, -STRIDE:]
        take = lambda x, at: np.take(x, at, axis=0, mode="clip")
        x = take(self.x, rows)
        s = take(self.q, own) @ x.transpose(0, 2, 1)
        s += self.bias
        if len(short := np.flatnonzero(~valid.all(axis=1))):
            s[short] += np.where(valid[short], np.float32(0), np.float32(-1e9))[:, None, :]  # every place sees one of the text's at least
        if not self.tame[0]:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        xo = np.empty((*own.shape, 2 * WIDTH), np.float32)
        xo[:, :, :WIDTH] = x[:, -STRIDE:]
        np.divide(s @ x, s @ np.ones((WINDOW, 1), np.float32), out=xo[:, :, WIDTH:])
        h = xo.reshape(-1, 2 * WIDTH) @ self.ao
        h += self.b
        size = np.abs(h)
        size += 1
        h /= size
        e = h @ self.u
        e += self.c
        if not self.tame[1]:
            e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        total = e @ self.sums
        return e.ravel()[np.arange(0, e.size, e.shape[1]) + goals.ravel()] / total[:, 0], total[:, 1] / total[:, 0]


def paired(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A key of 32 bits for two neighbours, in the order of both."""
    return (before * IDS + after).astype(np.uint32)


def looked_up(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key of 32 bits, at most 2^32 of them, stands in the sorted `known`, and whether it does. Sorted keys are found many times faster."""
    by = keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64)
    by.sort()
    at = np.empty(len(keys), np.int64)
    at[by.astype(np.uint32)] = np.searchsorted(known, (by >> np.uint64(32)).astype(np.uint32))
    at = np.minimum(at, len(known) - 1)
    return at, known[at] == keys


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end, with these lengths: each window's places, and whether they are inside its text.

    A window's last STRIDE places are scored, those before are context; places outside are given as 0.
    """
    n = -(-lengths // STRIDE)
    text = np.repeat(np.arange(len(lengths)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    at = first[:, None] + np.arange(WINDOW) - (WINDOW - STRIDE)
    inside = (at >= 0) & (at < lengths[text][:, None])
    return np.where(inside, at + (np.cumsum(lengths) - lengths)[text][:, None], 0), inside


@dataclass
class Model:
    vocabulary: str
    counts: Counts
    cls: np.ndarray
    row: np.ndarray
    within: np.ndarray  # probability of an id in its class
    single: np.ndarray  # probability of an id
    held_back: np.ndarray  # of each id, the mass its neighbours leave to single ids
    pair_part: np.ndarray
    pairs: np.ndarray  # the neighbours' keys in 32 bits
    begin_near: np.ndarray  # of each id, the probability that an id that begins a word comes next
    begin_class: np.ndarray  # of each class, the part of ids that begin words
    net: Attention
    mixture: float = 0.5
    whole: float = 0.5  # weight of the words' shares

    def near(self, before: np.ndarray, ids: np.ndarray, own: int = 0) -> np.ndarray:
        """The neighbours' probabilities of ids after those before them. own: so often a pair is in the counts by the text itself, which isn't counted then."""
        out = self.single[ids] * self.held_back[before]
        c = self.counts
        if len(c.pair_keys):
            at, found = looked_up(self.pairs, paired(before, ids))
            if not own:
                return out + np.where(found, self.pair_part[at], 0)
            n, total = np.where(found, c.pair_counts[at], 0), np.maximum(c.ids[before], 1)
            out += self.single[ids] * np.minimum(own, np.maximum(n - DISCOUNT, 0)) / total
            out += np.maximum(n - own - DISCOUNT, 0) / np.maximum(total - own, 1)
        return out

    def attention(self, before: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The layer's probabilities of ids, for texts of these lengths laid end to end, and of ids that begin words in their place."""
        at, inside = windows(lengths)
        out, begin = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
        rows, goals, tables = self.row[before], self.cls[ids], Tables(self.net, self.begin_class)
        for a in range(0, len(at), SCORED_AT_ONCE):
            place, ok = at[a : a + SCORED_AT_ONCE], inside[a : a + SCORED_AT_ONCE]
            own, scored = place[:, -STRIDE:], ok[:, -STRIDE:].ravel()
            p, s = tables(rows[place], ok, goals[own])
            own = own.ravel()[scored]
            out[own], begin[own] = p[scored], s[scored]
        return out * self.within[ids], begin

    def parts(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The two probabilities of every token of the texts, laid end to end."""
        flat, lengths = np.concatenate(ids), np.array([len(x) for x in ids])
        before = np.concatenate([[END], flat[:-1]])
        before[np.cumsum(lengths) - lengths] = END
        return self.attention(before, flat, lengths)[0], self.near(before, flat)

    def laid(self, code: Words, t: Texts, near: np.ndarray, own: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' ids, those before them, the numbers of ids, where words begin, and the neighbours' probabilities. near: of all that the coder holds."""
        at, first = code.places(t)
        ids = code.flat[at]
        before = np.append(END, ids[:-1])
        lengths = np.add.reduceat(code.size[t.number], np.cumsum(t.words) - t.words)
        close = near[at]
        close[first] = self.near(before[first], ids[first], own)
        return ids, before, lengths, first, close

    def made(self, t: Texts, before: np.ndarray, first: np.ndarray, close: np.ndarray, attention: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Of every word and end, the log10 of its probability from its ids."""
        p = np.log10(self.mixture * attention + (1 - self.mixture) * close + 1e-300)
        begin = np.log10(self.mixture * begin[first] + (1 - self.mixture) * self.begin_near[before[first]] + 1e-300)
        ended = np.append(begin[1:], 0.0)
        ended[np.cumsum(t.words) - 1] = 0  # nothing comes after a text's end
        return np.maximum(np.add.reduceat(p, first) - begin + ended, -280)

    def kept(self, code: Words, own: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """What depends on a word alone, for all words: the neighbours' part of its inner ids, and its count among the frequent words, -1 for others."""
        near = self.near(np.append(END, code.flat[:-1]), code.flat, own)
        head = self.counts.head
        at = np.minimum(np.searchsorted(head, code.hash), max(0, len(head) - 1))
        n = np.where(head[at] == code.hash, self.counts.head_counts[at], -1.0) if len(head) else np.full(len(code.hash), -1.0)
        n[0] = self.counts.documents
        return near, n


def ratios(x: np.ndarray) -> np.ndarray:
    """A histogram of the ratios, by their logarithms."""
    with np.errstate(divide="ignore"):
        at = np.rint(np.clip(np.log2(x) * DOUBLED, -BINS // 2, BINS // 2 - 1)).astype(np.int64) + BINS // 2
    return np.bincount(at, minlength=BINS)


def weight_of(histogram: np.ndarray, most: float) -> float:
    """The most likely weight of the first of two distributions, from a histogram of the ratios of their probabilities."""
    x, out = 2.0 ** ((np.arange(BINS) - BINS // 2) / DOUBLED), 0.5
    for _ in range(100 if histogram.any() else 0):
        out = float(np.clip((histogram * (out * x / (out * x + 1 - out))).sum() / histogram.sum(), 0.01, most))
    return out


def untrained(counts: Counts, vocabulary: str) -> Model:
    code = coder(vocabulary)
    cls, row = _classes(counts)
    single = (counts.ids + 0.5) / (counts.ids + 0.5).sum()
    of_class = np.bincount(cls, single, CLASSES + RARE)
    before, after = counts.pair_keys >> 32, counts.pair_keys & 0xFFFFFFFF
    total = np.maximum(np.bincount(before, counts.pair_counts, IDS), counts.ids)
    part = np.maximum(counts.pair_counts - DISCOUNT, 0) / total[before] if len(before) else np.empty(0)
    held_back = 1 - np.bincount(before, part, IDS)
    begins = code.begins.astype(float)
    begin_near = np.bincount(before, part * begins[after], IDS) + held_back * (single * begins).sum()
    net = Attention(TOP + CLASSES + RARE, CLASSES + RARE)
    net.p["c"][:] = np.log(of_class + 1e-9)
    return Model(vocabulary, counts, cls, row, single / of_class[cls], single, held_back, part, paired(before, after), begin_near, np.bincount(cls, single * begins, CLASSES + RARE) / np.maximum(of_class, 1e-300), net)


class Learner:
    """A task's part of a round: its own weights, and the histograms."""

    def __init__(self, base: Model, weights: dict[str, np.ndarray], rate: float):
        net = Attention(*base.net.p["e"].shape[:1], *base.net.p["c"].shape)
        net.p = {k: x.copy() for k, x in weights.items()}
        self.model, self.rate, self.state, self.steps, self.windows = replace(base, net=net), rate, {}, 0, 0
        self.begins = base.begin_class.astype(np.float32)
        self.rng, self.mixture, self.whole = np.random.default_rng(4), np.zeros(BINS), np.zeros(BINS)

    def read(self, code: Words, t: Texts) -> None:
        m = self.model
        near, n = m.kept(code, 1)
        ids, before, lengths, first, close = m.laid(code, t, near, 1)
        at, inside = windows(lengths)
        rows, goals = m.row[before], m.cls[ids]
        attention, begin = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
        order, a = self.rng.permutation(len(at)), 0
        while a < len(order):
            self.steps += 1
            some = order[a : a + (FIRST_BATCH if self.steps <= FIRST_STEPS else BATCH)]
            a += len(some)
            place, ok = at[some], inside[some]
            own, scored = place[:, -STRIDE:], ok[:, -STRIDE:]
            given = m.net.step(rows[place], ok, np.where(scored, goals[own], -1), self.begins, self.rate, self.state, self.steps)
            own = own[scored]
            attention[own], begin[own] = given
        self.windows += len(at)
        attention *= m.within[ids]
        self.mixture += ratios(attention / close)
        m.mixture = weight_of(self.mixture, 0.99)  # so far
        made = 10.0 ** m.made(t, before, first, close, attention, begin)
        self.whole += ratios(np.maximum(n[t.number] - 1, 0) / max(1, m.counts.words) / made)

    def sums(self) -> np.ndarray:
        weights = np.concatenate([x.ravel() for _, x in sorted(self.model.net.p.items())])
        return np.concatenate([[self.windows], self.mixture, self.whole, weights.astype(float) * self.windows])


def fit(counts: Counts, train: DataFrame | None, vocabulary: str) -> Model:
    """The model, its layer and mixtures fitted on all texts of train, (doc_id, text) or blocks."""
    model = untrained(counts, vocabulary)
    if not train or not counts.documents:
        return model
    sent = train.sparkSession.sparkContext.broadcast(model)
    weights, mixture, whole = model.net.p, np.zeros(BINS), np.zeros(BINS)
    blocks = in_blocks(train, vocabulary)
    names, schema = ["block", "task", "part"], "block int, task int, part binary"
    for number, (_, rate) in enumerate(ROUNDS[:-1]):
        common = train.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], common=common, rate=rate) -> Iterator[pa.RecordBatch]:
            learner = Learner(sent.value, common.value, rate)
            for _, t, words in blocks_of(batches):
                learner.read(words, t)
            if learner.windows:
                sums, task = learner.sums(), TaskContext.get().partitionId()
                parts = [sums[a : a + PART].tobytes() for a in range(0, len(sums), PART)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, part in zip(batch.column(0).to_pylist(), batch.column(2)):
                    totals[k] = totals.get(k, 0) + np.frombuffer(part.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.nulls(len(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names)

        parts = blocks.where(F.col("round") == number).mapInArrow(trimmed(run), schema)
        parts = parts.repartition("block").sortWithinPartitions("block", "task").mapInArrow(trimmed(added), schema)
        found = sorted((r.block, bytes(r.part)) for r in parts.collect())
        common.unpersist()
        if found:
            sums = np.frombuffer(b"".join(x for _, x in found))
            mixture, whole = mixture + sums[1 : 1 + BINS], whole + sums[1 + BINS : 1 + 2 * BINS]
            mean, weights, a = (sums[1 + 2 * BINS :] / sums[0]).astype(np.float32), dict(weights), 0
            for name, x in sorted(weights.items()):
                weights[name] = mean[a : a + x.size].reshape(x.shape)
                a += x.size
    sent.unpersist()
    model.net.p, model.mixture, model.whole = weights, weight_of(mixture, 0.99), weight_of(whole, 0.95)
    return model


SCORED = "doc_id long, n_tokens long, n_head long, head_sum double, score double, rest array<long>, made array<double>"


def score(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held_out = F.coalesce(crc_of_id() % 7 == 2, F.lit(False))
    blocks = scratch.put(coded(docs, vocabulary, held_out), "blocks")
    train = blocks.where("round >= 0")
    gathered = scratch.put(gather(train, vocabulary), "counts")
    counts = counts_of(gathered)
    model = spark.sparkContext.broadcast(fit(counts, train, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tokens = max(1, m.counts.words)
        for doc_ids, t, words in blocks_of(batches):
            near, n = m.kept(words)
            known, n = n[t.number] >= 0, np.maximum(n[t.number], 0)
            ids, before, sizes, begun, close = m.laid(words, t, near)
            made = (1 - m.whole) * 10.0 ** m.made(t, before, begun, close, *m.attention(before, ids, sizes))
            first = np.cumsum(t.words) - t.words
            per_text = lambda x, first=first: np.add.reduceat(x, first)
            word = t.number > 0
            rest = ~known
            ends = np.append(0, np.cumsum(per_text(rest.astype(np.int64)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(t.words), pa.array(per_text((known & word).astype(np.int64))),
                 pa.array(per_text(np.where(known & word, np.log10(n + 1.0), 0.0))), pa.array(per_text(np.log10(m.whole * n / tokens + made))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(words.hash[t.number[rest]])), pa.ListArray.from_arrays(pa.array(ends), pa.array(made[rest]))],
                [x.split()[0] for x in SCORED.split(", ")],
            )

    scored = blocks.mapInArrow(trimmed(run), SCORED)
    scored = scratch.put(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    fitted = model.value.whole
    known = gathered.where("kind = 0").select(F.col("key").alias("word"), "n")
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "made")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.made").alias("made")).join(known, "word")
    share = F.lit(fitted / max(1, counts.words)) * F.col("n")
    rest = rest.groupBy("row").agg(F.count("*").alias("n_rest"), F.sum(F.log10(F.col("n") + 1.0)).alias("rest_sum"), F.sum(F.log10(1 + share / F.col("made"))).alias("more"))
    rest = scratch.put(rest, "rest")
    scratch.drop("counts", "blocks")
    per_token = math.log10(counts.words + counts.distinct + 1)
    end_known, end_log = (1, math.log10(counts.documents + 1)) if counts.documents else (0, 0.0)
    out = scored.drop("rest", "made").join(rest, "row", "left")
    return out.select(
        "doc_id", held_out.alias("held_out"), "n_tokens",
        (F.col("n_head") + F.coalesce("n_rest", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(counts.words).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) + end_log - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
