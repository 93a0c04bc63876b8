"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows that mark toxic text and one on windows of
ordinary text. A window is compressed with each of them between fixed carrier bytes that both
dictionaries hold, so that only the window itself makes the lengths differ. The gain of a window is
its length under the ordinary dictionary less that under the toxic one; a document is judged by its
largest gain and by how many windows reach the calibrated thresholds.

Training reads a bounded sample of labelled rows (`most_toxic`, `most_ordinary`, `longest`); scoring
reads every window of every text. Null and empty texts hold no window and get the score of a
document without gains. Labels that are null or neither 0 nor 1 are ignored; a document labelled
twice counts as toxic if one label says so. Without toxic or ordinary training rows every score is 0.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import crc_of_id, pieces, trimmed, utf8

EDGES = b".,;:!?*%$&#()[]{}<>\"'-"
#: Both dictionaries end in it; a window is compressed between it and its first bytes, as
#: zstandard looks for no match in the last eight bytes of its input.
CARRIER = b"\x01carrier of the window that is to be measured\x02"
MOST_CACHED = 400_000


@dataclass(frozen=True)
class Settings:
    most_toxic: int = 3000  # labelled rows at most that are read to learn
    most_ordinary: int = 9000
    longest: int = 20_000  # longer labelled texts aren't learned from
    toxic_bytes: int = 2048
    ordinary_bytes: int = 8192
    threshold: float = 0.3


def windows(text: bytes) -> Iterator[bytes]:
    for piece in pieces(text):
        yield from piece.lower().split()


class Gauge:
    """Gains of windows under a pair of dictionaries. Gains of windows seen lately are kept."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        params = zstandard.ZstdCompressionParameters(
            window_log=15, chain_log=12, hash_log=12, search_log=5, min_match=3, target_length=32,
            strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        self.compressors = []
        for content in (toxic, ordinary):
            d = zstandard.ZstdCompressionDict(content + CARRIER + CARRIER[:24], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        self.bare = self.length(0, b"\x03\x04\x05\x06") - 4
        self.clean: dict[bytes, int] = {}
        gains = self

        class Seen(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= MOST_CACHED:
                    self.clear()
                self[word] = g = gains.gain(word.strip(EDGES))
                return g

        self.seen = Seen()

    def length(self, k: int, core: bytes) -> int:
        return len(self.compressors[k].compress(CARRIER + b" " + core + b" " + CARRIER[:12]))

    def gain(self, core: bytes) -> int:
        if not core:
            return 0
        g = self.clean.get(core)
        if g is None:
            # Without a match in the toxic dictionary the window costs its own bytes, and can't gain.
            toxic = self.length(0, core)
            g = max(0, self.length(1, core) - toxic) if toxic < self.bare + len(core) else 0
            if len(self.clean) >= MOST_CACHED:
                self.clean.clear()
            self.clean[core] = g
        return g

    def features(self, text: bytes) -> list[float]:
        top, n = 0, [0, 0, 0]
        for piece in pieces(text):
            gains = Counter(map(self.seen.__getitem__, piece.lower().split()))
            top = max(top, *gains) if gains else top
            for k, least in enumerate((2, 3, 5)):
                n[k] += sum(v for g, v in gains.items() if g >= least)
        return [min(top, 8), *(math.log1p(x) for x in n)]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """Content of a dictionary trained on the samples; too few of them are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights, the constant last, by Newton steps on the penalised likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # empty: nothing was learned

    def scorer(self):
        if not self.weights:
            return lambda text: 0.0
        gauge, w = Gauge(self.toxic, self.ordinary), self.weights
        return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, w[-1] + sum(a * b for a, b in zip(w, gauge.features(text)))))))


def train(rows: list[tuple[bytes, int]], settings: Settings = Settings()) -> Model:
    """Two thirds of the labelled texts make the dictionaries, the others calibrate the thresholds."""
    rows = sorted(set(rows))
    random.Random(7).shuffle(rows)
    learn, tune = rows[: len(rows) * 2 // 3], rows[len(rows) * 2 // 3 :]
    words = lambda t: [w for w in (v.strip(EDGES) for v in windows(t)) if w]
    texts = {y: [t for t, label in learn if label == y] for y in (0, 1)}
    if not texts[0] or not texts[1] or {y for _, y in tune} != {0, 1}:
        return Model(b"", b"", ())
    rate = len(texts[0]) / len(texts[1]) / 20
    # Windows that recur in toxic text among different neighbours, which copies of one text don't have.
    least = max(3, math.ceil(0.004 * len(texts[1])))
    counts = {w: n for w, n in Counter(w for t in texts[1] for w in words(t)).items() if n >= least}
    common = Counter(w for t in texts[0] for w in set(words(t)) if w in counts)
    around: dict[bytes, set] = {w: set() for w, n in counts.items() if common[w] <= rate * n}
    for t in texts[1]:
        own = words(t)
        for before, w, after in zip([b"", *own], own, [*own[1:], b""]):
            if w in around:
                around[w].add((before, after))
    marks = {w: len(c) for w, c in around.items() if len(c) >= least and common[w] <= rate * len(c)}
    if not marks:
        return Model(b"", b"", ())
    pool = sorted(w for w, n in marks.items() for _ in range(min(n, 40)))
    random.Random(2).shuffle(pool)
    group = lambda words: [b"".join(b" %s " % w for w in words[i : i + 8]) for i in range(0, len(words), 8)]
    plain = list(islice((w for t in texts[0][:2500] for w in words(t)), 600_000))
    toxic, ordinary = _dictionary(settings.toxic_bytes, group(pool)), _dictionary(settings.ordinary_bytes, group(plain))
    gauge = Gauge(toxic, ordinary)
    x = np.array([gauge.features(t) for t, _ in tune])
    return Model(toxic, ordinary, tuple(map(float, _logistic(x, np.array([y for _, y in tune], float)))))


def labelled_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[tuple[bytes, int]]:
    """A bounded sample of labelled texts: the rows of each label with the smallest hashes, ids with remainder 2 left out."""
    y = labels.where("toxic in (0, 1)").where(crc_of_id() % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    out = []
    for label, most in ((1, settings.most_toxic), (0, settings.most_ordinary)):
        ids = y.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        got = docs.select("doc_id", "text").where(F.length("text").between(1, settings.longest)).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
        # Ids may repeat; so many texts at most.
        out += [(r.text.encode(), label) for r in got.select("text").orderBy(F.xxhash64("text"), "text").limit(most).collect()]
    return out


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text; other columns are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.scorer()
        for batch in batches:
            scores = [judge(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= settings.threshold, 1).otherwise(0))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the labelled rows of docs, then score every row."""
    return score(docs, train(labelled_rows(docs, labels, settings), settings), settings)


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without the rows that are judged toxic; rows and columns are otherwise unchanged."""
    model = train(labelled_rows(docs, labels, settings), settings)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.scorer()
        for batch in batches:
            keep = [judge(t) < settings.threshold for t in utf8(batch.column(names.index("text")))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
