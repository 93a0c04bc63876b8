"""Shared pieces of the training-data operators: tables, scratch space, words, hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace that separates words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Long texts are cut into words piece by piece, about this many bytes at a time.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where none is set, one in the warehouse, which is shared too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch").rstrip("/")


#: Shuffle files go when the query that made them has ended, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written intermediate tables in the shared folder. They cut lineage, survive lost executors and are dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path, before = f"{self.root}/{name}", self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(**options).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(run):
    """`run`, a function of Arrow batches, which gives freed memory back at its end; workers live on for tasks of other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def fresh_name(df: DataFrame) -> str:
    """A name that no column of df begins with, whatever their case."""
    name = "own"
    while any(c.lower().startswith(name) for c in df.columns):
        name = "_" + name
    return name


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id written as text, unsigned."""
    return F.crc32(F.col(column).cast("string"))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes that end where a word ends. One longer word stays whole."""
    start, end = 0, len(text)
    while end - start > size:
        cut = start + size
        stops = [k for k in (text.find(c, cut) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0]
        if not stops:
            break
        cut = min(stops)
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def word_hashes(text: bytes, lower: bool) -> np.ndarray:
    """A 64-bit hash for each word, in order. bytes.split() and lower() know ASCII only, which is what is asked for."""
    parts = []
    for piece in pieces(text):
        words = (piece.lower() if lower else piece).split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _factors(n: int) -> np.ndarray:
    """A fixed random number for each place in a word."""
    return np.random.default_rng(31).integers(0, 1 << 64, max(64, n), np.uint64)


def distinct_words(plain: list[bytes] | pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The words of texts, end to end, as numbers; the different words with these numbers and their 64-bit hashes; and where texts begin and end."""
    if isinstance(plain, list):
        plain = pa.array(plain, pa.large_binary())
    words = pc.ascii_split_whitespace(plain.cast(pa.large_string()))
    coded = words.flatten().dictionary_encode()
    at, ends = coded.indices.to_numpy(), words.offsets.to_numpy()
    ends = ends - ends[0]
    size = pc.binary_length(coded.dictionary).to_numpy()
    if (empty := size == 0).any():  # at either end of a text
        keep = ~empty[at]
        at, ends = at[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
    some = np.flatnonzero(size)
    out = np.zeros(len(size), np.uint64)
    if len(some):
        offsets = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(size) + 1]
        data = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        start = (offsets - offsets[0])[some]
        place = np.arange(len(data)) - np.repeat(start, size[some])
        out[some] = mix(np.add.reduceat((data + np.uint64(1)) * _factors(int(size.max()))[place], start))
    return at, coded.dictionary, out, ends


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words, from the words' hashes; none if there are fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    acc = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        acc = (acc + words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def slices(batch: pa.RecordBatch, texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that together hold about `size` bytes of text."""
    return runs(list(map(len, texts)), size)


def runs(lengths: list[int], size: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)
