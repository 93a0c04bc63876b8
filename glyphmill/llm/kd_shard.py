"""Sharding by a k-d tree over text metadata, with shards of near equal bytes.

A node that stands for several shards is cut where the bytes on the left reach its left shards' part,
along the widest dimension. The dimensions are functions of the text alone (log of its length, bytes
a character, characters a word), with a hash of the text behind them, so rows with equal texts have
equal keys and stay together. Of the dimensions, in order of width, the first is taken whose cut is
near enough to the aim; where a group of equal texts is too large for any, it is cut too, by row.

Every weighted median is found by rounds of histograms: a round aggregates the bytes of all nodes and
dimensions by bucket, with map-side combining, and brings a bounded number of sums to the driver.
Null texts count as empty. Repeated rows and ids are rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch

LAW = "bytes"
SHARDS = 24
BUCKETS = 2048
DIMENSIONS = 3
#: A cut may miss its aim by this part of a shard's bytes; the second bound is for whole groups.
NEAR, FAR = 0.003, 0.03
#: About so many rows are numbered by one task.
NUMBERED = 20_000
TOP = (1 << 62) - 1


@dataclass
class Node:
    shards: range
    cut: tuple[int, int, int] | None = None  # dimension, last key on the left, last row number of that key on the left
    left: "Node | None" = None
    right: "Node | None" = None


@dataclass
class Search:
    """The interval [low, low + width) of keys in which a cut lies, and the bytes below it."""

    aim: float
    low: int
    width: int
    below: int = 0
    inside: int = field(default=0)

    @property
    def step(self) -> int:
        return -(-self.width // BUCKETS)

    def narrow(self, sums: dict[int, int]) -> None:
        total = self.below
        for b in sorted(sums):
            if total + sums[b] >= self.aim or b == max(sums):
                self.low, self.width, self.below, self.inside = self.low + b * self.step, self.step, total, sums[b]
                return
            total += sums[b]

    def misses(self) -> tuple[float, bool]:
        """How far the better end of the interval is from the aim, and whether that is its upper end."""
        up, down = abs(self.below + self.inside - self.aim), abs(self.below - self.aim)
        return (up, True) if up <= down else (down, False)


def metadata(docs: DataFrame) -> DataFrame:
    """Sizes, checksums and dimension values of docs (doc_id, text), with a number for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.log2(F.octet_length(text) + 8.0).alias("x0"),
        (F.octet_length(text) / chars).alias("x1"),
        (chars / (F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1)).alias("x2"),
        F.shiftrightunsigned(F.xxhash64(text), 33).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )


def _keys(spark: SparkSession, meta: DataFrame) -> DataFrame:
    """Each dimension scaled to 30 bits, with 31 bits of the text's hash behind it."""
    ends = meta.agg(*(f(f"x{i}") for i in range(DIMENSIONS) for f in (F.min, F.max))).first()
    out = meta
    for i in range(DIMENSIONS):
        low, high = ends[2 * i] or 0.0, ends[2 * i + 1] or 0.0
        scaled = F.floor((F.col(f"x{i}") - low) / max(high - low, 1e-12) * float((1 << 30) - 1)).cast("long")
        out = out.withColumn(f"k{i}", F.shiftleft(scaled, 31) + F.col("tie"))
    return out.drop("x0", "x1", "x2", "tie")


def _place(node: Node, leaf) -> Column:
    """leaf(node) for the node at the bottom of the tree that a row falls to."""
    if node.cut is None:
        return F.lit(leaf(node))
    d, key, row = node.cut
    k = F.col(f"k{d}")
    return F.when((k < key) | ((k == key) & (F.col("row") <= row)), _place(node.left, leaf)).otherwise(_place(node.right, leaf))


def _rounds(rows: DataFrame, searches: list[dict[int, Search]], columns: list[Column], near: float) -> None:
    """Narrow every search until its interval holds few bytes or one key. searches: by node, then column."""
    while True:
        open_ = [(n, c) for n, own in enumerate(searches) for c, s in own.items() if s.width > 1 and (not s.inside or s.misses()[0] > near)]
        if not open_:
            return
        parts = []
        for c in sorted({c for _, c in open_}):
            low = [searches[n][c].low if (n, c) in open_ else 0 for n in range(len(searches))]
            step = [searches[n][c].step if (n, c) in open_ else 1 for n in range(len(searches))]
            width = [searches[n][c].width if (n, c) in open_ else 0 for n in range(len(searches))]
            at = lambda values: F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("node"))
            off = columns[c] - at(low)
            parts.append(F.when((off >= 0) & (off < at(width)), F.struct(F.lit(c).alias("c"), F.floor((off - F.pmod(off, at(step))) / at(step)).cast("long").alias("b"))))
        sums = rows.where("node >= 0").select("node", "size", F.explode(F.array(*parts)).alias("x")).where("x is not null")
        got: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums.groupBy("node", "x").agg(F.sum("size").alias("s")).select("node", "x.c", "x.b", "s").collect():
            got.setdefault((r.node, r.c), {})[r.b] = r.s
        for n, c in open_:
            searches[n][c].narrow(got.get((n, c), {0: 0}))


def grow(keys: DataFrame, shards: int = SHARDS) -> Node:
    """The tree, level by level; every level's nodes are cut together."""
    root = Node(range(shards))
    level = [root]
    while level := [n for n in level if len(n.shards) > 1]:
        index = {id(n): i for i, n in enumerate(level)}
        rows = keys.withColumn("node", _place(root, lambda n, index=index: index.get(id(n), -1)))
        ends = {r.node: r for r in rows.where("node >= 0").groupBy("node").agg(F.sum("size").alias("s"), *(f(f"k{d}").alias(f"{f.__name__}{d}") for d in range(DIMENSIONS) for f in (F.min, F.max))).collect()}
        searches, wide, target = [], [], []
        for i, n in enumerate(level):
            r, half = ends.get(i), len(n.shards) // 2
            total = r.s if r else 0
            target.append(total / len(n.shards))
            span = [((r[f"max{d}"] >> 31) - (r[f"min{d}"] >> 31) if r else 0) for d in range(DIMENSIONS)]
            wide.append(sorted(range(DIMENSIONS), key=lambda d, span=span: -span[d]))
            searches.append({d: Search(total * half / len(n.shards), r[f"min{d}"] if r else 0, (r[f"max{d}"] - r[f"min{d}"] + 1) if r else 1) for d in range(DIMENSIONS)})
        near = NEAR * min([t for t in target if t] or [1])
        _rounds(rows, searches, [F.col(f"k{d}") for d in range(DIMENSIONS)], near)
        split: list[tuple[int, int, Search]] = []
        for i, n in enumerate(level):
            best = next((d for d in wide[i] if searches[i][d].misses()[0] <= NEAR * target[i]), None)
            if best is None:
                best = min(wide[i], key=lambda d: searches[i][d].misses()[0])
            s = searches[i][best]
            miss, upper = s.misses()
            n.cut = (best, s.low + s.width - 1 if upper else s.low - 1, TOP)
            if miss > FAR * target[i] and s.width == 1:
                split.append((i, best, s))
        if split:
            # Groups of equal texts that no cut can leave whole are dealt by row, within their key.
            most = keys.agg(F.max("row")).first()[0]
            k = F.lit(None).cast("long")
            inner: list[dict[int, Search]] = [{} for _ in level]
            for i, d, s in split:
                inner[i][0] = Search(s.aim, 0, most + 1, s.below)
                k = F.when((F.col("node") == i) & (F.col(f"k{d}") == s.low), F.col("row")).otherwise(k)
            _rounds(rows, inner, [k], near)
            for i, d, s in split:
                at = inner[i][0]
                level[i].cut = (d, s.low, at.low + at.width - 1 if at.misses()[1] else at.low - 1)
        for n in level:
            half = len(n.shards) // 2
            n.left, n.right = Node(n.shards[:half]), Node(n.shards[half:])
        level = [x for n in level for x in (n.left, n.right)]
    return root


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "kd")
    meta = scratch.put(metadata(docs), "meta")
    keys = scratch.put(_keys(spark, meta), "keys")
    scratch.drop("meta")
    root = grow(keys, shards)
    parts = max(1, keys.count() // (shards * NUMBERED))
    out = keys.withColumn("shard", _place(root, lambda n: n.shards[0])).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    first = out.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = first.selectExpr("shard", "part", "sum(n) over (partition by shard order by part) - n as first")
    out = out.selectExpr("*", "row_number() over (partition by shard, part order by row) - 1 as place").join(first, ["shard", "part"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int"),
        (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The shard table as parquet, one folder a shard."""
    shard(docs, shards).write.mode("overwrite").partitionBy("shard").parquet(path)
