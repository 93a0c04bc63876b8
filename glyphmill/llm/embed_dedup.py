"""Embedding near-duplicates by sorted projection passes.

A pass orders all vectors by the concatenated signs of random projections and compares each vector
with its next WINDOW neighbours in double precision; pairs with a cosine of THRESHOLD or more are
united, across the bounds of partitions too. Rounds of PASSES passes follow, each with fresh projections and
twice the window, until a round joins no two components, so the search grows with the number and
density of vectors. Vectors that are equal in every component are first folded into one class, so copies take one
place in a window however many there are. After the passes, links are counted within each
component, block against block, so a vector's count doesn't depend on the windows.

A vector that is null or zero, or holds a null or non-finite component, links with nothing. Vectors of
different lengths never link. Rows that repeat an id or a vector are vectors of their own. The search
is approximate: a component is lost only if all paths through it are missed in every round, the last included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch
from glyphmill.llm.components import connected_components

THRESHOLD = 0.95
PASSES = 16
BITS = 60
WINDOW = 24
#: Rows of a block in the count of links.
BLOCK = 512


def unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, scaled to length 1 in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def with_keys(classes: DataFrame, passes: int, bits: int, turn: int = 0) -> DataFrame:
    """A row for each class and pass, with the pass's key. Projections depend on round, pass and length alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)[::-1]
        for batch in batches:
            lengths = batch.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == d))
                if d not in planes:
                    planes[d] = np.random.default_rng([977, d, turn]).standard_normal((d, passes * bits))
                signs = (unit_rows(own.column(1)) @ planes[d] > 0).reshape(-1, passes, bits)
                keys = (signs * weights).sum(axis=2, dtype=np.uint64).astype(np.int64)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(np.full(len(own), p, np.int32)), pa.array(keys[:, p])], ["cls", "embedding", "length", "pass", "key"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("cls", "embedding", "length").mapInArrow(run, f"cls long, embedding {kind}, length int, pass int, key long")


def window_links(ordered: DataFrame, window: int, threshold: float) -> DataFrame:
    """Links (a, b) of rows with at most `window` rows between, within one partition's order.

    Rows that are already united within the partition make no second link, so a vector gives
    one row a pass at most. The first and last `window` rows come out too, without b and with
    what is needed to compare them across the partitions' bounds.
    """
    names = ["a", "b", "embedding", "length", "pass", "key"]
    kind = ordered.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # group, classes and vectors of the last rows
        tail, first = None, window  # the last rows as they came, and how many of the first are still to come out

        def edge(rows: pa.Table) -> list[pa.RecordBatch]:
            columns = [rows.column(0), pa.nulls(len(rows), pa.int64()), *rows.columns[1:]]
            return pa.Table.from_arrays(columns, names).to_batches()

        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for batch in batches:
            if len(batch) == 0:
                continue
            last = pa.Table.from_batches([batch])
            if first:
                yield from edge(last.slice(0, first))
                first -= min(first, len(batch))
            tail = last if tail is None else pa.concat_tables([tail, last])
            tail = tail.slice(max(0, len(tail) - window))
            group = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64) << 32 | batch.column(2).to_numpy(zero_copy_only=False)
            cls = batch.column(0).to_numpy(zero_copy_only=False)
            out = []
            for a, b in _runs(group):
                g, ids, u = group[a], cls[a:b], unit_rows(batch.column(1).slice(a, b - a))
                if held and held[0] == g:
                    ids, u = np.concatenate([held[1], ids]), np.concatenate([held[2], u])
                else:
                    parent.clear()
                for o in range(1, min(window, len(ids) - 1) + 1):
                    near = np.flatnonzero(np.einsum("ij,ij->i", u[o:], u[:-o]) >= threshold)
                    for x, y in zip(ids[near + o].tolist(), ids[near].tolist()):
                        rx, ry = root(x), root(y)
                        if rx != ry:
                            parent[max(rx, ry)] = min(rx, ry)
                            out.append((x, y))
                held = (g, ids[-window:], u[-window:])
            if out:
                pairs = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*pairs, *(pa.nulls(len(out), f.type) for f in list(batch.schema)[1:])], names)
        if tail is not None:
            yield from edge(tail)

    return ordered.mapInArrow(run, f"a long, b long, embedding {kind}, length int, pass int, key long")


def round_links(classes: DataFrame, scratch: Scratch, turn: int, threshold: float, passes: int, window: int, bits: int) -> DataFrame:
    """The links (a, b) of one round of passes, those across partition bounds included."""
    by = ("pass", "length", "key")
    ordered = with_keys(classes, passes, bits, turn).repartitionByRange(*by).sortWithinPartitions(*by)
    own = scratch.put(window_links(ordered, window, threshold), f"own-{turn}")
    edges = own.where("b is null").select(F.col("a").alias("cls"), "embedding", "length", "pass", "key").dropDuplicates(["cls", "pass"])
    across = window_links(edges.repartition("pass").sortWithinPartitions(*by), window, threshold)
    links = scratch.put(own.unionByName(across).where("b is not null").select("a", "b").distinct(), f"links-{turn}")
    scratch.drop(f"own-{turn}")
    return links


def count_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(cls, linked): for each class, the rows of other classes of its component that link with it.

    members: cls, component, embedding, n (rows of the class). Components larger than a block are
    dealt out as pairs of blocks.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    rows = members.join(sizes.where("m > 1"), "component")
    rows = rows.withColumn("g", F.ceil(F.col("m") / block).cast("int")).withColumn("k", F.pmod(F.xxhash64("cls"), F.col("g")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("component", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi"), "k", "cls", "n", "embedding")
    rows = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "k")

    def pairs(own: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(own).combine_chunks()
        lo, hi, k = (t.column(c)[0].as_py() if c != "k" else t.column(c).to_numpy() for c in ("lo", "hi", "k"))
        u, n, cls = unit_rows(t.column("embedding").combine_chunks()), t.column("n").to_numpy(), t.column("cls").to_numpy()
        a, b = (k == lo, k == hi)
        near = u[a] @ u[b].T >= threshold
        if lo == hi:
            np.fill_diagonal(near, False)
            return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(near @ n)], ["cls", "linked"])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([cls[a], cls[b]])), pa.array(np.concatenate([near @ n[b], n[a] @ near]))], ["cls", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            key = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("component", "lo", "hi")])
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and now != tuple(key[a]):
                    yield pairs(held)
                    held = []
                now = tuple(key[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield pairs(held)

    return rows.mapInArrow(run, "cls long, linked long").groupBy("cls").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed")
    rows = vectors.select("vec_id", "embedding")
    fine = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('infinity' as double)) and exists(embedding, x -> x <> 0)"
    rows = rows.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)))
    good = rows.where("fine")
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = scratch.put(classes.select(F.monotonically_increasing_id().alias("cls"), "embedding", F.size("embedding").alias("length"), "low", "n"), "classes")
    links = round_links(classes, scratch, 0, threshold, passes, window, bits)
    found = scratch.put(connected_components(links, scratch, "part-0"), "found-0")
    turn, rows_of = 0, classes.count()
    while window << turn < rows_of:  # a window of all rows has compared all
        turn += 1
        links = round_links(classes, scratch, turn, threshold, passes, window << turn, bits)
        for x in ("a", "b"):
            names = found.select(F.col("id").alias(x), F.col("component_id").alias(f"c{x}"))
            links = links.join(names, x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
        new = scratch.put(links.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), f"new-{turn}")
        if new.isEmpty():
            break
        links = new.unionByName(found.select(F.col("id").alias("a"), F.col("component_id").alias("b")))
        found = scratch.put(connected_components(links, scratch, f"part-{turn}"), f"found-{turn}")
        scratch.drop(f"links-{turn}", f"new-{turn}", f"found-{turn - 1}")
    scratch.drop("links-0")
    joined = classes.join(found.withColumnRenamed("id", "cls"), "cls")
    counts = count_links(joined.select("cls", F.col("component_id").alias("component"), "embedding", "n"), threshold)
    lowest = joined.groupBy("component_id").agg(F.min("low").alias("lowest"))
    per_class = found.join(lowest, "component_id").select(F.col("id").alias("cls"), "lowest").join(counts, "cls", "left")
    per_class = classes.join(per_class, "cls", "left").select("embedding", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("component_id"))
    per_class = scratch.put(per_class, "result")
    scratch.drop("classes", f"found-{turn}", f"found-{turn - 1}")
    out = good.select("vec_id", "embedding").join(per_class, "embedding").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
