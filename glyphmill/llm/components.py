"""Connected components over links of any number, as alternating large-star and small-star passes."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component_id) for every id in links (a, b): the smallest id that links reach.

    Links may repeat, run either way or join an id to itself; null ends count as no link. Each
    pass makes one aggregate with map-side combining and one join that Spark may split when a
    hub is hot, and writes its result, so a lost executor costs one pass at most.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = scratch.put(edges, f"{name}-0")
    before = None
    for k in count(1):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").unionByName(low.select("v", F.col("m").alias("u")))
        new = scratch.put(small.distinct(), f"{name}-{k}")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        edges = new
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component_id")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("component_id")).distinct())
