"""Groups that are alike by shared tokens, and their components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Lists longer than this are dealt out in parts for a join.
PART = 1000
#: About so many members of a class are one row until the pairs are written out, which a task does for one row after the other.
FOLDED = 128


def similar_pairs(items: DataFrame, key: str, tokens: Column, least: int = 2) -> DataFrame:
    """(a, b, shared): pairs a < b that share at least `least` tokens, however common these are.

    Items with equal token sets are one class, named by its smallest key. Two sets that share
    `least` tokens share one of all but the last `least` - 1 of each, the most common tokens being last.
    """
    rows = items.select(F.col(key).alias("k"), F.explode(tokens).alias("t")).where("k is not null and t is not null")
    sets = rows.groupBy("k").agg(F.array_sort(F.collect_set("t")).alias("ts")).where(F.size("ts") >= least)
    classes = sets.groupBy("ts").agg(F.min("k").alias("c"), F.count("*").alias("m"))
    members = sets.join(classes, "ts").select("c", "k", F.pmod(F.xxhash64("k"), F.ceil(F.col("m") / FOLDED)).alias("part"))
    members = members.groupBy("c", "part").agg(F.collect_list("k").alias("ks"))

    lists = classes.select("c", F.size("ts").alias("size"), F.explode("ts").alias("t"))
    lists = lists.join(lists.groupBy("t").agg(F.count("*").alias("n")).where("n > 1"), "t")
    # Tokens of one class only can't be shared with another. They come first in the order, so the prefix is what remains of it.
    lists = lists.withColumn("left", F.count("*").over(Window.partitionBy("c")))
    lists = lists.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy("n", "t"))).where(F.col("place") <= F.col("left") - (least - 1))
    lists = lists.withColumn("parts", F.ceil(F.col("n") / PART))
    l = lists.select(F.col("c").alias("a"), "t", F.pmod(F.xxhash64("c"), "parts").alias("part"))
    r = lists.select(F.col("c").alias("b"), "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    pairs = l.join(r, ["t", "part"]).where("a < b").select("a", "b").distinct()
    both = pairs.join(classes.select(F.col("c").alias("a"), F.col("ts").alias("ta"), F.col("m").alias("ma")), "a")
    both = both.join(classes.select(F.col("c").alias("b"), F.col("ts").alias("tb"), F.col("m").alias("mb")), "b")
    both = both.select("a", "b", "ma", "mb", F.size(F.array_intersect("ta", "tb")).alias("shared")).where(F.col("shared") >= least)
    alike = classes.where("m > 1").select(F.col("c").alias("a"), F.col("c").alias("b"), F.col("m").alias("ma"), F.col("m").alias("mb"), F.size("ts").alias("shared"))
    for x in ("a", "b"):
        parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"m{x}") / FOLDED) - 1)
        alike, both = (d.withColumn(f"p{x}", F.explode(parts)) for d in (alike, both))
    out = both.unionByName(alike.where("pa <= pb"))
    for x in ("a", "b"):
        out = out.join(members.select(F.col("c").alias(x), F.col("part").alias(f"p{x}"), F.col("ks").alias(f"k{x}")), [x, f"p{x}"])
    # Folded, the pairs are short rows of much work, which sizes in bytes don't tell.
    out = out.select((F.struct("a", "pa") == F.struct("b", "pb")).alias("same"), "shared", "ka", "kb").repartition(4 * items.sparkSession.sparkContext.defaultParallelism)
    out = out.select("same", "shared", "kb", F.explode("ka").alias("ka")).select("same", "shared", "ka", F.explode("kb").alias("kb"))
    return out.where("not same or ka < kb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "shared")


def components(links: DataFrame, root: str | None = None, most: int = 40) -> DataFrame:
    """(id, component) by repeated smallest labels; each round is checkpointed in the shared folder."""
    spark = links.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch")  # which is shared, too
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")).checkpoint()
    for _ in range(most):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("component", "m").alias("component"))
        # Pointer jumping: take the label of the label.
        jump = step.join(step.select(F.col("id").alias("c2"), F.col("component").alias("m2")), F.col("component") == F.col("c2"), "left")
        new = jump.select("id", F.least("component", F.coalesce("m2", "component")).alias("component")).checkpoint()
        if new.join(labels, ["id", "component"], "left_anti").isEmpty():
            return new
        labels = new
    raise RuntimeError("components did not converge")
