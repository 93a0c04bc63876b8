"""SQL over registered views, queries only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class NotAQuery(ValueError):
    pass


def register(spark: SparkSession, sf_dir: str, tables=TABLES) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def query(spark: SparkSession, sql: str, args=None) -> DataFrame:
    """One statement that returns rows and changes nothing: commands are refused by the parsed plan, before any runs."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    names = {plan.nodeName()} | set(plan.toString().split("\n")[0].split(" ")[:1])
    command = spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    statement = spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    if command.isInstance(plan) or (statement.isInstance(plan) and "Select" not in "".join(names)):
        raise NotAQuery(sql)
    return spark.sql(sql, args=args)
