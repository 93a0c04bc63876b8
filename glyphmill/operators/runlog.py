"""Run logs: summaries, phase times and lifecycle checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp string, sequence long, run_id string, level string, event string, context struct<locale:string,engine:string,project:string,command:string>, payload string, message string"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path).withColumn("at", F.to_timestamp("timestamp"))


def micros(at: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone; one with zone is taken as the session shows it."""
    since = F.col(at).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(24,6)") * 1000000).cast("long")


def summary(log: DataFrame, run: str, event: str) -> DataFrame:
    return log.groupBy(run, event).agg(F.count("*").alias("n"))


def phases(log: DataFrame, run: str, event: str, at: str, start: str, stop: str) -> DataFrame:
    """(run, micros): from the first start to the last stop of each run; null where either is absent."""
    only = lambda e, f: f(F.when(F.col(event) == e, micros(at)))
    return log.groupBy(run).agg((only(stop, F.max) - only(start, F.min)).alias("micros"))


def broken(log: DataFrame, run: str, event: str, order: str, terminal: list[str]) -> DataFrame:
    """(run, problem): runs without just one terminal event, or with events after it."""
    end = F.col(event).isin(terminal)
    g = log.groupBy(run).agg(F.count_if(end).alias("ends"), F.max(order).alias("last"), F.max(F.when(end, F.col(order))).alias("end"))
    kind = F.when(F.col("ends") == 0, "no_terminal_event").when(F.col("ends") > 1, "several_terminal_events").when(F.col("end") < F.col("last"), "event_after_end")
    return g.select(run, kind.alias("problem")).where("problem is not null")


def counters_agree(totals: DataFrame) -> DataFrame:
    """Rows whose counters break planned = started + not_started, or started = the sum of its outcomes."""
    return totals.where("planned <> started + not_started or started <> complete + partial + unavailable + failed + cancelled")
