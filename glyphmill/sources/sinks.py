"""Sinks: snapshots that appear whole, JSON lines and logs."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, root: str, format: str = "parquet") -> str:
    """Write a new version beside the old ones, then point to it by one rename. A failed job leaves the old version in place."""
    spark = df.sparkSession
    version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    df.write.format(format).save(f"{root}/{version}")
    fs, pointer = _fs(spark, f"{root}/CURRENT")
    fresh = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/.CURRENT-{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, pointer, over)
    return version


def current(spark: SparkSession, root: str) -> str:
    """The published version; a pointer caught between delete and rename is found by its staged name."""
    fs, pointer = _fs(spark, f"{root}/CURRENT")
    if fs.exists(pointer):
        return spark.read.text(f"{root}/CURRENT").first().value
    staged = sorted(s.getPath().getName() for s in fs.listStatus(_fs(spark, root)[1]) if s.getPath().getName().startswith(".CURRENT-"))
    if not staged:
        raise FileNotFoundError(root)
    return staged[-1].removeprefix(".CURRENT-")


def read_published(spark: SparkSession, root: str, format: str = "parquet") -> DataFrame:
    """The version current at the time of the call; later publications don't change what this DataFrame reads."""
    return spark.read.format(format).load(f"{root}/{current(spark, root)}")


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Compact JSON lines in a total order by `order`, across files."""
    df.sort(*order).select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


class RunLog:
    """A driver-side log of a job: records in order, the terminal one last."""

    def __init__(self, path: str, run_id: str):
        self.path, self.run_id, self.sequence, self.closed = path, run_id, 0, False

    def write(self, event: str, payload: dict | None = None, level: str = "info", terminal: bool = False) -> None:
        if self.closed:
            raise ValueError("the log has its terminal event")
        record = {"timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "sequence": self.sequence, "run_id": self.run_id, "level": level, "event": event, "payload": json.dumps(payload or {})}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(record, ensure_ascii=False) + "\n")
        self.sequence += 1
        self.closed = terminal


OWNED = ("groups", "units", "rejected", "claims")


def publish_owned(tables: dict[str, DataFrame], root: str) -> None:
    """The tables of a snapshot, each in folders by owner."""
    for name in OWNED:
        tables[name].write.mode("overwrite").partitionBy("owner").parquet(f"{root}/{name}")


def owned(spark: SparkSession, root: str, owner: str) -> dict[str, DataFrame]:
    """The tables of one owner; only that owner's folders are read."""
    return {name: spark.read.parquet(f"{root}/{name}").where(F.col("owner") == owner) for name in OWNED}


def append(df: DataFrame, path: str) -> None:
    """Rows added in bulk; a failed job adds none."""
    df.write.mode("append").parquet(path)
