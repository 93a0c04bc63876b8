"""Which built-in control codes a text's reader knows, by engine and by where the text stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Readers by document and field. message reads all codes, extended those that need no message window, others none.
MESSAGE = {
    "Actors": ["name"], "Enemies": ["name"], "Skills": ["name"], "Items": ["name"], "Weapons": ["name"], "Armors": ["name"],
    "States": ["message1", "message4"],
    "System": ["terms.basic[0]", "terms.basic[8]"],
    "event_dialogue": ["body"], "event_command": ["name"],
}
EXTENDED = {
    "Actors": ["profile"], "Skills": ["description", "message1", "message2"], "Items": ["description"], "Weapons": ["description"], "Armors": ["description"],
    "States": ["message2", "message3"],
    "System": ["terms.basic[2]", "terms.basic[4]", "terms.basic[6]", "terms.params[]"],
    "event_choices": ["choices"], "event_scrolling": ["text"], "event_command": ["profile"],
}
#: Keys of System's terms.messages by reader, and those with numbered arguments.
MESSAGE_TERMS = ["emerge", "partyName", "preemptive", "surprise", "victory", "defeat", "escapeStart", "escapeFailure", "obtainExp", "obtainGold", "obtainItem", "levelUp", "obtainSkill"]
EXTENDED_TERMS = [
    "saveMessage", "loadMessage", "criticalToEnemy", "criticalToActor", "actorNoDamage", "actorNoHit", "enemyNoDamage", "enemyNoHit", "evasion", "magicEvasion", "magicReflection",
    "counterAttack", "actionFailure", "useItem", "actorDamage", "enemyDamage", "substitute", "buffAdd", "debuffAdd", "buffRemove", "actorRecovery", "actorGain", "actorLoss", "actorDrain",
    "enemyRecovery", "enemyGain", "enemyLoss", "enemyDrain",
]
#: Of the terms above, these take no argument; of the plain ones, expTotal and expNext do.
WITHOUT_ARGUMENTS = ["escapeFailure", "saveMessage", "loadMessage", "criticalToEnemy", "criticalToActor"]
PLAIN_WITH_ARGUMENTS = ["expTotal", "expNext"]


def profiles(spark: SparkSession, engine: str) -> DataFrame:
    """(file, field, reader, arguments) of an engine, mv or mz; what isn't listed is plain text. A place within a list is written as []."""
    if engine not in ("mv", "mz"):
        raise ValueError(f"no engine {engine}")
    rows = [(file, field, "message") for file, fields in MESSAGE.items() for field in fields] + [(file, field, "extended") for file, fields in EXTENDED.items() for field in fields]
    rows = [(*r, (r[0] == "Skills" and r[1].startswith("message")) or (r[0] == "States" and engine == "mz")) for r in rows]
    if engine == "mz":
        rows.append(("event_dialogue", "speaker", "extended", False))
    terms = [(t, "message") for t in MESSAGE_TERMS] + [(t, "extended") for t in EXTENDED_TERMS] + [(t, "plain") for t in PLAIN_WITH_ARGUMENTS]
    rows += [("System", f"terms.messages.{t}", reader, t not in WITHOUT_ARGUMENTS) for t, reader in terms]
    return spark.createDataFrame(rows, "file string, field string, reader string, arguments boolean")


def with_profile(units: DataFrame, engine: str, file: str, field: str) -> DataFrame:
    """units with reader and arguments; the table of profiles is a few dozen rows."""
    known = profiles(units.sparkSession, engine).withColumnsRenamed({"file": "_file", "field": "_field"})
    name = F.when(F.col(field).startswith("terms.params["), "terms.params[]").otherwise(F.col(field))
    out = units.join(F.broadcast(known), (F.col(file) == F.col("_file")) & (name == F.col("_field")), "left").drop("_file", "_field")
    return out.withColumn("reader", F.coalesce("reader", F.lit("plain"))).withColumn("arguments", F.coalesce("arguments", F.lit(False)))
