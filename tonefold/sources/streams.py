"""Message streams from tables.

A message has take (the stream), seq (its order), ns (time), kind (note_on, note_off, control, other, undecodable), note, velocity. Of a control message
note is the controller's number and velocity its value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


#: controllers' numbers.
PEDAL, VOLUME = 64, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(events: DataFrame) -> DataFrame:
    """Events as messages: click is an on, view an off, purchase a control (the pedal, or for every fourth event another), error a message that can't be read; each user is a take; twelve keys from 60 on."""
    kind = F.when(F.col("event_type") == "click", "note_on").when(F.col("event_type") == "view", "note_off").when(F.col("event_type") == "purchase", "control").when(F.col("event_type") == "error", "undecodable").otherwise("other")
    key = (60 + F.pmod(F.floor("value"), F.lit(12))).cast("int")
    controller = F.when(F.pmod("event_id", F.lit(4)) == 0, VOLUME).otherwise(PEDAL)
    return events.select(
        F.col("user_id").alias("take"),
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"),
        kind.alias("kind"),
        F.when(kind == "control", controller).otherwise(key).alias("note"),
        (1 + F.pmod(F.col("event_id"), F.lit(127))).cast("int").alias("velocity"),
    )


#: The same in DuckDB SQL.
MESSAGES_SQL = """m AS (
  SELECT user_id AS take, event_id AS seq, epoch_us(ts) * 1000 AS ns,
    CASE event_type WHEN 'click' THEN 'note_on' WHEN 'view' THEN 'note_off' WHEN 'purchase' THEN 'control' WHEN 'error' THEN 'undecodable' ELSE 'other' END AS kind,
    CAST(CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 7 ELSE 64 END ELSE 60 + CAST(floor(value) AS BIGINT) % 12 END AS INTEGER) AS note, CAST(1 + event_id % 127 AS INTEGER) AS velocity
  FROM events)"""
