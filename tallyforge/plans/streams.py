"""Streams run over the event table as far as it is there."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.registry import query
from tallyforge.session import read
from tallyforge.streaming import streams


def _events(spark: SparkSession, d: str) -> DataFrame:
    path = os.path.join(d, "events.parquet")
    raw = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "*.parquet")
    return (raw.parquet(path) if os.path.isdir(path) else raw.option("pathGlobFilter", "events.parquet").parquet(d)).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, count(*) AS events, max(CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END) = 1 AND arg_max(event_type, {'t': ts}) FILTER (WHERE event_type IN ('error', 'signup')) = 'error' AS opted_out FROM events GROUP BY user_id")
def stream_states(spark: SparkSession, d: str) -> DataFrame:
    """Running thread states in update mode; the last epoch of a key is its state."""
    kind = F.when(F.col("event_type") == "error", "opt_out").when(F.col("event_type") == "signup", "opt_in").otherwise("other")
    out = streams.run_available(streams.thread_states(_events(spark, d).withColumn("kind", kind), "user_id", "ts", "kind"), "states", "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("events", "opted_out"), "epoch").alias("r")).select("user_id", "r.events", "r.opted_out")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS cost FROM events GROUP BY event_type")
def stream_costs(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run_available(_events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("cost")), "costs", "complete")
    last = out.groupBy("event_type").agg(F.max_by(F.struct("n", "cost"), "epoch").alias("r"))
    return last.select("event_type", "r.n", F.round("r.cost", 4).alias("cost"))


@query("SELECT CAST(user_id % 500 AS VARCHAR) AS key, CAST(1 AS BIGINT) AS kept FROM events WHERE user_id % 500 != 0 GROUP BY 1 UNION ALL SELECT '' AS key, count(*) FROM events WHERE user_id % 500 = 0 HAVING count(*) > 0")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each key that the watermark deduplication lets through: one, as all repeats fall within the delay; rows with an empty
    key bypass it and all stay."""
    key = F.when(F.col("user_id") % 500 == 0, "").otherwise((F.col("user_id") % 500).cast("string"))
    out = streams.run_available(streams.deduplicated(_events(spark, d).withColumn("key", key), "key", "ts", "1000 days"), "dedup")
    return out.groupBy("key").agg(F.count("*").alias("kept"))
