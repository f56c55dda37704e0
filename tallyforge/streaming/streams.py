"""Structured Streaming forms of the event operators; batch and stream share the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import Scratch


def deduplicated(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Events without later copies of a key that arrive within the delay; bounded in time, not in count. A null or empty key is never
    a copy, so those rows bypass the state."""
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    once = events.where(keyed).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return once.unionByName(events.where(~keyed).withWatermark(time, delay))


def routed(events: DataFrame, text: str, suppressed: DataFrame | None = None, address: str = "address") -> DataFrame:
    """A route for each event; whole trimmed words STOP, START and HELP come first. Suppressed addresses leave before anything else."""
    if suppressed is not None:
        events = events.join(suppressed, address, "left_anti")
    word = F.upper(F.trim(F.coalesce(F.col(text), F.lit(""))))
    return events.withColumn("route", F.when(word == "STOP", "opt_out").when(word == "START", "opt_in").when(word == "HELP", "help").when(word == "", "ignored").otherwise("reply"))


def thread_states(events: DataFrame, thread: str, time: str, kind: str) -> DataFrame:
    """The running state of each thread (update mode): the latest switch wins, whatever the order of arrival."""
    switch = F.max_by(F.col(kind) == "opt_out", F.when(F.col(kind).isin("opt_out", "opt_in"), F.col(time)))
    return events.groupBy(thread).agg(F.max(time).alias("last_at"), F.count("*").alias("events"), F.coalesce(switch, F.lit(False)).alias("opted_out"))


def windowed_costs(events: DataFrame, time: str, amount: str, width: str, delay: str) -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.sum(amount).alias("cost"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "cost", "n")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns the written result. In update mode the latest row of a key is the last one."""
    scratch = Scratch(stream.sparkSession, f"stream-{name}")
    sink = f"{scratch.at}/out"

    def write(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(sink)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.at}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    schema = stream.schema.add("epoch", "integer")
    return stream.sparkSession.read.schema(schema).parquet(sink)


def keep_latest(batch: DataFrame, epoch: int, path: str, key: str, order: str) -> None:
    """foreachBatch upsert: the newest row of each key of the table and the batch, written as the next version."""
    spark = batch.sparkSession
    jvm, base = spark._jvm, path.rstrip("/")
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    last = max((v for v in range(epoch) if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/v{v}/_SUCCESS"))), default=None)
    both = batch if last is None else spark.read.schema(batch.schema).parquet(f"{base}/v{last}").unionByName(batch)
    cols = batch.columns
    both.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*cols), order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{base}/v{epoch}")
