"""Queries of the training-data problems over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import calibrate, defects, encode, groupsplit, leakage, mixture, neardup, overlap, pii
from tallyforge.session import Scratch, read

LINE = "input.signal_brief.signal_line"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the calibrated plan misses because too few distinct tasks exist."""
    _, _, report = calibrate.calibrate(read(spark, d, "judge_filter_accepted"), read(spark, d, "sampling_targets"), "task_id")
    return report.where("short > 0 AND available < needed").select("plan_id", "category_name")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """What each target needs, what there is and what the drawn sample holds of it."""
    tagged, cells, report = calibrate.calibrate(read(spark, d, "judge_filter_accepted"), read(spark, d, "sampling_targets"), "task_id")
    drawn = Scratch(spark, "sample").keep(calibrate.pivotal_sample(tagged, cells))
    return calibrate.sample_report(report, drawn).select("plan_id", "field_path", "category_name", "needed", "available", "gap", "drawn", "actual_pct")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn tasks of every plan."""
    tagged, cells, _ = calibrate.calibrate(read(spark, d, "judge_filter_accepted"), read(spark, d, "sampling_targets"), "task_id")
    return calibrate.pivotal_sample(tagged, cells).select("plan_id", F.array_join("cell", "|").alias("category"), F.col("id").alias("task_id"), "pi")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Traces, and accepted pairs, whose answer is defective."""
    traces = read(spark, d, "held_out_traces_raw").select(F.lit("trace").alias("record_kind"), F.col("trace_id").alias("record_id"), "prompt", F.col("model_output").alias("response"))
    pairs = read(spark, d, "preference_pairs_audit").where(F.regexp_replace(F.lower("status"), r"^\s+|\s+$", "") == "accepted")
    pairs = pairs.select(F.lit("pair").alias("record_kind"), F.col("pair_id").alias("record_id"), "prompt", F.col("chosen").alias("response"))
    return defects.defects(traces.unionByName(pairs))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return defects.defect_report(p2_found(spark, d))


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(read(spark, d, "tasks"), "task_id", F.col(LINE), F.col("split_name"), F.col("metadata.signal_source"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation and training tasks with near signal lines."""
    return _overlap(spark, d).select(F.least("held_id", "train_id").alias("task_id_a"), F.greatest("held_id", "train_id").alias("task_id_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_overlap(spark, d))


def _keyed(tasks: DataFrame) -> DataFrame:
    return groupsplit.record_keys(tasks, "task_id", {"seed": F.col("metadata.seed_origin")}, {"probe": F.col("metadata.week10_probe_ids")}, ("shared_probe_library",))


def _components(spark: SparkSession, d: str, split: bool = True) -> DataFrame:
    table = groupsplit.ComponentTable(spark, Scratch(spark, "component-table").at)
    return table.update(_keyed(read(spark, d, "judge_filter_accepted")), read(spark, d, "split_targets") if split else None)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The smallest task of each tied group with each other one."""
    return groupsplit.tied_pairs(_components(spark, d, False)).select(F.col("first").alias("task_id_a"), F.col("other").alias("task_id_b"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d).select(F.col("id").alias("task_id"), "component", "split", "quarantined")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.split_report(_components(spark, d), read(spark, d, "split_targets"))


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """All tasks in two deliveries, the early and the late half by time, to one kept table: what the second leaves and adds."""
    tasks, targets = read(spark, d, "judge_filter_accepted"), read(spark, d, "split_targets")
    half = tasks.agg(F.expr("percentile_approx(loaded_at, 0.5)")).first()[0]
    late = F.coalesce(F.col("loaded_at") > F.lit(half), F.lit(True))
    table = groupsplit.ComponentTable(spark, Scratch(spark, "component-table").at)
    before = table.update(_keyed(tasks.where(~late)), targets)
    after = table.update(_keyed(tasks.where(late)), targets)
    both = after.join(before.select("id", F.col("split").alias("was"), F.lit(True).alias("early")), "id", "left")
    both = both.withColumn("early", F.coalesce("early", F.lit(False)))
    quiet = after.where("NOT quarantined").groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1")
    counts = both.agg(
        F.count("*").alias("tasks"),
        F.count_if(F.expr("early AND split IS DISTINCT FROM was")).alias("moved"),
        F.count_if(F.expr("split IS NULL AND NOT quarantined")).alias("unassigned"),
        F.count_if(F.expr("NOT early AND quarantined AND split IS NOT NULL")).alias("late_quarantined_with_split"),
        F.count_distinct("component").alias("groups"),
    )
    return counts.crossJoin(quiet.agg(F.count("*").alias("groups_in_two_splits")))  # one row each


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.lit("document").alias("record_kind"), F.col("doc_id").alias("record_id"), F.lit("text").alias("field"), "text")
    pairs = read(spark, d, "preference_pairs_audit").select(F.lit("pair").alias("record_kind"), F.col("pair_id").alias("record_id"), F.explode(F.array(F.struct(F.lit("prompt").alias("field"), F.col("prompt").alias("text")), F.struct(F.lit("chosen").alias("field"), F.col("chosen").alias("text")))).alias("f"))
    texts = docs.unionByName(pairs.select("record_kind", "record_id", "f.field", "f.text"))
    return leakage.leaks(texts, read(spark, d, "held_out_items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and pairs that hold eight consecutive words of a test passage."""
    return _leaks(spark, d).select("record_kind", "record_id", "item_id").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, d))


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(read(spark, d, "judge_filter_accepted"), "task_id", F.col(LINE))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tasks with near signal lines."""
    return _near(spark, d).pairs().select(F.col("id_a").alias("task_id_a"), F.col("id_b").alias("task_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups().withColumnRenamed("id", "task_id")


def p6_all_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups with a row for every task."""
    return _near(spark, d).all_groups().withColumnRenamed("id", "task_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of each document."""
    return encode.encode(read(spark, d, "documents"), "text", ["doc_id"])


def _mixture(spark: SparkSession, d: str) -> mixture.Mixture:
    docs = encode.token_counts(read(spark, d, "documents"), "text", ["doc_id", "source"])
    return mixture.Mixture(Scratch(spark, "mixture").keep(docs), read(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    return _mixture(spark, d).chosen()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    mix = _mixture(spark, d)
    return mix.shares(mix.chosen())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct personal item of a document."""
    return pii.find(read(spark, d, "documents"), "text", "doc_id", read(spark, d, "known_names")).withColumnRenamed("id", "doc_id")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Documents with placeholders for personal items."""
    return pii.redact(read(spark, d, "documents"), "text", "doc_id", read(spark, d, "known_names")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p1_sample, p2_found, p2_report, p3_found, p3_report, p4_found, p4_splits, p4_report, p4_batches, p5_found, p5_report, p6_found, p6_groups, p6_all_groups, p7_ids, p8_mix, p8_shares, p9_found, p9_redacted)
}
