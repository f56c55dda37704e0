import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import calibrate as c

TARGET = "plan_id int, field_path string, category_name string, target_pct int, min_rows int, draw_rows long"
POP = "task_id string, difficulty string, seg int, plan_id string, cell string"


def population(spark, n=400):
    rows = [(f"t{i:04d}", ["easy", "Easy ", "HARD", None, " "][i % 5], i % 4, "x", "y") for i in range(n)]
    return spark.createDataFrame(rows + rows[:7], POP)  # repeats, and columns whose names clash with the operator's own


def test_report_counts_distinct_and_spellings(spark):
    t = spark.createDataFrame([(1, "difficulty", "easy", 50, 2, 100), (1, "difficulty", "hard", 50, 90, 100), (1, "difficulty", "unknown", 0, 2, 100), (2, "seg", "3", 100, 2, 500), (2, "seg", "9", 0, 1, 500)], TARGET)
    _, _, report = c.calibrate(population(spark), t, "task_id")
    got = {(r.plan_id, r.category_name): (r.needed, r.available, r.gap) for r in report.collect()}
    assert got == {(1, "easy"): (50, 160, 0), (1, "hard"): (90, 80, 10), (1, "unknown"): (2, 160, 0), (2, "3"): (500, 100, 400), (2, "9"): (1, 0, 1)}


def test_sample_hits_counts_exactly_and_is_seeded(spark):
    t = spark.createDataFrame([(1, "difficulty", "easy", 50, 2, 60), (1, "difficulty", "hard", 30, 2, 60), (1, "difficulty", "unknown", 20, 2, 60)], TARGET)
    tagged, cells, _ = c.calibrate(population(spark), t, "task_id")
    draw = lambda seed: sorted((r.cell[0], r.id) for r in c.pivotal_sample(tagged, cells, seed, buckets=5).collect())
    one = draw(1)
    assert [sum(k == x for k, _ in one) for x in ("easy", "hard", "unknown")] == [30, 18, 12]
    assert one == draw(1) and one != draw(2) and len(set(one)) == len(one)


def test_inclusion_follows_probability(spark):
    t = spark.createDataFrame([(1, "seg", "0", 25, 0, 100)], TARGET)
    tagged, cells, _ = c.calibrate(population(spark), t, "task_id")
    hits = sum(c.pivotal_sample(tagged, cells, seed, buckets=4).where(F.col("id") < "t0200").count() for seed in range(6))
    assert 45 < hits < 105  # 75 are expected of 150 drawn


def test_several_margins_are_met_together():
    n = np.array([500.0, 100, 300, 400])
    x = np.array([[1, 0, 1, 0], [1, 0, 0, 1], [0, 1, 1, 0], [0, 1, 0, 1]], float)
    goal = np.array([40.0, 60, 70, 30])
    assert np.allclose(x.T @ (n * c.tilt(n, x, goal)), goal, atol=1e-4)


def test_plans_over_two_fields_and_joint_gaps(spark):
    rows = [(f"t{i:04d}", ["easy", "hard"][i % 2], i % 3, "x", "y") for i in range(600)]
    t = [(1, "difficulty", "easy", 60, 0, 60), (1, "difficulty", "hard", 40, 0, 60), (1, "seg", "0", 50, 0, 60), (1, "seg", "1", 30, 0, 60), (1, "seg", "2", 20, 0, 60)]
    tagged, cells, report = c.calibrate(spark.createDataFrame(rows, POP), spark.createDataFrame(t, TARGET), "task_id")
    got = {r.category_name: r for r in c.sample_report(report, c.pivotal_sample(tagged, cells)).collect()}
    assert all(r.short == 0 and abs(r.drawn - r.needed) <= 2 for r in got.values())
    assert abs(sum(got[k].drawn for k in ("easy", "hard")) - 60) <= 1
    # each category has enough records, but all hard ones are of segment 0, so the fields are at odds
    rows = [(f"t{i:04d}", "hard" if i % 4 == 0 else "easy", 0 if i % 4 == 0 else 1, "x", "y") for i in range(400)]
    t = [(1, "difficulty", "easy", 20, 0, 100), (1, "difficulty", "hard", 80, 0, 100), (1, "seg", "0", 10, 0, 100), (1, "seg", "1", 90, 0, 100)]
    _, _, report = c.calibrate(spark.createDataFrame(rows, POP), spark.createDataFrame(t, TARGET), "task_id")
    assert {r.gap for r in report.collect()} == {0} and any(r.short > 0 for r in report.collect())


def test_draw_is_the_same_for_every_size_of_batch(spark):
    t = spark.createDataFrame([(1, "seg", "0", 25, 0, 100), (1, "seg", "1", 25, 0, 100)], TARGET)
    tagged, cells, _ = c.calibrate(population(spark), t, "task_id")
    draw = lambda: sorted(r.id for r in c.pivotal_sample(tagged, cells, 3, buckets=2).collect())
    whole = draw()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert draw() == whole and len(whole) == 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_floors_and_caps():
    n, x = np.array([5.0, 1000]), np.eye(2)
    assert np.allclose(n * c.tilt(n, x, np.array([5.0, 95.0])), [5, 95], atol=1e-5)


def test_empty_tables_null_ids_and_missing_field(spark):
    empty = spark.createDataFrame([], POP)
    t = spark.createDataFrame([(1, "difficulty", "easy", 50, 2, 60), (2, "no.such.field", "unknown", 100, 1, 3), (None, None, None, None, None, None)], TARGET)
    tagged, cells, report = c.calibrate(empty, t, "task_id")
    assert {r.gap for r in report.collect()} == {30, 3} and c.pivotal_sample(tagged, cells).count() == 0
    tagged, cells, report = c.calibrate(spark.createDataFrame([(None, "easy", 1, "", "")], POP), spark.createDataFrame([], TARGET), "task_id")
    assert report.count() == 0 and c.pivotal_sample(tagged, cells).count() == 0
    _, _, report = c.calibrate(population(spark, 10), t, "task_id")
    assert [r.available for r in report.where("plan_id = 2").collect()] == [10]


def test_unbounded_target_table_is_refused(spark):
    t = spark.range(c.MAX_TARGETS + 5).selectExpr("cast(id as int) plan_id", "'a' field_path", "'b' category_name", "1 target_pct", "1 min_rows", "1L draw_rows")
    with pytest.raises(ValueError):
        c.read_plans(t)
