import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import families, neardup, overlap
from tallyforge.operators import setsim

COLS = "task_id string, line string, split_name string, source string, id string, n int"


def words(s):
    import regex

    s = regex.sub(r"(?<![\p{L}\p{Nd}])ref[^\p{L}\p{Nd}]*tbv\d+[^\p{L}\p{Nd}]*h?\d+", " ", (s or "").lower())
    return frozenset(regex.findall(r"[\p{L}\p{Nd}]+", s))


def near(a, b):
    return len(a) >= 8 and len(b) >= 8 and 10 * len(a & b) >= 7 * len(a | b)


def sample(n=260, seed=4):
    rng = random.Random(seed)
    common, rows = [f"w{i}" for i in range(12)], []
    for i in range(n):
        if rows and rng.random() < 0.55:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                k = rng.random()
                if k < 0.4 and len(base) > 3:
                    base.pop(rng.randrange(len(base)))
                elif k < 0.8:
                    base.insert(rng.randrange(len(base) + 1), f"n{rng.randrange(900)}")
                else:
                    rng.shuffle(base)
        else:
            base = rng.sample(common, 6) + [f"n{rng.randrange(900)}" for _ in range(rng.randrange(1, 14))]
        line = " ".join(base)
        if rng.random() < 0.2:
            line = f"Ref=tbv02-{i:08d} " + line.upper() + "."
        rows.append((f"t{i:04d}", line, rng.choice(["train", "dev", "held_out", None, "Train "]), rng.choice(["a", None]), "clash", 1))
    edge = [("e1", None, "dev", "a", "", 1), ("e2", "", "train", "a", "", 1), ("e3", "one two three", "train", None, "", 1), (None, rows[0][1], "train", "a", "", 1), ("e4", "Ref=tbv02-00000001 tbd", "dev", "a", "", 1)]
    return rows + edge + rows[:9]


def expected(rows):
    seen = {(r[0], r[1]) for r in rows if r[0]}
    return {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(sorted(seen), 2) if a != b and near(words(x), words(y))}


@pytest.mark.parametrize("limit", [30_000, -1])
def test_neardup_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "BROADCAST_LINES", limit)
    monkeypatch.setattr(setsim, "BROADCAST_LINES", limit)
    monkeypatch.setattr(families, "BROADCAST_LINES", limit)
    monkeypatch.setattr(setsim, "BROADCAST_PAIRS", limit)
    rows = sample()
    found = neardup.NearDuplicates(spark.createDataFrame(rows, COLS), "task_id", F.col("line"))
    got = [tuple(r) for r in found.pairs().collect()]
    assert set(got) == expected(rows) and len(got) == len(set(got)) and len(got) > 50
    groups = {r.id: r for r in found.groups().collect()}
    assert groups and all(g.class_id <= k and g.class_size >= 1 for k, g in groups.items())
    plain = setsim.near_classes(found.kept, found.scratch, 7, 10)
    sort = lambda df: {tuple(sorted((r.line_a, r.line_b))) for r in df.collect()}
    assert sort(plain) == sort(found.links)


def test_families_hold_subsets_only(spark):
    base = [f"b{i}" for i in range(12)]
    lines = [" ".join(base), " ".join(base[:11]), " ".join(base[1:]), " ".join([*base, "extra"]), " ".join([f"z{i}" for i in range(9)])]
    kept = setsim.classes(setsim.lines(spark.createDataFrame([(str(i), s) for i, s in enumerate(lines)], "id string, s string"), "id", F.col("s")), 8, [])
    scratch = setsim.Scratch(spark, "t")
    rows = families.families(kept, spark.sparkContext.broadcast(setsim._sketch(kept)), scratch).collect()
    by = {r.cid: r for r in rows}
    for r in rows:
        top = set(by[r.leader].line.split())
        assert set(r.line.split()) | set(r.removed) == top and len(r.removed) <= families.MISSING
    assert any(r.cid != r.leader for r in rows)  # which subsets meet their leader depends on the rarest words


def test_one_hot_line_stays_one_class(spark):
    line = " ".join(f"h{i}" for i in range(10))
    rows = [(f"t{i:03d}", line, "train", "a", "", 1) for i in range(60)] + [("x", line + " more", "dev", None, "", 1)]
    found = neardup.NearDuplicates(spark.createDataFrame(rows, COLS), "task_id", F.col("line"))
    assert found.kept.count() == 2 and found.links.count() == 1 and found.pairs().count() == 61 * 60 // 2


def test_all_groups_have_a_row_for_every_record(spark):
    line = " ".join(f"h{i}" for i in range(10))
    rows = [("a", line), ("b", line), ("c", None), ("d", " "), ("e", "too short"), ("f", "too short"), ("f", "too short"), (None, line), ("g", line + " more")]
    found = neardup.NearDuplicates(spark.createDataFrame(rows, "task_id string, line string"), "task_id", F.col("line"))
    got = sorted(tuple(r) for r in found.all_groups().collect())
    assert got == [("a", "a", 2, 1), ("b", "a", 2, 1), *[(k, k, 1, 0) for k in "cdef"], ("g", "g", 1, 1)]


@pytest.mark.parametrize("limit", [30_000, -1])
def test_cross_split_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(overlap, "BROADCAST_LINES", limit)
    monkeypatch.setattr(setsim, "BROADCAST_PAIRS", limit)
    rows = sample(seed=9)
    got = overlap.cross_split_pairs(spark.createDataFrame(rows, COLS), "task_id", F.col("line"), F.col("split_name"), F.col("source"))
    kind = lambda s: {"train": "t", "dev": "h", "held_out": "h"}.get((s or "").strip().lower())
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] and b[0] and a[0] != b[0] and kind(a[2]) == "h" and kind(b[2]) == "t" and near(words(a[1]), words(b[1]))}
    pairs = got.collect()
    assert {(r.held_id, r.train_id) for r in pairs} == want and len(pairs) == len(want) > 20
    report = overlap.overlap_report(got).collect()
    assert sum(r.pairs for r in report) == len(want) and {r.source for r in report} <= {"a", "unknown"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], COLS)
    assert neardup.NearDuplicates(empty, "task_id", F.col("line")).pairs().count() == 0
    assert overlap.cross_split_pairs(empty, "task_id", F.col("line"), F.col("split_name"), F.col("source")).count() == 0


def test_threshold_itself_is_near(spark):
    # 14 of 20 words are shared: exactly 0.7; one less isn't near
    shared = [f"s{i}" for i in range(14)]
    rows = [("a", " ".join([*shared, "p1", "p2", "p3"])), ("b", " ".join([*shared, "q1", "q2", "q3"])), ("c", " ".join([*shared[1:], "q1", "q2", "q4", "q5"]))]
    df = spark.createDataFrame(rows, "task_id string, line string")
    got = {tuple(r) for r in neardup.NearDuplicates(df, "task_id", F.col("line")).pairs().collect()}
    assert ("a", "b") in got and ("a", "c") not in got
