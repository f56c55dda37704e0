"""Problem 1: samples whose category shares match targets.

Calibration by Newton steps on the dual of exponential tilting: a record in cell k (one combination of target categories) gets
the inclusion probability min(1, d * exp(l . x_k)), with l such that the expected category counts hit the targets. The moments of
the dual depend on the records only through the cell counts, so one distributed aggregation feeds all steps; the number of cells
is bounded by the target table, not by the data. The sample itself is drawn by the pivotal method: units of a bucket fight in a
stream, each bucket keeps at most one undecided unit a cell, and those leftovers fight once more.

Defined results: repeats of an id count once (the smallest category in text order if they differ); null ids are ignored; null
and blank categories are `unknown`; a category without a target is never drawn; an empty population leaves every target unmet; a
field that the table lacks counts as null everywhere. Columns other than the id and the named fields are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.text import NOT_WORD

MAX_TARGETS = 10_000
EPS = 1e-9


def category_key(col: Column, kind: T.DataType) -> Column:
    """Numbers as they are; texts without case, outer blanks and whatever joins their words."""
    if isinstance(kind, T.StringType):
        col = F.regexp_replace(F.lower(col), NOT_WORD, "")
    return F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit("unknown"))


def _target_key(name: str | None) -> str:
    s = (name or "").strip().lower()
    return s if re.fullmatch(r"-?\d+", s) else "".join(c for c in s if c.isalpha() or c.isdecimal()) or "unknown"


def _field_type(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


@dataclass
class Plan:
    plan_id: int
    draw_rows: int
    fields: list[str]
    goals: dict[tuple[str, str], tuple[str, float, int, int]]  # (field, key) -> name, pct, min_rows, needed


def read_plans(targets: DataFrame) -> list[Plan]:
    """The target table is small by contract; more than MAX_TARGETS rows are refused."""
    rows = targets.select("plan_id", "field_path", "category_name", "target_pct", "min_rows", "draw_rows").distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    by: dict[int, Plan] = {}
    for r in sorted((r for r in rows if r.plan_id is not None and r.field_path), key=lambda r: (r.plan_id, r.field_path, r.category_name or "")):
        plan = by.setdefault(r.plan_id, Plan(r.plan_id, int(r.draw_rows or 0), [], {}))
        if r.field_path not in plan.fields:
            plan.fields.append(r.field_path)
        need = max(int(r.min_rows or 0), int((r.draw_rows or 0) * (r.target_pct or 0) // 100))
        plan.goals[r.field_path, _target_key(r.category_name)] = (r.category_name, float(r.target_pct or 0), int(r.min_rows or 0), need)
    return list(by.values())


def _cells(population: DataFrame, plans: list[Plan], id_col: str) -> DataFrame:
    """(id, plan_id, cell): each record once in each plan whose categories it has; cell is the list of its category keys."""
    paths = sorted({f for p in plans for f in p.fields})
    kinds = {f: _field_type(population.schema, f) for f in paths}
    keys = {f: category_key(F.col(f), kinds[f]) if kinds[f] is not None else F.lit("unknown") for f in paths}
    one = population.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.min(keys[f]).alias(f"k{i}") for i, f in enumerate(paths)])
    at = {f: f"k{i}" for i, f in enumerate(paths)}
    parts = []
    for p in plans:
        known = [F.col(at[f]).isin([k for g, k in p.goals if g == f]) for f in p.fields]
        ok = known[0]
        for k in known[1:]:
            ok = ok & k
        parts.append(F.when(ok, F.struct(F.lit(p.plan_id).cast("int").alias("plan_id"), F.array(*[F.col(at[f]) for f in p.fields]).alias("cell"))))
    return one.select("id", F.explode(F.array_compact(F.array(*parts))).alias("c")).select("id", "c.plan_id", "c.cell")


def tilt(counts: np.ndarray, moments: np.ndarray, goals: np.ndarray, steps: int = 60) -> np.ndarray:
    """Inclusion probabilities of the cells: counts (K), moments (K x C, 0 or 1), goals (C)."""
    total = counts.sum()
    if not total:
        return np.zeros(len(counts))
    full = np.zeros(len(counts), bool)
    dead = (moments[:, goals <= 0] > 0).any(1)
    base = min(1.0, max(goals.sum() / max(1, moments.sum(1).max()), 1.0) / total)
    while True:
        free = ~full & ~dead & (counts > 0)
        left = goals - moments[full].T @ counts[full]
        use = (left > EPS) & ((moments[free].T @ counts[free]) > 0)
        lam, x, n = np.zeros(int(use.sum())), moments[free][:, use], counts[free]
        dual = lambda v: n @ (base * np.exp(np.clip(x @ v, -60, 60))) - left[use] @ v
        for _ in range(steps):
            w = n * base * np.exp(np.clip(x @ lam, -60, 60))
            gradient = x.T @ w - left[use]
            if not len(lam) or np.abs(gradient).max() < 1e-8 * max(1.0, left[use].max()):
                break
            step, scale, now = np.linalg.lstsq((x * w[:, None]).T @ x, gradient, rcond=None)[0], 1.0, dual(lam)
            while scale > 1e-6 and dual(lam - scale * step) > now - 1e-4 * scale * (gradient @ step):
                scale /= 2
            lam = lam - scale * step
        p = np.where(full, 1.0, 0.0)
        p[free] = np.where((x.sum(1) > 0) if len(lam) else False, base * np.exp(np.clip(x @ lam, -60, 60)), 0.0)
        over = free & (p > 1 + EPS)
        if not over.any():
            return np.minimum(p, 1.0)
        full |= over


REPORT = "plan_id int, field_path string, category_name string, key string, target_pct double, min_rows int, needed long, available long, expected double, short long, gap long"
CELL = "plan_id int, cell array<string>, pi double, n long"
#: Units that one bucket of the draw takes, on average.
BUCKET_UNITS = 20_000


def calibrate(population: DataFrame, targets: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records with plan and cell, cells with their probability, report of each target).

    needed is what the target asks for, available what there is, expected what the calibrated probabilities draw, short how much of
    needed they miss, be it that too few records exist or that other targets of the plan stand in the way, and gap the part of it that
    is for want of records. A shortage isn't made up by other categories: each keeps its own count, so the sample is smaller.
    """
    spark = population.sparkSession
    plans = read_plans(targets)
    report, cells = [], []
    if not plans:
        empty = spark.createDataFrame([], "id string, plan_id int, cell array<string>")
        return empty, spark.createDataFrame([], CELL), spark.createDataFrame([], REPORT)
    tagged = _cells(population, plans, id_col)
    counted = defaultdict(dict)
    for r in tagged.groupBy("plan_id", "cell").count().collect():  # bounded by the combinations of target categories
        counted[r.plan_id][tuple(r.cell)] = r["count"]
    for p in plans:
        found = counted[p.plan_id]
        keys, goals = sorted(found), list(p.goals)
        x = np.array([[float(k[p.fields.index(f)] == c) for f, c in goals] for k in keys]).reshape(len(keys), len(goals))
        n = np.array([found[k] for k in keys], float)
        available = x.T @ n if len(keys) else np.zeros(len(goals))
        want = np.array([min(p.goals[g][3], a) for g, a in zip(goals, available, strict=True)], float)
        pi = tilt(n, x, want)
        expected = x.T @ (n * pi) if len(keys) else np.zeros(len(goals))
        for j, g in enumerate(goals):
            name, pct, floor, need = p.goals[g]
            short = max(0, need - int(expected[j] + 1e-4))
            report.append((p.plan_id, g[0], name, g[1], pct, floor, need, int(available[j]), float(expected[j]), short, max(0, need - int(available[j]))))
        cells += [(p.plan_id, list(k), float(q), int(m)) for k, q, m in zip(keys, pi, n, strict=True) if q > EPS]
    return tagged, spark.createDataFrame(cells, CELL), spark.createDataFrame(report, REPORT)


DUEL = "plan_id int, cell array<string>, id string, pi double, u double, p double"


def _duels(across: bool):
    """Streams rows sorted by plan and cell; one undecided unit is carried on. across: carry it from cell to cell of a plan."""

    def run(batches):
        held = None  # (the unit's row as a table of one, its key, its probability)
        for b in batches:
            if not b.num_rows:
                continue
            plans = b.column(0).to_pylist()
            keys = plans if across else list(zip(plans, map(tuple, b.column(1).to_pylist()), strict=True))
            draws, new = b.column(4).to_pylist(), b.column(5).to_pylist()
            out, at, shape, left = [], -1, None, 0.0  # at: the place of the undecided unit in this batch, -1 none, -2 in an earlier one
            if held is not None:
                at, shape, left = -2, held[1], held[2]
            before = None  # how the unit of an earlier batch ends
            for i, key in enumerate(keys):
                if at != -1 and shape != key:
                    if at == -2:
                        before = left
                    else:
                        new[at] = left
                        out.append(at)
                    at = -1
                shape = key
                if at == -1:
                    at, left = i, new[i]
                    continue
                s, r = left + new[i], draws[i]
                if s < 1 - EPS:  # one of them is out
                    if r * s < left:
                        left = s
                    else:
                        at, left = i, s
                else:  # one of them is in
                    if r * (2 - s) < 1 - new[i]:
                        winner, loser = at, i
                    else:
                        winner, loser = i, at
                    if winner == -2:
                        before = 1.0
                    else:
                        new[winner] = 1.0
                        out.append(winner)
                    at, left = (loser, s - 1) if s - 1 > EPS else (-1, 0.0)
            if before is not None:
                yield held[0].set_column(5, "p", pa.array([before], pa.float64()))
            if out:
                yield b.set_column(5, "p", pa.array(new, pa.float64())).take(pa.array(out, pa.int64()))
            if at == -1:
                held = None
            elif at == -2:
                held = (held[0], shape, left)
            else:
                held = (b.slice(at, 1), shape, left)
        if held is not None:
            yield held[0].set_column(5, "p", pa.array([held[2]], pa.float64()))

    return run


def sample_report(report: DataFrame, drawn: DataFrame) -> DataFrame:
    """The report with the rows that were drawn for each target, and their share of the plan's sample in percent."""
    plans = report.groupBy("plan_id").agg(F.array_sort(F.collect_set("field_path")).alias("fields"))  # a row a plan
    parts = drawn.groupBy("plan_id", "cell").count().join(plans, "plan_id").select("plan_id", "count", F.explode(F.arrays_zip("fields", "cell")).alias("f"))
    got = parts.groupBy("plan_id", F.col("f.fields").alias("field_path"), F.col("f.cell").alias("key")).agg(F.sum("count").alias("drawn"))
    total = drawn.groupBy("plan_id").agg(F.count("*").alias("rows"))
    joined = report.join(got, ["plan_id", "field_path", "key"], "left").join(total, "plan_id", "left")
    return joined.withColumns({"drawn": F.coalesce("drawn", F.lit(0)), "actual_pct": F.coalesce(100.0 * F.col("drawn") / F.col("rows"), F.lit(0.0))}).drop("key", "rows")


def pivotal_sample(tagged: DataFrame, cells: DataFrame, seed: int = 11, buckets: int | None = None) -> DataFrame:
    """(plan_id, cell, id, pi) of the drawn records. The draw depends on seed, ids and buckets, not on the input's partitions."""
    if buckets is None:
        units = cells.where(F.col("pi") < 1 - EPS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n  # a row a cell
        buckets = max(8, -(-units // BUCKET_UNITS))
    draw = lambda salt: (F.pmod(F.xxhash64(F.lit(f"{seed}|{salt}"), "plan_id", "id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    units = tagged.join(F.broadcast(cells.drop("n")), ["plan_id", "cell"]).withColumns({"id": F.col("id").cast("string"), "u": draw("u"), "p": F.col("pi")})
    sure = units.where(F.col("p") >= 1 - EPS)
    rest = units.where(F.col("p") < 1 - EPS).repartition(buckets, F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(buckets))).sortWithinPartitions("plan_id", "cell", "u", "id")
    columns = [c.split()[0] for c in DUEL.split(", ")]
    first = rest.select(columns).mapInArrow(_duels(False), DUEL).withColumn("u", draw("v"))
    # at most one undecided unit a bucket and cell is left, so a single task takes them all
    last = first.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS)).repartition(1).sortWithinPartitions("plan_id", "cell", "u", "id").select(columns).mapInArrow(_duels(True), DUEL)
    decided = last.where((F.col("p") >= 1 - EPS) | ((F.col("p") > EPS) & (draw("w") < F.col("p"))))
    keep = ["plan_id", "cell", "id", "pi"]
    return sure.select(keep).unionByName(first.where(F.col("p") >= 1 - EPS).select(keep)).unionByName(decided.select(keep))
