"""Problem 8: mixes of sources at target shares of the total size.

The total of a mix is the largest at which no source needs more than max_repeats copies of itself. Each source then has a budget
of tokens: whole copies of the source first, and for the rest a subset whose sizes sum to it. Documents are counted by exact token
length; an even part of each length comes first, and a bounded-knapsack program over the lengths fits what is left of the budget
to the token, or as near below as can be. The documents of a length are picked in a seeded order.

Defined results: documents without tokens, without id or without source are in no mix; ids are taken as unique; a source without
documents contributes nothing and is reported with its gap, it doesn't bound the others; weights needn't sum to one; without
documents or targets the mix is empty.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TARGETS = 10_000
#: The knapsack program runs over remaining budgets up to this; what is beyond is filled by an even part and the longest first.
FIT_TOKENS = 500_000
#: Documents of a length are picked by hash cells, ranked only inside the cell where the pick ends.
CELLS = 64


def _fill(lengths: np.ndarray, spare: np.ndarray, left: int) -> np.ndarray:
    """Bounded knapsack: the spare documents whose lengths sum to as much of left as can be. came[s] is the binary part of a length's
    count with which the sum s was reached first, so the parts of a sum are read back along it."""
    take, came = np.zeros(len(lengths), np.int64), np.full(left + 1, -1, np.int32)
    came[0] = 0
    parts: list[tuple[int, int]] = [(0, 0)]
    for j in range(len(lengths)):
        n, size = min(int(spare[j]), left // int(lengths[j])), 1
        while n > 0:
            m = min(size, n)
            n, size = n - m, size * 2
            step = m * int(lengths[j])
            new = np.flatnonzero((came[: left + 1 - step] >= 0) & (came[step:] < 0)) + step
            parts.append((j, m))
            came[new] = len(parts) - 1
        if came[left] >= 0:
            break
    s = int(np.flatnonzero(came >= 0)[-1])
    while s:
        j, m = parts[came[s]]
        take[j] += m
        s -= m * int(lengths[j])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is as near to budget as can be without passing it.

    An even part of every length comes first, so that the pick keeps the source's lengths; the program fits the rest. Where the rest
    can't be fitted to the token, a smaller even part is tried, down to none, which finds the best sum there is for budgets up to
    FIT_TOKENS.
    """
    total = int(lengths @ counts) if len(lengths) else 0
    if budget >= total:
        return counts.copy()
    best = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return best
    most = int(lengths.max())
    for share in (1.0, 0.9, 0.5, 0.0):
        take = counts * int(budget * share) // total
        left, spare = budget - int(lengths @ take), counts - take
        reserve = FIT_TOKENS if share == 0 else min(FIT_TOKENS, max(64, len(lengths)) * most)
        for j in np.argsort(-lengths):  # what is left beyond the program's reach is cut down by the longest first
            if left <= reserve:
                break
            more = min(int(spare[j]), (left - reserve) // int(lengths[j]))
            take[j] += more
            spare[j] -= more
            left -= more * int(lengths[j])
        take = take + _fill(lengths, spare, left)
        if take @ lengths > best @ lengths:
            best = take
        if best @ lengths == budget:
            break
    return best


def plan_mix(targets: list[tuple[int, str, float, int]], sizes: dict[str, tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """Budgets, whole copies and picks by length of every source of every mix."""
    by = defaultdict(list)
    for mix, source, weight, repeats in sorted(targets):
        by[mix].append((source, max(0.0, weight), max(0, repeats)))
    out = []
    for mix, rows in by.items():
        held = {s: int(sizes[s][0] @ sizes[s][1]) if s in sizes else 0 for s, _, _ in rows}
        weights = sum(w for _, w, _ in rows)
        bound = [held[s] * r * weights / w for s, w, r in rows if w > 0 and held[s] * r > 0]
        total = min(bound, default=0.0)
        for s, w, r in rows:
            budget = min(int(total * w / weights) if weights else 0, held[s] * r)
            whole = budget // held[s] if held[s] else 0
            none = np.zeros(0, np.int64)
            lengths, counts = sizes.get(s, (none, none))
            take = fit(lengths, counts, budget - whole * held[s]) if whole < r else np.zeros(len(lengths), np.int64)
            out.append({"mix_id": mix, "source": s, "target_weight": w / weights if weights else 0.0, "max_repeats": r, "budget": budget, "whole": whole, "lengths": lengths, "take": take, "got": whole * held[s] + int(lengths @ take)})
    return out


class Mixture:
    """docs: (doc_id, source, tokens), a written table: it is read for the counts and again for the picks."""

    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 3):
        self.spark, self.seed = docs.sparkSession, seed
        rows = targets.where("mix_id IS NOT NULL AND source IS NOT NULL").groupBy("mix_id", "source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r")).limit(MAX_TARGETS + 1).collect()
        if len(rows) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        wanted = [(r.mix_id, r.source, float(r.w or 0), int(r.r or 0)) for r in rows]
        names = self.spark.createDataFrame([(s,) for s in sorted({w[1] for w in wanted})], "source string")
        cell = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(CELLS)).cast("int")
        self.docs = docs.where("doc_id IS NOT NULL AND tokens > 0").join(F.broadcast(names), "source", "left_semi").withColumn("cell", cell)
        # one row for each source, distinct length and hash cell: bounded by the lengths that occur, not by the documents
        self.counted = self.docs.groupBy("source", "tokens").count().toPandas()
        sizes = {s: (g["tokens"].to_numpy(np.int64), g["count"].to_numpy(np.int64)) for s, g in self.counted.sort_values(["source", "tokens"]).groupby("source")}
        self.plan = plan_mix(wanted, sizes)

    def chosen(self) -> DataFrame:
        """(mix_id, doc_id, source, tokens, copies)."""
        whole = self.spark.createDataFrame([(p["mix_id"], p["source"], p["whole"]) for p in self.plan], "mix_id int, source string, whole int")
        takes = self.spark.createDataFrame([(p["mix_id"], p["source"], int(n), int(k)) for p in self.plan for n, k in zip(p["lengths"], p["take"], strict=True) if k], "mix_id int, source string, tokens int, take long")
        cells = self.docs.groupBy("source", "tokens", "cell").agg(F.count("*").alias("here"))
        cut = cells.join(F.broadcast(takes), ["source", "tokens"]).withColumn("upto", F.expr("sum(here) OVER (PARTITION BY mix_id, source, tokens ORDER BY cell)"))
        cut = cut.select("mix_id", "source", "tokens", "cell", F.least("here", F.greatest(F.lit(0), F.col("take") - F.col("upto") + F.col("here"))).alias("most")).where("most > 0")
        order = F.expr(f"row_number() OVER (PARTITION BY source, tokens, cell ORDER BY xxhash64({self.seed + 1}, doc_id), doc_id)")
        extra = self.docs.withColumn("nth", order).join(cut, ["source", "tokens", "cell"]).where("nth <= most").select("mix_id", "doc_id", "source", "tokens", F.lit(1).alias("copies"))
        base = self.docs.join(F.broadcast(whole.where("whole > 0")), "source").select("mix_id", "doc_id", "source", "tokens", F.col("whole").alias("copies"))
        return base.unionByName(extra).groupBy("mix_id", "doc_id", "source", "tokens").agg(F.sum("copies").cast("int").alias("copies"))

    def shares(self, chosen: DataFrame) -> DataFrame:
        """Target and actual share of each source, from the chosen documents themselves."""
        plan = self.spark.createDataFrame([(p["mix_id"], p["source"], p["target_weight"], p["max_repeats"], p["budget"]) for p in self.plan], "mix_id int, source string, target_share double, max_repeats int, budget_tokens long")
        got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("got"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
        total = got.groupBy("mix_id").agg(F.sum("got").alias("total"))
        return plan.join(F.broadcast(got), ["mix_id", "source"], "left").join(F.broadcast(total), "mix_id", "left").select(
            "mix_id", "source", "target_share", "max_repeats", "budget_tokens", F.coalesce("got", F.lit(0)).alias("actual_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.try_divide("got", "total"), F.lit(0.0)).alias("actual_share"),
        )
