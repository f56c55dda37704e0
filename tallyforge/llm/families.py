"""Near sets by relations of sets: the answers of a subset are derived from those of the set that leads it.

Used for problem 6. Exact: leaders are joined at the bound of their smallest member, over index lists whose entries are skipped by
position, size and word bitmap before a pair is made (setsim).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.setsim import BROADCAST_LINES, ENTRY, SKETCH_BITS, _entries, _hashed, _hints, _sketch
from tallyforge.session import Scratch

#: A set may miss so many words of its family's leader.
MISSING = 2


def _rarest(sketch):
    def run(batches):
        held = sketch.value
        for b in batches:
            if not b.num_rows:
                continue
            toks = b.column("toks")
            off = toks.offsets.to_numpy()
            vals = toks.values.to_numpy()[off[0] : off[-1]]
            off = off - off[0]
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            order = np.lexsort((vals, held[vals & ((1 << SKETCH_BITS) - 1)], row))
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("n"), b.column("line"), pa.array(vals[order][off[:-1]])], ["cid", "n", "line", "rarest"])

    return run


def families(kept: DataFrame, sketch, scratch: Scratch) -> DataFrame:
    """(cid, line, n, leader, removed): a class whose words are those of its leader without one or two of them joins it.

    Leaders are the largest classes among those with one rarest word; a class that isn't such a subset leads itself.
    """
    tagged = scratch.keep(kept.select("cid", "n", "line", _hashed()).mapInArrow(_rarest(sketch), "cid long, n int, line string, rarest long"))
    lead = tagged.groupBy("rarest").agg(F.max_by(F.struct("cid", "n", "line"), F.struct("n", "line")).alias("l"))
    own, top = F.split("line", " "), F.split("l.line", " ")
    joins = (F.col("cid") != F.col("l.cid")) & (F.col("l.n") - F.col("n")).between(1, MISSING) & (F.size(F.array_except(own, top)) == 0)
    removed = F.when(joins, F.array_except(top, own)).otherwise(F.array().cast("array<string>"))
    return scratch.keep(tagged.join(lead, "rarest").select("cid", "line", "n", F.when(joins, F.col("l.cid")).otherwise(F.col("cid")).alias("leader"), removed.alias("removed")))


def near_by_families(kept: DataFrame, scratch: Scratch, p: int, q: int) -> DataFrame:
    """(line_a, line_b) of near different classes: leaders are joined at the bound of their smallest member, and what the members
    share follows from what the leaders share and the few words that members lack."""
    spark = kept.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(kept))
    family = families(kept, sketch, scratch)
    leaders = scratch.keep(family.groupBy("leader").agg(F.min("n").alias("m"), F.max(F.when(F.col("cid") == F.col("leader"), F.col("line"))).alias("line"), F.count("*").alias("classes")).withColumnRenamed("leader", "cid"))
    made = leaders.select("cid", "m", _hashed()).mapInArrow(_entries(sketch, p, q, [], MISSING), f"{ENTRY}, m int")
    x, y = made.alias("x"), made.where("early").drop("early").alias("y")
    least = f"(({p} * (x.m + y.m) + {p + q - 1}) div {p + q})"
    on = F.expr(
        f"x.tok = y.tok AND (x.n > y.n OR (x.n = y.n AND x.cid < y.cid)) AND {q} * y.n >= {p} * x.m"
        f" AND least(x.n - x.pos, y.n - y.pos) >= {least} AND bit_count(x.bits ^ y.bits) <= x.n + y.n - 2 * {least}"
    )
    pairs = scratch.keep(x.join(y, on).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct())
    hint, wide = _hints(pairs.count())
    side = lambda k: leaders.select(F.col("cid").alias(k), F.col("line").alias(f"lead_{k}"), F.col("m").alias(f"m_{k}"))
    wa, wb = F.split("lead_a", " "), F.split("lead_b", " ")
    shared = F.size(F.array_intersect(wa, wb))
    met = wide(hint(pairs).join(side("a"), "a")).join(side("b"), "b").withColumn("shared", shared).where((p + q) * F.col("shared") >= p * (F.col("m_a") + F.col("m_b")))
    met = met.select("a", "b", "lead_a", "lead_b", "shared")
    alone = leaders.where("classes > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.col("line").alias("lead_a"), F.col("line").alias("lead_b"), F.size(F.split("line", " ")).alias("shared"))
    met = scratch.keep(met.unionByName(alone))
    hint = F.broadcast if met.count() <= BROADCAST_LINES else (lambda d: d)
    of = lambda k: family.select(F.col("leader").alias(k), F.col("line").alias(f"line_{k}"), F.col("n").alias(f"n_{k}"), F.col("removed").alias(f"removed_{k}"))
    half = scratch.keep(of("a").join(hint(met), "a"))
    each = of("b").join(F.broadcast(half) if half.count() <= BROADCAST_LINES else half, "b")
    lost = F.size(F.array_intersect("removed_a", wb)) + F.size(F.array_intersect("removed_b", wa)) - F.size(F.array_intersect("removed_a", "removed_b"))
    near = each.withColumn("both", F.col("shared") - lost).where((p + q) * F.col("both") >= p * (F.col("n_a") + F.col("n_b")))
    different = (F.col("a") != F.col("b")) | (F.col("line_a") < F.col("line_b"))
    return scratch.keep(near.where(different & (F.col("line_a") != F.col("line_b"))).select("line_a", "line_b"))
