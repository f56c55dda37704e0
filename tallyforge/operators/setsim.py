"""Exact similarity joins of word sets at scale.

Lines with the same set of words form one class. The words of a class are ranked rarest first by a fixed-size sketch of word
frequencies (any common order is right; the sketch only makes the lists short). A set of n words that is near another must share
with it one of its first words under that order, so only those minima become buckets: n - ceil(t n) + 1 of them where it meets a
set that isn't larger, n - ceil(2t/(1+t) n) + 1 where it meets one that isn't smaller. Entries whose positions or 64-bit word
bitmaps rule the threshold out are skipped before a pair is made; what is left is verified on the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import content_line
from tallyforge.session import Scratch

SKETCH_BITS = 16
#: Pairs up to this number are broadcast (16 bytes each); beyond it the same joins shuffle.
BROADCAST_PAIRS = 200_000
#: The same for joins whose rows carry whole lines, some 400 bytes each.
BROADCAST_LINES = 30_000


def lines(df: DataFrame, id_col: str, text: Column, **more: Column) -> DataFrame:
    """(id, line, ...) of every row with an id."""
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), content_line(text).alias("line"), *[c.alias(k) for k, c in more.items()])


def classes(rows: DataFrame, least: int, flags: list[str]) -> DataFrame:
    """One row for each set of at least so many words: cid, line, n and the flags held by any of its rows, or its count of rows.

    Sizes are taken after the grouping: before it, the optimizer would compute a line once for each mention of it."""
    agg = [F.bool_or(f).alias(f) for f in flags] or [F.count("*").alias("members")]
    one = rows.groupBy("line").agg(*agg).withColumn("n", F.size(F.split("line", " ")))
    return one.where((F.col("n") >= least) & (F.col("line") != "")).withColumn("cid", F.xxhash64("line"))


def _sketch(kept: DataFrame) -> np.ndarray:
    """Counts of words by 2**SKETCH_BITS hash cells: the size is fixed, whatever the data."""
    cell = F.xxhash64("w").bitwiseAND(F.lit((1 << SKETCH_BITS) - 1))
    got = kept.select(F.explode(F.split("line", " ")).alias("w")).groupBy(cell.alias("cell")).count().toPandas()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[got["cell"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
    return out


def _hints(n: int):
    """Broadcast hints for n pairs of ids, and for n rows with a line, within their bounds."""
    plain = lambda d: d
    return (F.broadcast if n <= BROADCAST_PAIRS else plain), (F.broadcast if n <= BROADCAST_LINES else plain)


def _up(a: np.ndarray, p: int, q: int) -> np.ndarray:
    return -(-a * p // q)


ENTRY = "tok long, cid long, bits long, n int, pos int, early boolean"
def _entries(sketch, p: int, q: int, flags: list[str], slack: int | None = None):
    """slack: sets of a column m of smallest sizes stand for subsets that miss up to so many of their words."""
    families = slack is not None

    def run(batches):
        held = sketch.value
        for b in batches:
            if not b.num_rows:
                continue
            toks = b.column("toks")
            off = toks.offsets.to_numpy()
            vals = toks.values.to_numpy()[off[0] : off[-1]]
            off = off - off[0]
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((vals, held[vals & ((1 << SKETCH_BITS) - 1)], row))
            bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (vals.view(np.uint64) >> np.uint64(20)) & np.uint64(63)), off[:-1])
            pos = np.arange(len(vals)) - off[:-1][row]
            n = size[row]
            m = b.column("m").to_numpy()[row].astype(n.dtype) if families else n
            take = pos < n - _up(m, p, q) + 1
            early = pos < n - _up(n + m - (slack or 0), p, p + q) + 1
            at = row[take]
            cols = [pa.array(vals[order][take]), pa.array(b.column("cid").to_numpy()[at]), pa.array(bits.view(np.int64)[at]), pa.array(n[take].astype(np.int32)), pa.array(pos[take].astype(np.int32)), pa.array(early[take])]
            cols += [pa.array(m[take].astype(np.int32))] * families + [b.column(f).take(pa.array(at)) for f in flags]
            yield pa.RecordBatch.from_arrays(cols, [*[x.split()[0] for x in ENTRY.split(", ")], *["m"] * families, *flags])

    return run


def _hashed() -> Column:
    return F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("toks")


def near_classes(kept: DataFrame, scratch: Scratch, p: int, q: int, sides: tuple[str, str] | None = None) -> DataFrame:
    """(a, b) class ids of different sets with Jaccard similarity p/q or more. sides: one class has the first flag, the other the second."""
    spark = kept.sparkSession
    flags = list(sides or ())
    sketch = spark.sparkContext.broadcast(_sketch(kept))
    made = kept.select("cid", *flags, _hashed()).mapInArrow(_entries(sketch, p, q, flags), ", ".join([ENTRY, *[f"{f} boolean" for f in flags]]))
    probe, index = made.alias("x"), made.where("early").drop("early").alias("y")
    both = "(x.n + y.n)"
    least = f"(({p} * {both} + {p + q - 1}) div {p + q})"  # ceil(t / (1 + t) * (nx + ny))
    on = F.expr(
        f"x.tok = y.tok AND (x.n > y.n OR (x.n = y.n AND x.cid < y.cid)) AND {q} * y.n >= {p} * x.n"
        f" AND least(x.n - x.pos, y.n - y.pos) >= {least} AND bit_count(x.bits ^ y.bits) <= {both} - 2 * {least}"
    )
    if sides:
        on = on & F.expr("(x.{0} AND y.{1}) OR (x.{1} AND y.{0})".format(*sides))
    pairs = scratch.keep(probe.join(index, on).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct())
    hint, wide = _hints(pairs.count())
    a, b = (kept.select(F.col("cid").alias(k), F.col("line").alias(f"line_{k}"), *[F.col(f).alias(f"{f}_{k}") for f in flags]) for k in "ab")
    both_lines = wide(hint(pairs).join(a, "a")).join(b, "b")
    wa, wb = F.split("line_a", " "), F.split("line_b", " ")
    shared = F.size(F.array_intersect(wa, wb))
    near = both_lines.where((F.col("line_a") != F.col("line_b")) & (q * shared >= p * (F.size(wa) + F.size(wb) - shared)))
    if sides:
        near = near.where("({0}_a AND {1}_b) OR ({1}_a AND {0}_b)".format(*sides))
    return scratch.keep(near.select("a", "b", "line_a", "line_b", *[f"{f}_{k}" for f in flags for k in "ab"]))
