"""Problem 3: the same or almost the same signal line in an evaluation split and in the training split.

Minwise order over the words with banded buckets, cross-split candidates only, exact Jaccard, then counts by split and source.
The minima are taken rarest word first (setsim) instead of under random hashes: lines share long templates, so random bands either
miss pairs at the threshold or make most of all pairs candidates; the first minima under one common order miss none.

Defined results: rows without id, split or with a line of fewer than `least` content words have no overlap; repeats count once; a
task delivered in both splits pairs with others but never with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.setsim import BROADCAST_LINES, classes, lines, near_classes
from tallyforge.session import Scratch


def _split(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z]+", "")


def cross_split_pairs(tasks: DataFrame, id_col: str, line: Column, split: Column, source: Column, train: str = "train", held: tuple[str, ...] = ("dev", "held_out"), p: int = 7, q: int = 10, least: int = 8) -> DataFrame:
    """(held_id, train_id, split, source): split and source are those of the evaluation record."""
    s = _split(split)
    names = [h.replace("_", "") for h in held]
    rows = lines(tasks.where(s.isin([train, *names])), id_col, line, split=split, source=source, held=s.isin(names), train=s == train)
    scratch = Scratch(tasks.sparkSession, "overlap")
    kept = scratch.keep(classes(rows, least, ["held", "train"]))
    near = near_classes(kept, scratch, p, q, ("held", "train"))
    same = kept.where("held AND train").select(F.col("line").alias("line_held"), F.col("line").alias("line_train"))
    pick = lambda x, y: near.where(f"held_{x} AND train_{y}").select(F.col(f"line_{x}").alias("line_held"), F.col(f"line_{y}").alias("line_train"))
    links = scratch.keep(pick("a", "b").unionByName(pick("b", "a")).unionByName(same))
    hint = F.broadcast if links.count() <= BROADCAST_LINES else (lambda d: d)
    one = rows.where("held").select(F.col("id").alias("held_id"), F.trim("split").alias("split"), "source", F.col("line").alias("line_held")).join(hint(links), "line_held")
    one = scratch.keep(one.groupBy("held_id", "line_train").agg(F.min("split").alias("split"), F.min("source").alias("source")))
    hint = F.broadcast if one.count() <= BROADCAST_LINES else (lambda d: d)
    two = rows.where("train").select(F.col("id").alias("train_id"), F.col("line").alias("line_train")).join(hint(one), "line_train")
    return two.where(F.col("held_id") != F.col("train_id")).groupBy("held_id", "train_id").agg(F.min("split").alias("split"), F.min("source").alias("source"))


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Confirmed pairs and records by split and source of the evaluation record."""
    return pairs.groupBy("split", F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("pairs"), F.count_distinct("held_id").alias("held_records"), F.count_distinct("train_id").alias("train_records")
    )
