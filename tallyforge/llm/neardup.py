"""Problem 6: records that differ from others by small edits.

A join by set relations. Records with equal word sets are one class, whose answers are computed once and handed to all of them. A
class that is its leader's set without a word or two is never joined: what it shares with others follows from its leader's answers
by looking up the missing words. Leaders are joined over index lists of their rarest words, whose entries are skipped by position,
size and word bitmap before a pair is made (setsim).

Defined results: null ids are ignored; lines of fewer than `least` content words are near nothing; repeats of an id count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.families import near_by_families
from tallyforge.operators.setsim import BROADCAST_LINES, classes, lines
from tallyforge.session import Scratch


class NearDuplicates:
    """links: (line_a, line_b) of near classes; members: (id, line) of every record that can be near another."""

    def __init__(self, records: DataFrame, id_col: str, line: Column, p: int = 7, q: int = 10, least: int = 8):
        self.scratch = Scratch(records.sparkSession, "neardup")
        self.ids = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))
        self.members = self.scratch.keep(lines(records, id_col, line).distinct().where(F.size(F.split("line", " ")) >= least))
        self.kept = self.scratch.keep(classes(self.members, least, []))
        self.links = near_by_families(self.kept, self.scratch, p, q)

    def pairs(self) -> DataFrame:
        """(id_a, id_b), the smaller first: the members of linked classes and those of one class."""
        several = self.kept.where("members > 1").select(F.col("line").alias("line_a"), F.col("line").alias("line_b"))
        links = self.links.select("line_a", "line_b").unionByName(several)
        small = self.links.count() + several.count() <= BROADCAST_LINES
        hint = F.broadcast if small else (lambda d: d)
        one = self.members.select(F.col("id").alias("x"), F.col("line").alias("line_a")).join(hint(links), "line_a")
        two = one.join(self.members.select(F.col("id").alias("y"), F.col("line").alias("line_b")), "line_b")
        return two.where("x != y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """(id, class_id, class_size, links): a row for each record that can be near another; class_id is the smallest id with the same word set, links the
        number of near classes."""
        links = self.links.select(F.col("line_a").alias("line")).unionByName(self.links.select(F.col("line_b").alias("line"))).groupBy("line").agg(F.count("*").alias("links"))
        named = self.members.groupBy("line").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")).join(links, "line", "left")
        return self.members.join(named, "line").select("id", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"))

    def all_groups(self) -> DataFrame:
        """The groups, and each record whose line is null or too short to be near another as a class of its own."""
        alone = self.ids.distinct().join(self.members.select("id"), "id", "left_anti")
        return self.groups().unionByName(alone.select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("links")))
