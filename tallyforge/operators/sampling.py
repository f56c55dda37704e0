"""Generation, sampling and splitting."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hashed_share(key: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on the key and the seed only: 32 bits of an MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def slot_product(spark: SparkSession, slots: dict[str, list]) -> DataFrame:
    """All combinations of small literal lists."""
    return spark.createDataFrame([tuple(map(str, p)) for p in product(*slots.values())], ", ".join(f"{k} string" for k in slots))


def stratified_choice(key: Column, seed: str, mix: list[tuple[str, float]]) -> Column:
    """A label drawn by hash in given shares; the last takes the rest."""
    u, edge, out = hashed_share(key, seed), 0.0, None
    for name, share in mix[:-1]:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return F.lit(mix[-1][0]) if out is None else out.otherwise(mix[-1][0])


def rotated_pick(start: Column, options: Column, family: Column) -> Column:
    """The first option, from a start place on, whose family differs; the one at the start where none does."""
    n = F.size(options)
    turned = F.concat(F.slice(options, start + 1, n), F.slice(options, F.lit(1), start))
    return F.coalesce(F.try_element_at(F.filter(turned, lambda m: F.split_part(m, F.lit("-"), F.lit(1)) != family), F.lit(1)), F.try_element_at(turned, F.lit(1)))


def family_split(families: DataFrame, shares: tuple[float, float] = (0.5, 0.3)) -> DataFrame:
    """families: (family, category, size). (family, category, size, part) with families whole and each category near its shares.

    The families of a category are laid end to end in a seeded order and cut at its targets: a family goes where its middle lies, so a
    part is off by half a family at most. One rule at every size: running sums over 4,096 hash ranges, then inside of each range, equal
    the sums over the whole category.
    """
    keyed = families.withColumn("order", F.md5(F.concat(F.lit("split|"), "family"))).withColumn("range", F.substring("order", 1, 3))
    ranges = keyed.groupBy("category", "range").agg(F.sum("size").alias("here"))
    ranges = ranges.select("category", "range", F.expr("sum(here) OVER (PARTITION BY category ORDER BY range) - here").alias("start"), F.expr("sum(here) OVER (PARTITION BY category)").alias("total"))  # at most 4,096 rows a category
    run = keyed.join(ranges, ["category", "range"]).withColumn("upto", F.expr("start + sum(size) OVER (PARTITION BY category, range ORDER BY order, family)"))
    middle = (2 * F.col("upto") - F.col("size")) / (2 * F.col("total"))
    part = F.when(middle < shares[0], "train").when(middle < shares[0] + shares[1], "dev").otherwise("held_out")
    return run.select("family", "category", "size", part.alias("part"))


def plugged(df: DataFrame, judge, schema: str) -> DataFrame:
    """A judge as a function of pandas batches: the place of a model or a remote call, which this library doesn't make itself."""

    def run(batches):
        for pdf in batches:
            yield judge(pdf)

    return df.mapInPandas(run, schema)


def stepped(value: Column, steps: list[tuple[float, str]], otherwise: str, missing: str) -> Column:
    """The label of the highest bound that a value reaches; steps in descending order."""
    out = F.when(value.isNull(), missing)
    for bound, label in steps:
        out = out.when(value >= bound, label)
    return out.otherwise(otherwise)


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """The mean of what is there, by weight; null where nothing is."""
    have = sum(F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts)
    return F.try_divide(sum(F.coalesce(c, F.lit(0.0)) * w for c, w in parts), have)
