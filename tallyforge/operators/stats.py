"""Paired statistics: bootstrap, exact test, medians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import Scratch


def ranked(df: DataFrame, groups: list[str], value: str, ties: str) -> DataFrame:
    """df with, inside its group and in the order of value, k (its place from 0), rank (the place of the first of its ties), upto (how
    many are not greater) and n (the size of the group).

    No group is gathered into one task: rows are range-partitioned by group and value, so that ties stay together, ranked inside
    their partition, and shifted by the counts of the group's partitions before, a table of at most groups + partitions rows.
    """
    spark = df.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = Scratch(spark, "ranked").keep(df.repartitionByRange(parts, *groups, value).withColumn("__p", F.spark_partition_id()))
    each = kept.groupBy(*groups, "__p").agg(F.count("*").alias("__c"))
    key = ", ".join(groups)
    by = f"PARTITION BY {key}" if groups else ""
    offset = each.withColumns({"__o": F.expr(f"coalesce(sum(__c) OVER ({by} ORDER BY __p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"), "n": F.expr(f"sum(__c) OVER ({by})")}).drop("__c")
    inside = f"OVER (PARTITION BY {', '.join([*groups, '__p'])} ORDER BY {value}"
    own = kept.withColumns({"__k": F.expr(f"row_number() {inside}, {ties}) - 1"), "__r": F.expr(f"rank() {inside}) - 1"), "__u": F.expr(f"count(*) {inside} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")})
    out = own.join(offset, [*groups, "__p"])
    return out.withColumns({"k": F.col("__o") + F.col("__k"), "rank": F.col("__o") + F.col("__r"), "upto": F.col("__o") + F.col("__u")}).drop("__o", "__k", "__r", "__u", "__p")


#: Records of 16 bytes up to this number are broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000


def bootstrap_ci(diffs: DataFrame, rounds: int, seed: int) -> DataFrame:
    """diffs: (k, diff), k from 0 to n - 1. Mean and 2.5 / 97.5 percent bounds over seeded resamples.

    Draws are the first 32 bits of an MD5 of seed, round and place, so any engine gets the same ones. Draws are counted by the record
    that they hit, round by round; the join is on the drawn place and the sums are pre-aggregated.
    """
    spark, n = diffs.sparkSession, diffs.count()
    if not n:
        return spark.createDataFrame([], "low double, high double")
    draws = spark.range(rounds * n).select(F.expr(f"id div {n}").alias("b"), F.expr(f"id % {n}").alias("i"))
    place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "b", "i")), 1, 8), 16, 10).cast("long"), F.lit(n))
    held = F.broadcast(diffs) if n <= BROADCAST_ROWS else diffs
    means = draws.select("b", place.alias("k")).join(held, "k").groupBy("b").agg(F.avg("diff").alias("mean"))
    got = means.agg(F.sort_array(F.collect_list("mean")).alias("m"))
    at = lambda q: F.element_at("m", F.lit(int(q * rounds) + 1))
    return got.select(F.round(at(0.025), 10).alias("low"), F.round(at(0.975), 10).alias("high"))


def log_gamma(x: Column) -> Column:
    """Stirling's series, shifted by eight."""
    y = x + 8
    rising = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - rising


def _beta_fraction(a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function at one half. Its terms settle after some sqrt(a + b) steps."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    first = 1.0 / safe(1.0 - (a + b) * 0.5 / (a + 1.0))

    def step(s, m):
        even = m * (b - m) * 0.5 / ((a + 2 * m - 1.0) * (a + 2 * m))
        d = 1.0 / safe(1.0 + even * s["d"])
        c = safe(1.0 + even / s["c"])
        odd = -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 2 * m + 1.0))
        return F.struct(d.alias("d"), c.alias("c"), (s["h"] * d * c).alias("h")), odd

    def both(s, m):
        half, odd = step(s, m)
        # the half step is kept in a struct of its own, so that its columns are computed once
        return F.transform(F.array(half), lambda x: F.struct((1.0 / safe(1.0 + odd * x["d"])).alias("d"), safe(1.0 + odd / x["c"]).alias("c"), (x["h"] * (1.0 / safe(1.0 + odd * x["d"])) * safe(1.0 + odd / x["c"])).alias("h")))[0]

    steps = (F.sqrt(a + b) * 6 + 60).cast("int")
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, both, lambda s: s["h"])


def mcnemar_p(discordant: Column, wins: Column) -> Column:
    """One-sided exact binomial tail of wins among discordant pairs; 1 where there are none.

    The tail is the incomplete beta function at one half, by its continued fraction: the work grows with the root of the pairs, and
    nothing underflows."""
    a, b = wins.cast("double"), (discordant - wins + 1).cast("double")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + (a + b) * math.log(0.5))
    low = front * _beta_fraction(a, b) / a
    high = 1.0 - front * _beta_fraction(b, a) / b
    tail = F.when((a + 1.0) / (a + b + 2.0) > 0.5, low).otherwise(high)
    return F.when(wins <= 0, 1.0).when(wins > discordant, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(tail, F.lit(1.0))))
