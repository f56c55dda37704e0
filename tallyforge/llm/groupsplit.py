"""Problem 4: splits that keep tied records together.

Records tied by an equal key, directly or through others, form a component. Components come from an incrementally kept table:
each batch hooks its records to the components that already own their keys, merges by pointer jumping, and adds a version to the
table that holds its own records and keys and the labels that changed; nothing that stands is written again. Components that have a
split keep it, new ones fill the deficits of the target shares, and a merge of components with different splits is quarantined: the
old records stay where they are, the records that tie them get no split.

Defined results: null ids are ignored; null and blank keys and the given default values tie nothing; a record without keys is a
component of its own; repeats count once; an empty batch leaves the table as it is; the shares may be missed by up to one large
component. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import squeezed
from tallyforge.session import Scratch

MAX_ROUNDS = 60
#: The target table is read by the driver; a larger one is refused.
MAX_TARGETS = 1000


def record_keys(records: DataFrame, id_col: str, values: dict[str, Column], arrays: dict[str, Column], neutral: tuple[str, ...]) -> DataFrame:
    """(id, key) of every record; key is null where a record has none. Keys are equal when letters and digits agree without case."""
    out = ["".join(c for c in n.lower() if c.isalnum()) for n in neutral]
    tag = lambda name, c: F.when(~squeezed(c).isin(out), F.concat(F.lit(f"{name}:"), squeezed(c)))
    each = lambda name, c: F.coalesce(F.transform(c, lambda x: tag(name, x)), F.array().cast("array<string>"))
    made = [F.array(tag(n, c)) for n, c in values.items()] + [each(n, c) for n, c in arrays.items()]
    keys = F.array_compact(F.concat(*made))
    return records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.explode_outer(keys).alias("key"))


def _kept(scratch: Scratch, df: DataFrame, flag: str | None = None) -> tuple[DataFrame, int]:
    """The written table, and how many of its rows there are, or have the flag; counted as they are written."""
    seen = Observation()
    out = scratch.keep(df.observe(seen, (F.count_if(flag) if flag else F.count(F.lit(1))).alias("n")))
    return out, seen.get["n"]


def _jumped(parent: DataFrame) -> DataFrame:
    """Each pointer goes to where its target points; moved tells those that changed."""
    up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return parent.select("node", "root").join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved"))


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of all nodes on edges (u, v); root is the smallest node of the component.

    Each round hooks every root to the smallest one at most two edges off, jumps pointers until all point to a root, and contracts
    the edges; the rounds' pointers are followed one after another at the end.
    """
    e, left = _kept(scratch, edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while left:
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("the components did not settle")
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        parent = scratch.keep(around.join(near, "v").groupBy("u").agg(F.min("m").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
        moved = 1
        while moved:
            last = parent
            parent, moved = _kept(scratch, _jumped(_jumped(_jumped(parent))), "moved")
            scratch.drop(last)
        parent = parent.select("node", "root")
        rounds.append(parent)
        step = e.join(parent.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(parent.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        last = e
        e, left = _kept(scratch, step.where("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        scratch.drop(last)
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    labels = rounds[0]
    for parent in rounds[1:]:
        labels = labels.join(parent.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return scratch.keep(labels) if len(rounds) > 1 else labels


COMPONENT = "id string, component string, split string, quarantined boolean"
MEMBER = "id string, node string, split string, held boolean"
KEY = "key string, node string"
LABEL = "node string, root string, version int"
CONFLICT = "node string"


class ComponentTable:
    """Versions v0, v1, ... under a folder; the versions up to the highest complete one hold together.

    Each adds its members (MEMBER) and keys (KEY) under the component they had then, the components whose label changed (LABEL, the
    newest holds) and those whose splits are at odds (CONFLICT). What a batch writes grows with the batch and with what it merges.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.version = -1
        while self._done(self.version + 1):
            self.version += 1

    def _done(self, v: int) -> bool:
        return self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}/labels/_SUCCESS"))

    def _read(self, part: str, schema: str) -> DataFrame:
        if self.version < 0:
            return self.spark.range(1).selectExpr(*[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", ")]).where(F.lit(False))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/v{v}/{part}" for v in range(self.version + 1)])

    @property
    def labels(self) -> DataFrame:
        """(node, root) of the components that were merged into another."""
        return self._read("labels", LABEL).groupBy("node").agg(F.max_by("root", "version").alias("root"))

    def _now(self, df: DataFrame) -> DataFrame:
        """node becomes the component that it belongs to now."""
        return df.join(self.labels, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("node", "root")

    @property
    def members(self) -> DataFrame:
        odds = self._now(self._read("conflicts", CONFLICT)).select("component", F.lit(True).alias("odds")).distinct()
        now = self._now(self._read("members", MEMBER)).join(odds, "component", "left")
        return now.select("id", "component", "split", (F.col("held") | F.coalesce("odds", F.lit(False))).alias("quarantined"))

    @property
    def keys(self) -> DataFrame:
        return self._now(self._read("keys", KEY)).select("key", "component")

    def update(self, keyed: DataFrame, targets: DataFrame | None, seed: int = 7) -> DataFrame:
        """Adds a batch of (id, key); returns the members of the new version. targets None: the components get no split."""
        scratch = Scratch(self.spark, "components")
        old, old_keys = self.members, self.keys
        # a key's hub is the component that owns it, else the smallest id of the batch with it; a record known by id is its component
        node = keyed.distinct().join(old.select("id", F.col("component").alias("was")), "id", "left").select("id", "key", F.coalesce("was", "id").alias("node"), F.col("was").isNotNull().alias("known"))
        node = scratch.keep(node)
        hubs = node.where("key IS NOT NULL").groupBy("key").agg(F.min("node").alias("first"))
        hubs = scratch.keep(hubs.join(old_keys, "key", "left").select("key", F.coalesce("component", "first").alias("hub"), F.col("component").isNotNull().alias("owned")))
        edges = node.where("key IS NOT NULL").select("key", "node").distinct().join(hubs, "key").select(F.col("node").alias("u"), F.col("hub").alias("v"))
        roots = connected(edges, scratch)
        label = lambda df, col: df.join(roots.select(F.col("node").alias(col), F.col("root")), col, "left").withColumn("component", F.coalesce("root", F.col(col))).drop("root")
        # the old components that this batch touches, under their new label
        touched = roots.select("node").unionByName(node.where("known").select("node")).distinct()
        named = old.select(F.col("component").alias("node"), "split").distinct().join(touched, "node", "left_semi")
        named = scratch.keep(label(named, "node"))
        held = scratch.keep(named.groupBy("component").agg(F.min("split").alias("split"), (F.count_distinct("split") > 1).alias("conflict")))
        fresh = scratch.keep(label(node.where("NOT known").select("id", "node").distinct(), "node").select("id", "component"))
        sizes = fresh.join(held.select("component"), "component", "left_anti").groupBy("component").agg(F.count("*").alias("size"))
        given = assign(scratch.keep(sizes), old, targets, seed, scratch) if targets is not None else sizes.select("component", F.lit(None).cast("string").alias("given")).where(F.lit(False))
        joined = fresh.join(held, "component", "left").join(given, "component", "left")
        odds = F.coalesce("conflict", F.lit(False))
        new = joined.select("id", F.col("component").alias("node"), F.when(~odds, F.coalesce("split", "given")).alias("split"), odds.alias("held"))
        changed = named.where("node != component").select("node", "component").distinct()
        moved = self.labels.select("node", F.col("root").alias("was")).join(changed.select(F.col("node").alias("was"), "component"), "was").select("node", "component")
        version = self.version + 1
        at = f"{self.path}/v{version}"
        new.write.mode("overwrite").parquet(f"{at}/members")
        label(hubs.where("NOT owned").select("key", F.col("hub").alias("node")), "node").select("key", F.col("component").alias("node")).write.mode("overwrite").parquet(f"{at}/keys")
        held.where("conflict").select(F.col("component").alias("node")).write.mode("overwrite").parquet(f"{at}/conflicts")
        changed.unionByName(moved).select("node", F.col("component").alias("root"), F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{at}/labels")
        self.version = version
        return self.members


def assign(sizes: DataFrame, old: DataFrame, targets: DataFrame, seed: int, scratch: Scratch, big: int = 1000) -> DataFrame:
    """(component, given) of new components, filling what each split lacks of its share of all records.

    Components of more than 1/big of all new records, at most big of them, go one by one to the split that lacks most. The others
    are laid end to end in a seeded order and cut at the remaining deficits, by running sums of 1,024 hash ranges and, inside a
    range, of its components.
    """
    rows = targets.select("split_name", "target_pct").distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} split targets")
    want = [(r.split_name, float(r.target_pct)) for r in rows if r.split_name and r.target_pct]
    if not want:
        return sizes.select("component", F.lit(None).cast("string").alias("given"))
    want.sort(key=lambda x: (-x[1], x[0]))
    has = {r.split: r["count"] for r in old.where("split IS NOT NULL").groupBy("split").count().collect()}
    new = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    total, share = new + sum(has.get(s, 0) for s, _ in want), sum(p for _, p in want)
    lack = {s: total * p / share - has.get(s, 0) for s, p in want}
    large = sizes.where(F.col("size") > max(1, new // big)).orderBy(F.desc("size"), "component").limit(big).collect()
    chosen = []
    for r in large:
        s = max(lack, key=lambda k: lack[k])
        lack[s] -= r["size"]
        chosen.append((r.component, s))
    spark = sizes.sparkSession
    first = spark.createDataFrame(chosen, "component string, given string")
    rest = sizes.join(F.broadcast(first), "component", "left_anti").withColumn("h", F.xxhash64(F.lit(seed), "component"))
    rest = rest.withColumn("range", F.pmod("h", F.lit(1024)))
    ranges = {r["range"]: r.n for r in rest.groupBy("range").agg(F.sum("size").alias("n")).collect()}
    starts, at = [], 0
    for k in range(1024):
        starts.append((k, at))
        at += ranges.get(k, 0)
    short = {s: max(0.0, x) for s, x in lack.items()}
    scale, edge, cuts = (at / sum(short.values()) if sum(short.values()) else 0.0), 0.0, []
    for s, _ in want:
        edge += short[s] * scale
        cuts.append((edge, s))
    run = rest.join(F.broadcast(spark.createDataFrame(starts, "range long, start long")), "range")
    run = run.withColumn("mid", F.expr("start + sum(size) OVER (PARTITION BY range ORDER BY h, component) - size / 2"))
    pick = F.lit(cuts[-1][1])
    for cut, s in reversed(cuts):
        pick = F.when(F.col("mid") < cut, s).otherwise(pick)
    return first.unionByName(run.select("component", pick.alias("given")))


def tied_pairs(members: DataFrame) -> DataFrame:
    """(first, other): the smallest id of each component with each other id of it."""
    top = members.groupBy("component").agg(F.min("id").alias("first"))
    return members.join(top, "component").where("id != first").select("first", F.col("id").alias("other"))


def split_report(members: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each split; quarantined records have none."""
    n = members.groupBy(F.coalesce("split", F.lit("quarantined")).alias("split_name")).agg(F.count("*").alias("records"), F.count_distinct("component").alias("components"))
    share = F.expr("100.0 * records / sum(records) OVER ()")  # a row a split
    return n.join(targets.select("split_name", "target_pct").distinct(), "split_name", "left").select("split_name", "target_pct", "records", "components", share.alias("actual_pct"))
