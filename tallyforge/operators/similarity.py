"""Overlap and similarity joins over texts: equi-joins on grams or tokens instead of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators import gramhash, setkinds
from tallyforge.session import Scratch


def grams(tokens: Column, n: int) -> Column:
    """Distinct n-grams of a token list, joined by blanks; fewer than n tokens have none."""
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def _gram_hashes(tokens: Column, n: int) -> Column:
    """The distinct n-grams of a token list as 64-bit hashes, which shuffle at a tenth of the text's size."""
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(tokens, i, n)))
    return F.when(F.size(tokens) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))


#: Grams whose left records times right records exceed this are common, at most so many of them (their places fit 16 bits).
COMMON_PAIRS, MOST_COMMON = 1000, 32_000
#: Right rows of one file that the kinds of left records are compared with.
KIND_BLOCK = 65_536


def nearest_overlap(left: DataFrame, right: DataFrame, n: int = 8) -> DataFrame:
    """left, right: (id, tokens), ids unique on a side. (id, positions, is_testable, max_overlap, nearest_id) of every left record.

    Grams are 64-bit hashes. Those that the other side lacks are dropped in the tasks by a sieve of cells, before any shuffle. Of the
    others, common ones (many left records times many right ones) make a record's kind: the records of a kind share the same common
    grams, so kinds are compared, and of a right kind the two smallest ids are enough, since a left record shuns only its own. Records
    that share a rare gram are paired. Such a pair counts its common grams too; any other pair shares common grams alone, so the
    greatest count over both ways is the right one. Ties go to the smallest id. A record with fewer than n tokens isn't testable, so
    its zero is no pass.
    """
    scratch = Scratch(left.sparkSession, "overlap-grams")
    files = lambda df: (lambda uri: lambda: _read_blocks(uri))(_uri(left.sparkSession, df._tallyforge_path))
    hashes = lambda df: df.select("id", F.size("tokens").alias("size"), F.transform("tokens", lambda w: F.xxhash64(w)).alias("toks"))

    def sieve(df):
        power = gramhash.power(df.agg(F.sum(F.size("grams"))).first()[0] or 0)
        return files(scratch.keep(gramhash.sieve(df, power))), power

    all_left = scratch.keep(gramhash.hashed(hashes(left), n))
    met_right = scratch.keep(gramhash.hashed(hashes(right), n, *sieve(all_left)).where(F.size("grams") > 0))
    met_left = scratch.keep(gramhash.sieved(all_left, *sieve(met_right)))
    scratch.drop(all_left)
    one = lambda df, here, there: df.select(F.explode("grams").alias("g"), F.lit(here).alias("nl"), F.lit(there).alias("nr"))
    pairs = F.col("nl") * F.col("nr")
    counted = one(met_left, 1, 0).unionByName(one(met_right, 0, 1)).groupBy("g").agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr")).where(pairs > COMMON_PAIRS)
    common = scratch.keep(counted.orderBy(pairs.desc(), "g").limit(MOST_COMMON).select("g", (F.row_number().over(Window.orderBy(pairs.desc(), "g")) - 1).alias("place")))
    kind = F.when(F.size("common") > 0, F.xxhash64("common")).alias("kind")
    x, y = (scratch.keep(gramhash.parted(df, files(common)).select("*", kind)) for df in (met_left, met_right))
    scratch.drop(met_left)
    scratch.drop(met_right)

    two = Window.partitionBy("kind").orderBy("id")
    firsts = y.where("kind IS NOT NULL").select("id", "kind", "common").withColumn("k", F.row_number().over(two)).where("k <= 2")
    at = _written_blocks(firsts, ["id", "common"], KIND_BLOCK)
    kinds = x.where("kind IS NOT NULL").groupBy("kind").agg(F.any_value("common").alias("common"))
    found = gramhash.two_best(kinds, lambda: _read_blocks(at), right.schema["id"].dataType.simpleString())
    tops = found.groupBy("kind").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "b"))), 1, 2).alias("tops"))

    rare = lambda df, side: df.select(F.col("id").alias(side), F.col("common").alias(f"common_{side}"), F.explode("rare").alias("g"))
    both = F.size(F.array_intersect("common_a", "common_b"))
    met = rare(x, "a").join(rare(y, "b"), "g").where("a != b").groupBy("a", "b").agg(F.count("*").alias("n"), F.any_value(both).alias("more"))
    rarest = met.groupBy("a").agg(F.min(F.struct((-F.col("n") - F.col("more")).alias("less"), "b")).alias("pair"))

    out = x.select("id", "size", "kind").join(tops, "kind", "left").join(rarest.withColumnRenamed("a", "id"), "id", "left")
    other = F.get(F.filter("tops", lambda t: t["b"] != F.col("id")), 0)
    best = F.least(other, F.col("pair"))
    size = F.greatest(F.col("size") - n + 1, F.lit(0))
    return out.withColumn("m", best).select("id", size.alias("positions"), (size > 0).alias("is_testable"), F.coalesce(-F.col("m.less"), F.lit(0)).alias("max_overlap"), F.col("m.b").alias("nearest_id"))


def any_overlap(left: DataFrame, right: DataFrame, n: int = 8) -> DataFrame:
    """(id, is_testable, overlaps) of every left record: whether it shares an n-gram with a right record of another id.

    No pair is made: a gram of the right side knows its smallest and greatest id, which tell whether it is another record's too.
    """
    own = right.select("id", F.explode(_gram_hashes(F.col("tokens"), n)).alias("g")).groupBy("g").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    hit = left.select("id", F.explode(_gram_hashes(F.col("tokens"), n)).alias("g")).join(own, "g").where("low != id OR high != id").select("id").distinct()
    out = left.join(hit.withColumn("hit", F.lit(True)), "id", "left")
    return out.select("id", (F.size("tokens") >= n).alias("is_testable"), F.coalesce("hit", F.lit(False)).alias("overlaps"))


class TokenClasses:
    """Records by their set of tokens: one with several records is a class, joined once, whatever its size.

    df: (id, tokens), tokens distinct and without blanks; null ids and empty sets are in no class. members: (id, line), kinds: (line,
    cid, class_id, class_size), cid a 64-bit hash of the line. Records and survivors come from sums over kinds of classes, so they need
    no row for each near pair; pairs() returns each near pair from the task that finds it, without a work table or shuffle of pairs.
    """

    def __init__(self, df: DataFrame, num: int, den: int):
        self.scratch, self.num, self.den = Scratch(df.sparkSession, "jaccard"), num, den
        # lines are filtered where they are read: a filter on tokens would make them twice
        self.members = self.scratch.keep(df.where("id IS NOT NULL").select("id", F.array_join(F.sort_array("tokens"), " ").alias("line")).distinct()).where("line != ''")
        self.kinds = self.scratch.keep(self.members.groupBy("line").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")).withColumn("cid", F.xxhash64("line")))

    def pairs(self) -> DataFrame:
        """(a, b, shared, united): near pairs of class representatives, the smaller id first."""
        return setkinds.near_pairs(self.kinds.select(F.col("class_id").alias("id"), "line"), self.scratch, self.num, self.den, self._files)

    @staticmethod
    def _files(df: DataFrame):
        uri = _uri(df.sparkSession, df._tallyforge_path)
        return lambda which=None: _read_blocks(uri, which)

    def _sums(self, values: DataFrame) -> DataFrame:
        return setkinds.NearSums(self.kinds.select("cid", "line"), self.scratch, self.num, self.den, self._files).sums(values)

    def rows(self) -> DataFrame:
        """(id, class_id, class_size, links) of every record with tokens; links counts the other near classes."""
        near = self._sums(self.kinds.select("cid", F.lit(1).cast("bigint").alias("w"), F.col("cid").alias("top")))
        of = self.kinds.drop("line").join(near.select("cid", (F.col("w") - 1).alias("links")), "cid")
        return self.members.select("id", F.xxhash64("line").alias("cid")).join(of, "cid").select("id", "class_id", "class_size", "links")

    def survivors(self, ranks: DataFrame) -> DataFrame:
        """(id, survivor, copies): of a record and all near ones the one of smallest rank, and how many near ones there are.

        ranks: (id, rank), rank any ordered value that differs from record to record."""
        ids = self.members.select("id", F.xxhash64("line").alias("cid"))
        best = self.scratch.keep(ids.join(ranks, "id").groupBy("cid").agg(F.min(F.struct("rank", "id")).alias("top"), F.count("*").alias("w")))
        near = self._sums(best)
        return ids.join(near, "cid").select("id", F.col("top.id").alias("survivor"), (F.col("w") - 1).alias("copies"))


#: Queries of one file of the query side, which a task holds at a time.
QUERY_BLOCK = 4096
#: Right rows that meet all query blocks together; cells of one dense product, 4 bytes each.
CHUNK_ROWS, CELLS = 65_536, 16_000_000


def _uri(spark: SparkSession, at: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _written_blocks(left: DataFrame, cols: list[str], rows: int | None = None) -> str:
    """The query side as files of about QUERY_BLOCK rows in the shared folder, read there by each task; the driver sees none of it."""
    spark = left.sparkSession
    at = Scratch(spark, "queries").at
    n = max(1, -(-left.count() // (rows or QUERY_BLOCK)))
    left.select(*cols, F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).repartition(n, "block").write.partitionBy("block").parquet(at)
    return _uri(spark, at)


def _read_blocks(uri: str, which: list[int] | None = None):
    """The query blocks one after another, as Arrow tables. which: places of some of them in the order of their paths."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = (fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    found = sorted(f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet"))
    for path in found if which is None else [found[k] for k in which if k < len(found)]:
        with files.open_input_file(path) as held:
            yield pq.ParquetFile(held).read()


def _chunks(batches):
    """Arrow batches put together to some CHUNK_ROWS rows."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def lexical_nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right: (id, tokens). (a, b, dot, norm2): the right record of greatest raw term-frequency cosine for each left record that
    shares a token with any, compared by dot squared over the right side's squared norm; ties go to the smallest id.

    The right side is read once. A task multiplies chunks of it with the query blocks, each cut so that its words times its queries
    stay under CELLS, and keeps the best by query: what is shuffled is queries x chunks.
    """
    import numpy as np
    import pyarrow as pa

    at = _written_blocks(left, ["id", "tokens"])

    def parts(table):
        """Runs of queries whose words times queries stay under CELLS: (ids, words, weights)."""
        vocab, ids, cells = {}, [], []

        def made():
            weights = np.zeros((max(1, len(vocab)), len(ids)), np.float32)
            if cells:
                np.add.at(weights, tuple(np.array(cells).T), 1)
            return np.array(ids, np.int64), vocab, weights

        for i, toks in zip(table.column("id").to_pylist(), table.column("tokens").to_pylist(), strict=True):
            new = len(set(toks or ()) - vocab.keys())
            if ids and (len(vocab) + new) * (len(ids) + 1) > CELLS:
                yield made()
                vocab, ids, cells = {}, [], []
            cells += [(vocab.setdefault(t, len(vocab)), len(ids)) for t in toks or ()]
            ids.append(i)
        if ids:
            yield made()

    def run(batches):
        for chunk in _chunks(batches):
            rid, counts = chunk.column("id").to_numpy(), []
            for t in chunk.column("tokens").to_pylist():
                count: dict[str, int] = {}
                for w in t or ():
                    count[w] = count.get(w, 0) + 1
                counts.append(count)
            norms = np.array([sum(c * c for c in count.values()) or 1 for count in counts], float)
            for block in _read_blocks(at):
                for ids, vocab, weights in parts(block):
                    nq = len(ids)
                    best = [np.full(nq, -1.0), np.full(nq, -1, np.int64), np.zeros(nq, np.int64), np.zeros(nq, np.int64)]
                    step = max(1, min(256, CELLS // len(weights)))
                    for lo in range(0, len(rid), step):
                        own, norm = rid[lo : lo + step], norms[lo : lo + step]
                        x = np.zeros((len(own), len(weights)), np.float32)
                        for i, count in enumerate(counts[lo : lo + step]):
                            for w, c in count.items():
                                if (k := vocab.get(w)) is not None:
                                    x[i, k] = c
                        dot = (x @ weights).astype(np.float64)
                        key = dot * dot / norm[:, None]
                        key[(dot <= 0) | (own[:, None] == ids[None, :])] = -1.0
                        order = np.argsort(own, kind="stable")  # of equal keys the first, so the smallest id
                        j = order[key[order].argmax(0)]
                        top, who = key[j, np.arange(nq)], own[j]
                        better = (top > best[0]) | ((top == best[0]) & (top >= 0) & (who < best[1]))
                        for old, new in zip(best, (top, who, dot[j, np.arange(nq)].astype(np.int64), norm[j].astype(np.int64)), strict=True):
                            old[better] = new[better]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, best)], ["a", "key", "b", "dot", "norm2"])

    found = right.select("id", "tokens").mapInArrow(run, "a long, key double, b long, dot long, norm2 long").where("b >= 0 AND key > 0")
    return found.groupBy("a").agg(F.min_by(F.struct("b", "dot", "norm2"), F.struct(-F.col("key"), F.col("b"))).alias("m")).select("a", "m.b", "m.dot", "m.norm2")


def dense_nearest(left: DataFrame, right: DataFrame, dim: int) -> DataFrame:
    """left, right: (id, vec). Nearest right vector by cosine; the right side is read once, and a task keeps its best by query and
    chunk, so what is shuffled is queries x chunks, not pairs."""
    import numpy as np
    import pyarrow as pa

    at = _written_blocks(left, ["id", "vec"])

    def unit(column):
        v = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        return v / (np.sqrt((v * v).sum(1, keepdims=True)) + 1e-10)

    def run(batches):
        for chunk in _chunks(batches):
            rid, rv = chunk.column("id").to_numpy(), unit(chunk.column("vec"))
            for block in _read_blocks(at):
                qi, qv = block.column("id").to_numpy(), unit(block.column("vec"))
                best, who = np.full(len(qi), -2.0), np.full(len(qi), -1, np.int64)
                step = max(1, CELLS // len(qi))
                for lo in range(0, len(rid), step):
                    own = rid[lo : lo + step]
                    s = qv @ rv[lo : lo + step].T
                    s[qi[:, None] == own[None, :]] = -2.0
                    j = s.argmax(1)
                    top = s[np.arange(len(qi)), j]
                    better = (top > best) | ((top == best) & (own[j] < who))
                    best[better], who[better] = top[better], own[j][better]
                yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(who), pa.array(best)], ["a", "b", "cosine"])

    found = right.select("id", "vec").mapInArrow(run, "a long, b long, cosine double").where("b >= 0")
    return found.groupBy("a").agg(F.min_by(F.struct("b", "cosine"), F.struct(-F.col("cosine"), F.col("b"))).alias("m")).select("a", "m.b", "m.cosine")
