"""Sums and smallest values over all near sets of each set, without a row for each near pair; or the near pairs themselves, unshuffled.

The most frequent words are common, the others rare. Sets with the same common words and as many rare ones are a kind: for two sets
that share no rare word nearness depends on their kinds alone. So near = kinds near by their common words, whatever the rare ones, or
near only with the rare words that both have; the second are paired by the rare words of their prefixes (see setsim).

The pairs themselves are made file by file: sets are spread over files in the shared folder, a task compares two files and returns
their near pairs, so a pair is neither written to a work table nor shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import setsim
from tallyforge.operators.gramhash import _flat, parted

#: Common words at most, and the least frequency of one: so many sets, or this share of them.
MOST_COMMON, LEAST_SETS, LEAST_SHARE = 512, 16, 10_000
#: Kinds times kinds that are compared at a time.
CELLS = 500_000
#: Sets of a file of near_pairs, fewer in small tables; sets of one kind that stay together; files that a task compares its own with.
FILE_SETS, SMALL_SETS, TOGETHER, FILES_A_TASK = 50_000, 4_000, 2_000, 4
#: Pairs returned at a time, kinds times kinds and shared rare words that are looked at together.
BATCH, KIND_CELLS, MOST_HITS = 200_000, 48_000_000, 8_000_000
_CELLS = (1 << setsim.SKETCH_BITS) - 1


def _bits(row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Places as bit sets of 64-bit words, one row for each list."""
    out = np.zeros((n, MOST_COMMON // 64), np.uint64)
    np.bitwise_or.at(out, (row, place >> 6), np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)))
    return out


def _prefix(table, p: int, q: int, early: bool):
    """(row, place) of the common words, rarest first, of which a near set shares one by its common words alone. early: no larger set."""
    row, place = _flat(table.column("common"))
    n = table.column("n").to_numpy().astype(np.int64)
    f = np.bincount(row, minlength=len(n))
    pos = np.arange(len(row)) - (np.cumsum(f) - f)[row]
    least = setsim._up(2 * n, p, p + q) if early else setsim._up(n, p, q)
    take = pos < (f - least + 1)[row]
    return row, place.astype(np.int64), take


def _index(t, p: int, q: int) -> dict:
    """A file of kinds by place: the kinds that have it in their short prefix, with their bit sets."""
    t = t.combine_chunks()
    row, place, take = _prefix(pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns], t.column_names), p, q, True)
    bits = _bits(row, place, t.num_rows)
    r, at = row[take], place[take]
    by = np.argsort(at, kind="stable")
    r, ends = r[by], np.searchsorted(at[by], np.arange(MOST_COMMON + 1))
    used = [k for k in range(MOST_COMMON // 64) if bits[:, k].any()]
    gid, n, w, ord_ = (t.column(k).to_numpy() for k in ("gid", "n", "w", "ord"))
    n, post = n.astype(np.int32), {}
    for k in range(MOST_COMMON):
        if len(x := r[ends[k] : ends[k + 1]]):
            x = x[np.argsort(n[x], kind="stable")]
            post[k] = x, [bits[x, j].copy() for j in used], n[x]
    return {"gid": gid, "n": n, "w": w, "ord": ord_, "post": post, "used": used}


def _met(kinds: DataFrame, tables, p: int, q: int) -> DataFrame:
    """(gid, w, ord): parts of the sum of w and the smallest ord over the other near kinds of each kind."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        for t in tables() if batches else ():
            x = _index(t, p, q)
            sums, least = np.zeros(len(x["gid"]), np.int64), np.full(len(x["gid"]), np.iinfo(np.int64).max)
            for b in batches:
                row, place, take = _prefix(b, p, q, False)
                bits = _bits(row, place, b.num_rows)
                gid, n, w, ord_ = (b.column(k).to_numpy() for k in ("gid", "n", "w", "ord"))
                mine, mine_least = np.zeros(b.num_rows, np.int64), np.full(b.num_rows, np.iinfo(np.int64).max)
                n, found, size = n.astype(np.int32), [np.zeros(0, np.int64)], len(x["gid"])
                for k in np.unique(place[take]):
                    if k not in x["post"]:
                        continue
                    r, cols, m = x["post"][k]
                    asked = row[take & (place == k)]
                    asked = asked[np.argsort(n[asked], kind="stable")]
                    step = max(1, CELLS // len(r))
                    for i in range(0, len(asked), step):
                        own = asked[i : i + step]
                        lo, hi = np.searchsorted(m, -(-p * n[own[0]] // q)), np.searchsorted(m, n[own[-1]], "right")
                        if lo >= hi:
                            continue
                        shared = np.zeros((len(own), hi - lo), np.int32)
                        for j, col in zip(x["used"], cols, strict=True):
                            shared += np.bitwise_count(bits[own, j][:, None] & col[None, lo:hi])
                        shared *= p + q
                        shared -= p * m[None, lo:hi]
                        u, v = np.nonzero(shared >= p * n[own][:, None])
                        found.append(own[u] * size + r[lo + v])
                y, z = np.divmod(np.unique(np.concatenate(found)), max(1, size))
                less = (x["n"][z] < n[y]) | ((x["n"][z] == n[y]) & (x["gid"][z] < gid[y]))
                y, z = y[less], z[less]
                np.add.at(mine, y, x["w"][z])
                np.minimum.at(mine_least, y, x["ord"][z])
                np.add.at(sums, z, w[y])
                np.minimum.at(least, z, ord_[y])
                at = mine > 0
                yield pa.RecordBatch.from_arrays([pa.array(gid[at]), pa.array(mine[at]), pa.array(mine_least[at])], ["gid", "w", "ord"])
            at = sums > 0
            yield pa.RecordBatch.from_arrays([pa.array(x["gid"][at]), pa.array(sums[at]), pa.array(least[at])], ["gid", "w", "ord"])

    return kinds.mapInArrow(run, "gid bigint, w bigint, ord bigint")


def _rare_entries(sketch, p: int, q: int):
    def run(batches):
        held = sketch.value
        for b in batches:
            row, v = _flat(b.column("rare"))
            row, v = (x[np.lexsort((v, held[v & _CELLS], row))] for x in (row, v))
            n = b.column("n").to_numpy().astype(np.int64)
            r = np.bincount(row, minlength=len(n))
            pos = np.arange(len(row)) - (np.cumsum(r) - r)[row]
            take = pos < (n - setsim._up(n, p, q) + 1)[row]
            early = pos < (n - setsim._up(2 * n, p, p + q) + 1)[row]
            at = row[take]
            cols = [pa.array(v[take]), b.column("cid").take(pa.array(at)), b.column("bits").take(pa.array(at)), pa.array(n[at].astype(np.int32)), pa.array(pos[take].astype(np.int32)), pa.array(early[take])]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in setsim.ENTRY.split(", ")])

    return run


def _sets(lines: DataFrame, scratch, files) -> DataFrame:
    """lines: (id, line), one row for each set of words: (id, n, common, rare, gid), gid the kind."""
    words = lines.select(F.explode(F.split("line", " ")).alias("w")).groupBy(F.xxhash64("w").alias("g")).agg(F.count("*").alias("c"))
    least = max(LEAST_SETS, lines.count() // LEAST_SHARE)
    top = words.where(F.col("c") > least).orderBy(F.col("c").desc(), "g").limit(MOST_COMMON)
    # the rarest have the smallest places, so that prefixes begin with them
    listed = scratch.keep(top.agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("x")).select(F.posexplode("x").alias("place", "x")).select(F.col("x.g").alias("g"), "place"))
    toks = lines.select("id", F.size(F.split("line", " ")).alias("size"), F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("grams"))
    return parted(toks, files(listed)).select("id", F.col("size").alias("n"), "common", "rare").withColumn("gid", F.xxhash64("common", "n"))


class _File:
    """A file of sets, ordered by kind: the sets of kind k are the rows from start[k] to start[k + 1]."""

    def __init__(self, t: pa.Table, p: int, q: int):
        b = t.combine_chunks().to_batches()[0]
        gid = b.column("gid").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
        heads = b.take(pa.array(first))
        self.ids, self.rows, self.size, self.start = b.column("id"), len(gid), len(first), np.append(first, len(gid))
        self.n, self.kind = heads.column("n").to_numpy().astype(np.int32), np.repeat(np.arange(len(first)), np.diff(self.start))
        row, place, take = _prefix(heads, p, q, False)
        self.bits = np.ascontiguousarray(_bits(row, place, self.size).T)
        row, place = row[take], place[take]
        by = np.lexsort((self.n[row], place))
        self.row, self.ends = row[by], np.searchsorted(place[by], np.arange(MOST_COMMON + 1))
        self.rare_row, self.rare = _flat(b.column("rare"))
        by = np.argsort(self.rare, kind="stable")
        self.by_word, self.by_word_row = self.rare[by], self.rare_row[by]

    def shared(self, other: _File, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words of kinds a here and b there, one by one."""
        out = np.zeros(len(a), np.int32)
        for mine, own in zip(self.bits, other.bits, strict=True):
            if mine.any() and own.any():
                out += np.bitwise_count(mine[a] & own[b])
        return out

    def kinds(self, other: _File, lo: int, hi: int, p: int, q: int, same: bool) -> np.ndarray:
        """Kinds from lo to hi here with the kinds there that are near by their common words, as here * other.size + there, in order."""
        cols = [(mine, own) for mine, own in zip(self.bits, other.bits, strict=True) if mine.any() and own.any()]
        least = setsim._up(np.arange(self.n.max() + other.n.max() + 1), p, p + q).astype(np.int32)
        found, held = [np.zeros(0, np.int64)], 0
        for k in range(MOST_COMMON):
            a, b = self.row[self.ends[k] : self.ends[k + 1]], other.row[other.ends[k] : other.ends[k + 1]]
            if lo or hi < self.size:
                a = a[(a >= lo) & (a < hi)]
            if not len(a) or not len(b):
                continue
            m, each = other.n[b], [own[b] for _, own in cols]
            step = max(1, CELLS // len(b))
            for i in range(0, len(a), step):
                own = a[i : i + step]
                n = self.n[own]
                x, y = np.searchsorted(m, -(-p * n[0] // q)), np.searchsorted(m, n[-1] * q // p, "right")
                if x >= y:
                    continue
                shared = np.zeros((len(own), y - x), np.int16)
                for (mine, _), col in zip(cols, each, strict=True):
                    shared += np.bitwise_count(mine[own][:, None] & col[None, x:y])
                u, v = np.nonzero(shared >= least[n[:, None] + m[None, x:y]])
                u, v = own[u], b[x + v]
                if same:
                    u, v = u[u <= v], v[u <= v]
                found.append(u * other.size + v)
                held += len(u)
                if held > MOST_HITS:
                    found = [np.unique(np.concatenate(found))]
                    held = 0
        return np.unique(np.concatenate(found))

    def hits(self, other: _File, lo: int, hi: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row here, row there, rare words of both) of the rows of kinds from lo to hi."""
        at = slice(*np.searchsorted(self.rare_row, self.start[[lo, hi]]))
        row, x, y = self.rare_row[at], np.searchsorted(other.by_word, self.rare[at]), np.searchsorted(other.by_word, self.rare[at], "right")
        many = y - x
        u = np.repeat(row, many)
        v = other.by_word_row[np.arange(len(u)) - np.repeat(np.cumsum(many) - many - x, many)]
        if same:
            u, v = u[u < v], v[u < v]
        key, r = np.unique(u * other.rows + v, return_counts=True)
        return *np.divmod(key, other.rows), r.astype(np.int32)

    def slices(self, other: _File):
        """Ranges of kinds here that are compared at a time."""
        many = np.searchsorted(other.by_word, self.rare, "right") - np.searchsorted(other.by_word, self.rare)
        hits = np.concatenate([[0], np.cumsum(np.bincount(self.rare_row, many, self.rows))])[self.start]
        lo, step = 0, max(1, KIND_CELLS // other.size)
        while lo < self.size:
            hi = min(lo + step, max(lo + 1, int(np.searchsorted(hits, hits[lo] + MOST_HITS, "right")) - 1), self.size)
            yield lo, hi
            lo = hi

    def pairs(self, other: _File, p: int, q: int, same: bool):
        """(row here, row there, shared words, words of both) of the near sets, BATCH pairs at a time. same: this file with itself."""
        sizes = np.diff(other.start).astype(np.int32)
        for lo, hi in self.slices(other):
            key = self.kinds(other, lo, hi, p, q, same)
            a, b = np.divmod(key, other.size)
            c, m, n = self.shared(other, a, b), sizes[b], self.n[a] + other.n[b]
            u0, v0 = self.start[a], other.start[b]
            end = np.cumsum((self.start[a + 1] - u0) * m)
            begin = np.concatenate([[0], end])

            x, y, r = self.hits(other, lo, hi, same)
            ka, kb = self.kind[x], other.kind[y]
            n_hit, c_hit = self.n[ka] + other.n[kb], self.shared(other, ka, kb) + r
            k = np.searchsorted(key, ka * other.size + kb)
            listed = key[np.minimum(k, len(key) - 1)] == ka * other.size + kb if len(key) else np.zeros(len(x), bool)
            more = ~listed & ((p + q) * c_hit >= p * n_hit)
            for i in range(0, np.count_nonzero(more), BATCH):
                yield tuple(z[more][i : i + BATCH] for z in (x, y, c_hit, n_hit))
            k = k[listed]
            place = begin[k] + (x[listed] - u0[k]) * m[k] + y[listed] - v0[k]
            by = np.argsort(place)
            place, r = place[by], r[listed][by]

            for i in range(0, int(begin[-1]), BATCH):
                j = min(i + BATCH, int(begin[-1]))
                k = np.arange(np.searchsorted(end, i, "right"), np.searchsorted(end, j - 1, "right") + 1)
                k = np.repeat(k, np.minimum(end[k], j) - np.maximum(begin[k], i))
                row, col = np.divmod((np.arange(i, j) - begin[k]).astype(np.int32), m[k])
                u, v, s = u0[k] + row, v0[k] + col, c[k]
                at = slice(*np.searchsorted(place, (i, j)))
                s[place[at] - i] += r[at]
                if same:
                    once = u < v
                    yield u[once], v[once], s[once], n[k][once]
                else:
                    yield u, v, s, n[k]


def near_pairs(lines: DataFrame, scratch, p: int, q: int, files) -> DataFrame:
    """lines: (id, line), one row for each set of words, ids unique: (a, b, shared, united) of the near sets, the smaller id first.

    The sets of a kind are in one file, unless they are many. Two files are compared by one task; each of f files with about half of
    the others, so that every two meet once."""
    made = scratch.keep(_sets(lines, scratch, files))
    rows = made.count()
    f = max(-(-rows // FILE_SETS), min(12, -(-rows // SMALL_SETS)), 1)
    large = made.groupBy("gid").count().where(F.col("count") > TOGETHER)
    salt = F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / TOGETHER)), F.lit(0))
    spread = made.join(F.broadcast(large), "gid", "left").select("id", "n", "common", "rare", "gid", salt.alias("salt"))
    held = files(scratch.keep(spread.repartition(f, "gid", "salt").sortWithinPartitions("gid", "id").drop("salt")))
    scratch.drop(made)
    tasks = []
    for i in range(f):
        met = [(i + k) % f for k in range(f // 2 + 1) if 2 * k < f or i < f // 2]
        tasks += [(i, met[k : k + FILES_A_TASK]) for k in range(0, len(met), FILES_A_TASK)]

    def run(batches):
        for b in batches:
            for i, met in (tasks[k] for k in b.column("id").to_pylist()):
                mine = next(iter(held([i])), None)
                if mine is None or not mine.num_rows:
                    continue
                x = _File(mine, p, q)
                for j in met:
                    there = mine if i == j else next(iter(held([j])), None)
                    if there is None or not there.num_rows:
                        continue
                    y = x if i == j else _File(there, p, q)
                    ids = x.ids if i == j else pa.concat_arrays([x.ids, y.ids])
                    place = np.empty(len(ids), np.int32)
                    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                    after = 0 if i == j else x.rows
                    for u, v, shared, both in x.pairs(y, p, q, i == j):
                        v = v + after
                        first = place[u] < place[v]
                        a, b_ = np.where(first, u, v), np.where(first, v, u)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b_)), pa.array(shared), pa.array((both - shared).astype(np.int32))], ["a", "b", "shared", "united"])

    kind = lines.schema["id"].dataType.simpleString()
    return lines.sparkSession.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, f"a {kind}, b {kind}, shared int, united int")


class NearSums:
    """lines: (cid, line), one row for each set of words."""

    def __init__(self, lines: DataFrame, scratch, p: int, q: int, files):
        self.scratch, self.p, self.q, self.files = scratch, p, q, files
        self.sets = scratch.keep(_sets(lines.withColumnRenamed("cid", "id"), scratch, files).withColumnRenamed("id", "cid"))
        self.sketch = lines.sparkSession.sparkContext.broadcast(setsim._sketch(lines))

    def _by_rare_words(self) -> DataFrame:
        """(a, b): sets that are near, but not by their common words."""
        p, q = self.p, self.q
        place = F.aggregate("common", F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(c, F.lit(64)).cast("int"))))
        made = self.sets.where(F.size("rare") > 0).withColumn("bits", place).select("cid", "bits", "n", "rare").mapInArrow(_rare_entries(self.sketch, p, q), setsim.ENTRY)
        both = "(x.n + y.n)"
        least = f"(({p} * {both} + {p + q - 1}) div {p + q})"
        on = f"x.tok = y.tok AND (x.n > y.n OR (x.n = y.n AND x.cid < y.cid)) AND {q} * y.n >= {p} * x.n AND least(x.n - x.pos, y.n - y.pos) >= {least} AND bit_count(x.bits ^ y.bits) <= {both} - 2 * {least}"
        pairs = self.scratch.keep(made.alias("x").join(made.where("early").drop("early").alias("y"), F.expr(on)).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct())
        end = lambda k: self.sets.select(F.col("cid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "common", "rare")])
        c = F.size(F.array_intersect("common_a", "common_b"))
        near = lambda s: (p + q) * s >= p * (F.col("n_a") + F.col("n_b"))
        out = pairs.join(end("a"), "a").join(end("b"), "b").where(near(c + F.size(F.array_intersect("rare_a", "rare_b"))) & ~near(c))
        return self.scratch.keep(out.select("a", "b"))

    def sums(self, values: DataFrame) -> DataFrame:
        """values: (cid, w, top), w at least 1. (cid, w, top): the sum of w and the smallest top over a set and all near ones."""
        p, q = self.p, self.q
        own = self.sets.select("cid", "n", "common", "gid").join(values, "cid")
        made = own.groupBy("gid").agg(F.any_value("n").alias("n"), F.any_value("common").alias("common"), F.sum("w").alias("w"), F.min("top").alias("top"))
        kinds = self.scratch.keep(made.orderBy("top").withColumn("ord", F.monotonically_increasing_id()))
        alike = (p + q) * F.size("common") >= 2 * p * F.col("n")
        asked = kinds.select("gid", "n", "common", "w", "ord").where(F.size("common") > 0)
        blocks = self.scratch.keep(asked.repartition(max(1, -(-kinds.count() // 65_536)), "gid"))
        parts = _met(asked.repartition(24, "gid"), self.files(blocks), p, q).unionByName(kinds.where(alike).select("gid", "w", "ord"))
        of = parts.groupBy("gid").agg(F.sum("w").alias("kw"), F.min("ord").alias("ord")).join(kinds.select("ord", F.col("top").alias("ktop")), "ord").drop("ord")
        ab = self._by_rare_words()
        ways = ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rare = ways.join(values.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("rw"), F.min("top").alias("rtop"))
        out = own.withColumn("self", F.when(alike, 0).otherwise(F.col("w"))).select("cid", "gid", "top", "self").join(of, "gid", "left").join(rare, "cid", "left")
        zero = lambda k: F.coalesce(k, F.lit(0))
        return out.select("cid", (F.col("self") + zero("kw") + zero("rw")).alias("w"), F.least("top", "ktop", "rtop").alias("top"))
