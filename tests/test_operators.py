import math
import pathlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import sampling, setkinds, similarity, stats, validation
from tallyforge.plans.aggregates import numbered


def test_grams_guard_short_texts(spark):
    df = spark.createDataFrame([(n, [str(i) for i in range(n)]) for n in (0, 7, 8, 9)], "n int, t array<string>")
    assert {r.n: r.k for r in df.select("n", F.size(similarity.grams(F.col("t"), 8)).alias("k")).collect()} == {0: 0, 7: 0, 8: 1, 9: 2}


def test_nearest_overlap_ties_and_untestable(spark):
    s = "id string, tokens array<string>"
    left = spark.createDataFrame([("a", list("abcd")), ("b", list("ab")), ("c", list("wxyz"))], s)
    right = spark.createDataFrame([("z", list("abcd")), ("y", list("abcd")), ("x", list("abc")), ("a", list("abcd"))], s)
    got = {r.id: r for r in similarity.nearest_overlap(left, right, 3).collect()}
    assert (got["a"].max_overlap, got["a"].nearest_id) == (2, "y")
    assert not got["b"].is_testable and got["b"].max_overlap == 0 and got["c"].nearest_id is None


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_overlap_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [[rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(12)]
    left = [(f"i{k:02d}", rng.choice(texts)) for k in range(30)]
    right = [(f"i{k:02d}", rng.choice(texts)) for k in range(15, 50)]
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    s = "id string, tokens array<string>"
    x, y = spark.createDataFrame(left, s), spark.createDataFrame(right, s)
    got = {r.id: (r.max_overlap, r.nearest_id) for r in similarity.nearest_overlap(x, y, 3).collect()}
    want = {}
    for i, t in left:
        best = min(((-len(grams(t) & grams(u)), j) for j, u in right if j != i and grams(t) & grams(u)), default=(0, None))
        want[i] = (-best[0], best[1])
    assert got == want
    assert {r.id: r.overlaps for r in similarity.any_overlap(x, y, 3).collect()} == {k: n > 0 for k, (n, _) in want.items()}


@pytest.mark.parametrize(("seed", "common", "most"), [(1, 0, 100), (2, 60, 100), (3, 0, 3), (4, 10_000, 100)])
def test_nearest_overlap_of_common_and_rare_grams_equals_brute_force(spark, monkeypatch, seed, common, most):
    for k, v in (("COMMON_PAIRS", common), ("MOST_COMMON", most), ("KIND_BLOCK", 7)):
        monkeypatch.setattr(similarity, k, v)
    rng = random.Random(seed)
    texts = [[rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(40)]
    left, right = ([(f"i{k:02d}", rng.choice(texts)) for k in ks] for ks in (range(50), range(20, 90)))
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    s = "id string, tokens array<string>"
    got = {r.id: (r.max_overlap, r.nearest_id) for r in similarity.nearest_overlap(spark.createDataFrame(left, s), spark.createDataFrame(right, s), 3).collect()}
    best = {i: min(((-len(grams(t) & grams(u)), j) for j, u in right if j != i and grams(t) & grams(u)), default=(0, None)) for i, t in left}
    assert got == {i: (-n, b) for i, (n, b) in best.items()}


def written(spark, f):
    """Bytes that f shuffles and leaves in the shared folder."""
    from tallyforge.session import work_dir

    def now():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        at = pathlib.Path(work_dir(spark).removeprefix("file:").replace("//", "/"))
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}, sum(p.stat().st_size for p in at.rglob("*") if p.is_file())

    old, n = now()
    f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    new, m = now()
    return sum(v for k, v in new.items() if k not in old) + m - n


def test_texts_of_one_template_are_not_paired(spark):
    body = "all of these words stand in very many of the texts".split()
    side = lambda n, k: spark.range(n).select(F.concat(F.lit(k), "id").alias("id"), F.concat(F.array(F.concat(F.lit(k), "id")), F.array(*map(F.lit, body))).alias("tokens"))
    got = []
    assert written(spark, lambda: got.extend(similarity.nearest_overlap(side(2000, "l"), side(2000, "r")).collect())) < 4_000_000
    assert len(got) == 2000 and {(r.max_overlap, r.nearest_id) for r in got} == {(4, "r0")}


@pytest.mark.parametrize("seed", [1, 2])
def test_token_classes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    sets = {f"i{k:03d}": {f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randrange(12))} for k in range(120)}
    sets |= {f"x{k}": sets["i005"] or {"q"} for k in range(4)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()] + [(None, ["a"])], "id string, tokens array<string>")
    made = similarity.TokenClasses(df, 4, 5)
    near = lambda x, y: x and y and 5 * len(x & y) >= 4 * len(x | y)
    of = {k: min(j for j, u in sets.items() if u == v) for k, v in sets.items() if v}
    reps = {c: sets[c] for c in of.values()}
    want = {(a, b, len(x & y), len(x | y)) for a, x in reps.items() for b, y in reps.items() if a < b and near(x, y)}
    assert {(r.a, r.b, r.shared, r.united) for r in made.pairs().collect()} == want and want
    rows = {r.id: (r.class_id, r.class_size, r.links) for r in made.rows().collect()}
    assert rows == {k: (c, list(of.values()).count(c), sum(near(reps[c], y) for d, y in reps.items() if d != c)) for k, c in of.items()}
    rank = {k: rng.randrange(1000) * 1000 + i for i, k in enumerate(sets)}
    ranks = spark.createDataFrame(list(rank.items()), "id string, rank long")
    around = {k: [j for j, u in sets.items() if near(sets[k], u)] for k in of}
    assert {r.id: (r.survivor, r.copies) for r in made.survivors(ranks).collect()} == {k: (min(v, key=rank.get), len(v) - 1) for k, v in around.items()}


@pytest.mark.parametrize(("seed", "common", "least"), [(1, 64, 1), (2, 512, 0), (3, 64, 30)])
def test_near_sums_of_common_and_rare_words_equal_brute_force(spark, monkeypatch, seed, common, least):
    monkeypatch.setattr(setkinds, "MOST_COMMON", common)
    monkeypatch.setattr(setkinds, "LEAST_SETS", least)
    rng = random.Random(seed)
    body = [[f"t{k}{i}" for i in range(rng.randrange(3, 9))] for k in range(4)]
    sets = {f"i{k:03d}": {*rng.choice(body), *rng.choice(body), *(f"n{int(rng.paretovariate(0.8)) % 90}" for _ in range(rng.randrange(3)))} for k in range(150)}
    made = similarity.TokenClasses(spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, tokens array<string>"), 4, 5)
    near = {k: [j for j, u in sets.items() if 5 * len(v & u) >= 4 * len(v | u)] for k, v in sets.items()}
    assert {r.id: r.links for r in made.rows().collect()} == {k: len({frozenset(sets[j]) for j in v}) - 1 for k, v in near.items()}
    ranks = spark.createDataFrame([(k, -int(k[1:]) % 70, k) for k in sets], "id string, s int, k string").select("id", F.struct("s", "k").alias("rank"))
    want = {k: (min(v, key=lambda j: (-int(j[1:]) % 70, j)), len(v) - 1) for k, v in near.items()}
    assert {r.id: (r.survivor, r.copies) for r in made.survivors(ranks).collect()} == want


def test_near_sets_of_one_template_are_not_paired(spark):
    df = spark.range(2000).select("id", F.concat(F.array(F.concat(F.lit("name"), "id")), F.array(*(F.lit(f"w{k}") for k in range(20)))).alias("tokens"))
    got = []
    assert written(spark, lambda: got.extend(similarity.TokenClasses(df, 4, 5).rows().collect())) < 4_000_000
    assert len(got) == 2000 and {r.links for r in got} == {1999}


def test_near_pairs_are_not_written_to_work_tables(spark):
    df = spark.range(1500).select("id", F.concat(F.array(F.concat(F.lit("name"), "id")), F.array(*(F.lit(f"w{k}") for k in range(20)))).alias("tokens"))
    got = []
    assert written(spark, lambda: got.append(similarity.TokenClasses(df, 4, 5).pairs().count())) < 2_000_000
    assert got == [1500 * 1499 // 2]


@pytest.mark.parametrize("rows", [17, 40])
def test_near_pairs_of_several_files_equal_brute_force(spark, monkeypatch, rows):
    for name, value in (("FILE_SETS", rows), ("SMALL_SETS", rows), ("TOGETHER", 5), ("FILES_A_TASK", 2), ("LEAST_SETS", 8)):
        monkeypatch.setattr(setkinds, name, value)
    rng = random.Random(rows)
    body = [[f"t{k}{i}" for i in range(rng.randrange(3, 9))] for k in range(3)]
    sets = {f"i{k:03d}": frozenset({*rng.choice(body), *rng.choice(body), *(f"n{int(rng.paretovariate(0.8)) % 60}" for _ in range(rng.randrange(4)))}) for k in range(150)}
    reps = {min(j for j, u in sets.items() if u == v): v for v in {*sets.values()}}
    want = sorted((a, b, len(x & y), len(x | y)) for a, x in reps.items() for b, y in reps.items() if a < b and 5 * len(x & y) >= 4 * len(x | y))
    made = similarity.TokenClasses(spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, tokens array<string>"), 4, 5)
    assert sorted(tuple(r) for r in made.pairs().collect()) == want and len(want) > 100


@pytest.mark.parametrize("same", [True, False])
def test_near_pairs_of_two_files_in_small_steps(monkeypatch, same):
    for name, value in (("BATCH", 7), ("KIND_CELLS", 40), ("MOST_HITS", 20), ("CELLS", 6)):
        monkeypatch.setattr(setkinds, name, value)
    rng = random.Random(5)

    def made(n):
        rows = [(sorted(rng.sample(range(6), rng.randrange(6))), sorted(rng.sample(range(9), rng.randrange(4)))) for _ in range(n)]
        rows = sorted(((c, len(c) + len(r), r) for c, r in rows if c or r))
        gid = {k: i for i, k in enumerate(dict.fromkeys((tuple(c), n) for c, n, _ in rows))}
        cols = {"id": pa.array(range(len(rows))), "n": pa.array([n for _, n, _ in rows], pa.int32()), "common": pa.array([c for c, _, _ in rows], pa.list_(pa.int16()))}
        t = pa.table(cols | {"rare": pa.array([r for *_, r in rows], pa.list_(pa.int64())), "gid": pa.array([gid[tuple(c), n] for c, n, _ in rows])})
        return t, [{*map(str, c), *(f"r{w}" for w in r)} for c, _, r in rows]

    (t, x), (u, y) = made(160), made(120)
    left = setkinds._File(t, 4, 5)
    right, y = (left, x) if same else (setkinds._File(u, 4, 5), y)
    got = [tuple(map(int, row)) for part in left.pairs(right, 4, 5, same) for row in zip(*part, strict=True)]
    want = [(i, j, len(a & b), len(a) + len(b)) for i, a in enumerate(x) for j, b in enumerate(y) if (i < j or not same) and 5 * len(a & b) >= 4 * len(a | b)]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_one_text_on_a_tenth_of_the_rows_gives_linear_output(spark):
    text = F.when(F.col("id") % 10 == 0, F.lit("all of these words are on very many rows")).otherwise(F.concat(F.lit("w"), F.col("id") % 3000, F.lit(" x"), F.col("id") % 7, F.lit(" y z")))
    df = spark.range(100_000).select("id", F.split(text, " ").alias("tokens"))
    made = similarity.TokenClasses(df, 4, 5)
    assert made.rows().count() == 100_000 and made.kinds.agg(F.max("class_size")).first()[0] == 10_000
    assert made.pairs().count() < 100_000 and made.survivors(df.select("id", F.col("id").alias("rank"))).count() == 100_000


def test_dense_nearest_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(100, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got = {r.a: r.b for r in similarity.dense_nearest(df.where("id % 20 = 0"), df, 6).collect()}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / ((sum(a * a for a in x) ** 0.5) * (sum(b * b for b in y) ** 0.5) + 1e-10)
    by = dict(rows)
    for a, b in got.items():
        if a != 100:
            best = max(cos(by[a], v) for k, v in rows if k != a)
            assert abs(cos(by[a], by[b]) - best) < 1e-5


@pytest.mark.parametrize("block", [4096, 5])
def test_lexical_nearest_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", block)
    rng = random.Random(3)
    rows = [(i, [f"w{rng.randrange(15)}" for _ in range(rng.randrange(9))]) for i in range(60)] + [(70, None), (71, ["only"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r.a: (r.b, r.dot, r.norm2) for r in similarity.lexical_nearest(df.where("id % 3 = 0 OR id > 60"), df).collect()}
    count = lambda t: {w: (t or []).count(w) for w in set(t or [])}
    want = {}
    for a, t in rows:
        if a % 3 == 0 or a > 60:
            x = count(t)
            scored = [(-(d * d / n), b, d, n) for b, u in rows if b != a for y in [count(u)] for d in [sum(x.get(w, 0) * c for w, c in y.items())] for n in [sum(c * c for c in y.values())] if d]
            if scored:
                want[a] = min(scored)[1:]
    assert got == want


def test_exact_test(spark):
    rows = spark.createDataFrame([(36, 36), (24, 22), (0, 0), (2, 0)], "n int, w int").select("n", stats.mcnemar_p(F.col("n"), F.col("w")).alias("p")).collect()
    p = {r.n: r.p for r in rows}
    assert abs(p[36] - 2**-36) < 1e-18 and abs(p[24] - 1.7941e-05) < 1e-9 and p[0] == 1.0 and p[2] == 1.0


def test_exact_test_of_many_pairs(spark):
    cases = [(1074, 560), (1075, 0), (1200, 620), (1200, 1200), (5000, 2450), (5000, 2500), (20000, 10100), (1100, 550), (3050, 1600), (3050, 3050), (7, 3)]
    rows = spark.createDataFrame(cases, "n int, w int").select("n", "w", stats.mcnemar_p(F.col("n"), F.col("w")).alias("p")).collect()
    for r in rows:
        want = sum(math.comb(r.n, k) for k in range(r.w, r.n + 1)) if r.n < 9999 else None
        want = want / 2**r.n if want is not None else 0.5 * math.erfc((r.w - 0.5 - r.n / 2) / (r.n / 4) ** 0.5 / 2**0.5)
        assert abs(r.p - want) < (1e-9 * max(want, 1e-3) if r.n < 9999 else 1e-4), r


def test_bootstrap_holds_the_mean(spark):
    df = spark.range(60).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("diff"))
    r = stats.bootstrap_ci(df, 100, 7).collect()[0]
    assert r.low < 1 / 3 < r.high and (r.low, r.high) == tuple(stats.bootstrap_ci(df, 100, 7).collect()[0])


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in random.Random(1).sample(range(300), 300)], "key string")
    got = {r.key: r.k for r in numbered(df, "key").collect()}
    assert got == {f"k{i:03d}": i for i in range(300)}
    assert numbered(df.limit(0), "key").count() == 0


def test_families_stay_whole_and_sums_hold(spark):
    rng = random.Random(6)
    rows = [(f"f{i}", rng.choice("abc"), rng.choice([1, 1, 2, 5])) for i in range(150)]
    got = sampling.family_split(spark.createDataFrame(rows, "family string, category string, size long")).collect()
    assert len(got) == 150 and {r.part for r in got} == {"train", "dev", "held_out"}
    total, by = sum(r.size for r in got), {}
    for r in got:
        by[r.part] = by.get(r.part, 0) + r.size
    assert abs(by["train"] / total - 0.5) < 0.05 and abs(by["dev"] / total - 0.3) < 0.05


def test_rotation_and_choice(spark):
    df = spark.createDataFrame([(0, "local"), (1, "local"), (2, "none")], "s int, f string")
    pick = sampling.rotated_pick(F.col("s"), F.array(*map(F.lit, ["local-a", "local-b", "far-c"])), F.col("f"))
    assert [r.x for r in df.orderBy("s").select(pick.alias("x")).collect()] == ["far-c", "far-c", "far-c"]
    only = sampling.rotated_pick(F.lit(1), F.array(F.lit("local-a"), F.lit("local-b")), F.lit("local"))
    assert df.limit(1).select(only.alias("x")).collect()[0].x == "local-b"
    shares = spark.range(4000).select(sampling.stratified_choice(F.col("id").cast("string"), "s", [("a", 0.3), ("b", 0.7)]).alias("x")).groupBy("x").count().collect()
    assert all(abs(r["count"] / 4000 - {"a": 0.3, "b": 0.7}[r.x]) < 0.03 for r in shares)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_ranks_with_ties_equal_sorted_order(spark, groups):
    rng = random.Random(9)
    rows = [("a" if i % 3 else "b", rng.randrange(12) * 1.0, i) for i in range(240)]
    got = stats.ranked(spark.createDataFrame(rows, "g string, v double, id int"), groups, "v", "id").collect()
    by = {}
    for g, v, i in rows:
        by.setdefault(g if groups else "", []).append((v, i))
    for r in got:
        own = sorted(by[r.g if groups else ""])
        place = own.index((r.v, r.id))
        assert (r.k, r["rank"], r.upto, r.n) == (place, [v for v, _ in own].index(r.v), sum(v <= r.v for v, _ in own), len(own))
    assert len(got) == 240 and stats.ranked(spark.createDataFrame([], "g string, v double, id int"), groups, "v", "id").count() == 0


def test_families_fill_each_category(spark):
    got = sampling.family_split(spark.range(9000).selectExpr("concat('f', id) family", "if(id % 3 = 0, 'c', 'd') category", "1L size")).collect()
    assert len({r.family for r in got}) == 9000
    for c, n in (("c", 3000), ("d", 6000)):
        assert [sum(r.part == p for r in got if r.category == c) for p in ("train", "dev", "held_out")] == [n // 2, n * 3 // 10, n // 5]


def test_schema_problems_have_paths_with_indices(spark):
    schema = {
        "required": ["a"],
        "properties": {"a": {"enum": ["x", "y"]}, "n": {"minimum": 1, "maximum": 3}, "s": {"minLength": 2, "pattern": "^q"}, "l": {"minItems": 2, "items": {"required": ["k"], "properties": {"k": {"maximum": 5}}}}},
    }
    rows = [("x", 2, "qq", [(1,), (2,)]), (None, 4, "z", [(9,)]), ("w", 0, None, [(None,), (6,)]), ("y", None, "qqq", None)]
    df = spark.createDataFrame(rows, "a string, n int, s string, l array<struct<k:int>>")
    got = [sorted((p.path, p.message) for p in r.p) for r in df.select(validation.problems(schema, F.struct(*df.columns)).alias("p")).collect()]
    assert got[0] == [] and got[3] == []
    assert got[1] == [("a", "is required"), ("l", "has fewer than 2 items"), ("l[0].k", "9 is greater than 5"), ("n", "4 is greater than 3"), ("s", "is shorter than 2"), ("s", "z does not match ^q")]
    assert got[2] == [("a", "w is not one of x, y"), ("l[0].k", "is required"), ("l[1].k", "6 is greater than 5"), ("n", "0 is less than 1")]


def test_names_inside_texts_both_ways(spark):
    texts = spark.createDataFrame([(1, "the Marlow Group"), (2, "ost"), (3, ""), (4, None), (5, "nothing here"), (6, "ostrava and marlow")], "id long, text string")
    names = spark.createDataFrame([(9, "Marlow"), (4, "Ostrava"), (2, ""), (1, None), (7, "ostrava")], "name_id long, name string")
    assert {r.id: r.name_id for r in validation.first_contained(texts, names).collect()} == {1: 9, 2: 4, 6: 4}
    assert validation.first_contained(texts, names.limit(0)).count() == 0
