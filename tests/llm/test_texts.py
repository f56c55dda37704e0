import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyforge.llm import encode, leakage, mixture

RANKS = encode.load_ranks()


def reference():
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts(n=300):
    rng = random.Random(8)
    chars = "abcdefghij  \n\t.,'<|>0123456789éüßñ漢字🚀́ ​"
    out = ["".join(rng.choice(chars) for _ in range(rng.randrange(80))) for _ in range(n)]
    return [*out, None, "", " ", "<|endoftext|>", "a" * 5000, " " * 3000, "don't we'll THE the ThE", "word " * 400]


def test_ids_equal_the_public_encoder(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = {r.doc_id: r.ids for r in encode.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3), "text", ["doc_id"]).collect()}
    ref = reference()
    assert got == {i: ref.encode_ordinary(t) if t else [] for i, t, _ in rows}
    counts = {r.doc_id: r.tokens for r in encode.token_counts(spark.createDataFrame(rows, "doc_id long, text string, tokens string"), "text", ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_round_trip_and_bounded_memory(monkeypatch):
    monkeypatch.setattr(encode, "KEPT_PIECES", 50)
    coder = encode.TrieEncoder(RANKS)
    for t in texts(100):
        ids, _ = coder.encode_batch([t])
        assert b"".join(coder.bytes[i] for i in ids).decode() == (t or "")
    assert coder.merged(b"hello") == reference().encode_ordinary("hello")


def test_prefixes_are_encoded_once():
    coder = encode.TrieEncoder(RANKS)
    got = coder.encode_pieces(["token", "tokens", "tokenizer", "tok", " tok"])
    assert got == {k: tuple(reference().encode_ordinary(k)) for k in got}


def test_empty_table(spark):
    assert encode.encode(spark.createDataFrame([], "doc_id long, text string"), "text", ["doc_id"]).count() == 0


TEXT = "record_kind string, record_id long, field string, text string"
ITEM = "item_id long, passage string, text string"


def brute(rows, items, least):
    w = lambda s: leakage._WORD.findall((s or "").lower())
    grams = lambda s: {tuple(w(s)[i : i + least]) for i in range(len(w(s)) - least + 1)}
    return {(k, i, f, n) for k, i, f, t in rows for n, p, _ in items if i is not None and n is not None and grams(t) & grams(p)}


@pytest.mark.parametrize("limit", [500_000, -1])
def test_leaks_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(leakage, "BROADCAST_PRINTS", limit)
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40))), "clash") for i in range(30)] + [(90, None, ""), (91, "", ""), (None, "v1 v2 v3 v4 v5 v6 v7 v8", "")]
    items += [(92, items[0][1], "")]  # a passage that two items share
    rows = []
    for i in range(150):
        t = [rng.choice(vocab) for _ in range(rng.randrange(60))]
        p = rng.choice(items[:30])[1].split()
        a = rng.randrange(len(p))
        part = p[a : a + rng.choice([6, 7, 8, 9, 20])]
        at = rng.randrange(len(t) + 1)
        t[at:at] = [x.upper() for x in part]
        rows.append(("document", i, "text", rng.choice([" ", ", ", "*\n> "]).join(t)))
    rows += [("document", None, "text", items[0][1]), ("pair", 1, "prompt", None), ("pair", 1, "chosen", ""), ("pair", 2, "chosen", items[3][1])]
    rows += rows[:5]
    for least, k in ((8, 5), (8, 4), (6, 6)):
        got = leakage.leaks(spark.createDataFrame(rows, TEXT), spark.createDataFrame(items, ITEM), k, least).collect()
        assert {tuple(r) for r in got} == brute(rows, items, least) and len(got) == len(set(got)) > 10


def test_leaks_of_repeated_words_and_empty_sides(spark):
    items = [(1, "na " * 30, ""), (2, "a b c d e f g h", "")]
    rows = [("document", 1, "text", "na " * 9), ("document", 2, "text", "na " * 7), ("document", 3, "text", "A-B c_d e f, g h" * 1)]
    got = {(r.record_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(rows, TEXT), spark.createDataFrame(items, ITEM)).collect()}
    assert got == {(1, 1), (3, 2)}
    assert leakage.leaks(spark.createDataFrame([], TEXT), spark.createDataFrame(items, ITEM)).count() == 0
    assert leakage.leaks(spark.createDataFrame(rows, TEXT), spark.createDataFrame([], ITEM)).count() == 0


DOC = "doc_id long, source string, tokens int, copies string"
TARGET = "mix_id int, source string, target_weight double, max_repeats int"


def mix_docs(spark, n=900):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "tiny"] if i % 9 else ["tiny"]), rng.choice([0, 7, 7, 12, 30, 55]), "x") for i in range(n)]
    return spark.createDataFrame([*rows, (None, "a", 5, ""), (9000, None, 5, ""), (9001, "b", None, "")], DOC)


def test_mix_shares_caps_and_seed(spark):
    t = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.3, 2), (1, "tiny", 0.2, 3), (1, "absent", 0.1, 2), (2, "b", 1.0, 1)], TARGET)
    docs = mix_docs(spark)
    mix = mixture.Mixture(docs, t)
    chosen = mix.chosen()
    rows = chosen.collect()
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows)
    shares = {(r.mix_id, r.source): r for r in mix.shares(chosen).collect()}
    for r in shares.values():
        assert r.most_copies <= r.max_repeats
        assert r.source == "absent" or 0 <= r.budget_tokens - r.actual_tokens < 7
    assert shares[1, "absent"].documents == 0 and abs(shares[1, "a"].actual_share - 0.5 / 1.0) < 0.01
    whole = docs.where("source = 'b' AND tokens > 0 AND doc_id IS NOT NULL").count()
    assert shares[2, "b"].documents == whole
    assert sorted(map(tuple, mixture.Mixture(docs, t).chosen().collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, mixture.Mixture(docs, t, seed=5).chosen().collect())) != sorted(map(tuple, rows))


def test_fit_is_exact_where_a_subset_exists():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 9)))
        counts = rng.integers(0, 6, len(lengths))
        reach = {0}
        for n, k in zip(lengths, counts, strict=True):
            reach = {s + i * int(n) for s in reach for i in range(int(k) + 1)}
        for budget in rng.integers(0, 400, 4):
            take = mixture.fit(lengths, counts, int(budget))
            got = int(take @ lengths)
            assert (take >= 0).all() and (take <= counts).all() and got <= max(budget, 0)
            assert got == max(s for s in reach if s <= budget)


def test_mix_of_nothing(spark):
    t = spark.createDataFrame([(1, "a", 0.5, 1)], TARGET)
    mix = mixture.Mixture(spark.createDataFrame([], DOC), t)
    assert mix.chosen().count() == 0 and [r.actual_tokens for r in mix.shares(mix.chosen()).collect()] == [0]
    assert mixture.Mixture(mix_docs(spark), spark.createDataFrame([], TARGET)).chosen().count() == 0


def test_one_length_for_all_documents(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("tokens"))
    both = docs.unionByName(spark.range(5000, 5050).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit(10).alias("tokens")))
    mix = mixture.Mixture(both, spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.5, 2)], TARGET))
    assert {r.source: r.actual_tokens for r in mix.shares(mix.chosen()).collect()} == {"a": 1000, "b": 1000}
