import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import groupsplit as g
from tallyforge.session import Scratch

REC = "task_id string, seed string, probes array<string>, component string, key string"
TARGETS = [("train", 70), ("validation", 12), ("test", 18)]


def targets(spark):
    return spark.createDataFrame(TARGETS, "split_name string, target_pct int")


def keyed(spark, rows):
    df = spark.createDataFrame([(*r, "c", "k") for r in rows], REC)
    return g.record_keys(df, "task_id", {"seed": F.col("seed")}, {"probe": F.col("probes")}, ("shared_probe_library",))


def components(rows):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    norm = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    for i, seed, probes in rows:
        if i is None:
            continue
        for k in [("s", norm(seed)), *(("p", norm(p)) for p in probes or [])]:
            if k[1] and k[1] != "sharedprobelibrary":
                parent[root(k)] = root(("id", i))
        root(("id", i))
    groups = {}
    for i, *_ in rows:
        if i is not None:
            groups.setdefault(root(("id", i)), set()).add(i)
    return {frozenset(v) for v in groups.values()}


def test_components_equal_union_find_with_chains_and_a_hub(spark):
    rng = random.Random(3)
    rows = [(f"r{i:04d}", rng.choice([None, "", "Shared-Probe Library", f"Seed_{rng.randrange(400)}", f"seed {rng.randrange(400)}"]), rng.choice([None, [], [None, f"P-{rng.randrange(300)}"], [f"p{i}", f"p{i + 1}"]])) for i in range(300)]
    rows += [(f"h{i:04d}", "HUB_1", None) for i in range(150)] + rows[:11] + [(None, "HUB_1", ["p1"])]
    members = g.ComponentTable(spark, Scratch(spark, "ct").at).update(keyed(spark, rows), targets(spark)).collect()
    got = {}
    for m in members:
        got.setdefault(m.component, set()).add(m.id)
    assert {frozenset(v) for v in got.values()} == components(rows)
    assert all(min(v) == k for k, v in got.items()) and not any(m.quarantined for m in members)
    assert len({(m.component, m.split) for m in members}) == len(got) and len(members) == len({m.id for m in members})


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(257)], "u string, v string")
    labels = g.connected(edges, Scratch(spark, "chain")).collect()
    assert {r.root for r in labels} == {"n0000"} and len(labels) == 258


def test_shares(spark):
    rows = [(f"r{i:05d}", f"s{i // 2}", None) for i in range(3000)]
    report = g.split_report(g.ComponentTable(spark, Scratch(spark, "ct").at).update(keyed(spark, rows), targets(spark)), targets(spark)).collect()
    assert all(abs(r.actual_pct - r.target_pct) < 1 for r in report) and len(report) == 3


def test_updates_keep_splits_fill_deficits_and_quarantine(spark):
    table = g.ComponentTable(spark, Scratch(spark, "ct").at)
    first = {m.id: m for m in table.update(keyed(spark, [(f"a{i:03d}", f"s{i}", [f"P-{i}"]) for i in range(60)]), targets(spark)).collect()}
    split = {m.split: m.id for m in first.values()}
    train, test = split["train"], split["test"]
    joins = [("b000", f"S{int(train[1:])}", None), ("b001", None, [f"P_{int(train[1:])}", f"p-{int(test[1:])}"]), ("b002", "fresh", None)]
    second = {m.id: m for m in table.update(keyed(spark, joins), targets(spark)).collect()}
    assert all(second[k].split == m.split for k, m in first.items())
    assert second["b001"].quarantined and second["b001"].split is None and second[train].quarantined and second[test].quarantined
    assert second[train].component == second[test].component == second["b001"].component == second["b000"].component
    assert second["b002"].split in dict(TARGETS) and not second["b002"].quarantined
    again = {m.id: m.split for m in g.ComponentTable(spark, table.path).update(keyed(spark, joins[:1]), targets(spark)).collect()}
    assert again == {k: m.split for k, m in second.items()}  # known records change nothing


def test_batches_write_what_they_bring_and_change(spark):
    table = g.ComponentTable(spark, Scratch(spark, "ct").at)
    table.update(keyed(spark, [(f"a{i:03d}", f"s{i}", [f"P-{i}"]) for i in range(200)]), targets(spark))
    table.update(keyed(spark, [("b000", "s7", ["p9"]), ("b001", "s9", ["p11"])]), targets(spark))
    table.update(keyed(spark, [("c000", "S_7", None), ("c001", None, ["P-11", "P-12"])]), targets(spark))
    rows = lambda v, part, schema: spark.read.schema(schema).parquet(f"{table.path}/v{v}/{part}").collect()
    assert [len(rows(v, "members", g.MEMBER)) for v in range(3)] == [200, 2, 2] and len(rows(1, "keys", g.KEY)) == 0
    assert {(r.node, r.root) for r in rows(1, "labels", g.LABEL)} == {("a009", "a007"), ("a011", "a007")}
    assert {(r.node, r.root) for r in rows(2, "labels", g.LABEL)} == {("a012", "a007")}
    of = {m.id: m.component for m in table.members.collect()}
    assert {k for k, c in of.items() if c == "a007"} == {"a007", "a009", "a011", "a012", "b000", "b001", "c000", "c001"}
    table.update(keyed(spark, [("d000", "s3", ["p7"])]), None)
    of = {m.id: m.component for m in g.ComponentTable(spark, table.path).members.collect()}
    assert {k for k, c in of.items() if c == "a003"} == {"a003", "a007", "a009", "a011", "a012", "b000", "b001", "c000", "c001", "d000"}


def test_more_targets_than_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(g, "MAX_TARGETS", 2)
    with pytest.raises(ValueError, match="split targets"):
        g.ComponentTable(spark, Scratch(spark, "ct").at).update(keyed(spark, [("x", None, None)]), targets(spark))


def test_empty(spark):
    assert g.ComponentTable(spark, Scratch(spark, "ct").at).update(keyed(spark, [(None, None, None)]), targets(spark)).count() == 0
    lone = g.ComponentTable(spark, Scratch(spark, "ct").at).update(keyed(spark, [("x", None, None)]), spark.createDataFrame([], "split_name string, target_pct int")).collect()
    assert [(m.id, m.component, m.split) for m in lone] == [("x", "x", None)]
    assert g.tied_pairs(spark.createDataFrame([], g.COMPONENT)).count() == 0
