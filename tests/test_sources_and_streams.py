import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import io
from tallyforge.streaming import streams

T0 = datetime(2026, 1, 1)


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lines(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"a": 1}\n\n   \n{"a": 2}\n')
    assert sorted(r.a for r in io.read_lines(spark, good, "a int").collect()) == [1, 2]
    bad = put(tmp_path / "b.jsonl", '{"a": 1}\nnot json\n{"a": 3}\n')
    assert sorted(r.a for r in io.read_lines(spark, bad, "a int", strict=False).collect()) == [1, 3]
    with pytest.raises(Exception):
        io.read_lines(spark, bad, "a int").collect()


def test_shapes(spark, tmp_path):
    for i, text in enumerate(['[{"a": 1}, {"a": 2}]', '{"a": 1}\n{"a": 2}\n', '{\n "a": 1\n}']):
        got = sorted(r.a for r in io.read_any(spark, put(tmp_path / f"{i}.json", text), "a int").collect())
        assert got == ([1, 2] if i < 2 else [1])
    doc = put(tmp_path / "d.json", '{"x": [{"a": 5}], "y": 1}')
    assert [r.a for r in io.read_embedded(spark, doc, "x", "a:int").collect()] == [5]
    assert [r.a for r in io.read_wrapped(spark, doc, "x", "a:int").collect()] == [5]
    assert [r.a for r in io.read_wrapped(spark, put(tmp_path / "l.json", '[{"a": 6}]'), "x", "a:int").collect()] == [6]
    assert io.read_document(spark, put(tmp_path / "broken.json", "{oops"), "y int").collect()[0].y is None
    assert {r.file_name for r in io.read_folder(spark, str(tmp_path / "*.json"), "a int").collect()} >= {"2.json"}


def test_csv_aliases_and_parts(spark, tmp_path):
    f = put(tmp_path / "c.csv", "﻿Company Name,# laid off\nNova,12\n")
    got = io.read_csv(spark, f, {"company": ["company", "Company Name"], "count": ["count", "# Laid Off"], "share": ["percentage"]}).collect()[0]
    assert (got.company, got["count"], got.share) == ("Nova", "12", None)
    a = put(tmp_path / "p.jsonl", '{"a": 1}\n')
    assert [(r.a, r.part) for r in io.read_parts(spark, {"train": a, "dev": str(tmp_path / "missing.jsonl")}, "a int").collect()] == [(1, "train")]


def test_sections(spark, tmp_path):
    f = put(tmp_path / "guide.md", "before\n# One\ntext 1\nmore\n\n## Two\ntext 2\n#no heading\n")
    got = {r.heading: r.text for r in io.read_sections(spark, f).collect()}
    assert got == {"guide": "before", "One": "text 1\nmore", "Two": "text 2\n#no heading"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    out = str(tmp_path / "out")
    io.write_lines(df, out)
    io.write_lines(df, out, append=True)
    assert io.read_lines(spark, out, "a int, b string").count() == 4
    io.write_report(df.where("a = 1"), str(tmp_path / "rep"))
    with pytest.raises(ValueError, match="one row"):
        io.write_report(df, str(tmp_path / "rep"))
    assert json.loads("".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "rep")).collect()))["a"] == 1
    io.write_by_key(df, str(tmp_path / "keys"), "a")
    assert (tmp_path / "keys" / "a=2").is_dir()
    names = spark.createDataFrame([("002",), ("001",), ("003",)], "name string")
    assert [r.name for r in io.pending(names, names.where("name = '002'")).collect()] == ["001", "003"]
    urls = spark.createDataFrame([("https://jobs.lever.co/x",), ("http://a.b/c",), (None,)], "u string")
    assert [r.x for r in urls.select(io.host_router(F.col("u"), {"lever.co": "lever"}).alias("x")).collect()] == ["lever", "generic", "generic"]


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_dedup_bypasses_empty_keys(spark, tmp_path):
    rows = [(k, T0 + timedelta(seconds=i)) for i, k in enumerate(["a", "a", "", "", None, "b"])]
    out = streams.run_available(streams.deduplicated(stream(spark, tmp_path, rows, "key string, ts timestamp"), "key", "ts", "1 hour"), "t")
    assert sorted(str(r.key) for r in out.collect()) == ["", "", "None", "a", "b"]


def test_routes_and_states(spark, tmp_path):
    rows = [("t1", T0, " stop ", "x"), ("t1", T0 + timedelta(hours=1), "START", "x"), ("t2", T0 + timedelta(hours=2), "Stop", "y"), ("t2", T0, "start", "y"), ("t3", T0, "hello", "blocked"), ("t4", T0, "", "z")]
    s = stream(spark, tmp_path, rows, "thread string, ts timestamp, body string, address string")
    routed = streams.routed(s, "body", spark.createDataFrame([("blocked",)], "address string"))
    out = streams.run_available(streams.thread_states(routed, "thread", "ts", "route"), "s", "update")
    got = {r.thread: (r.opted_out, r.events) for r in out.collect()}
    assert got == {"t1": (False, 2), "t2": (True, 2), "t4": (False, 1)}


def test_costs_and_upsert(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=m), 1.5) for m in (1, 2, 70)] + [(T0 + timedelta(days=2), 9.0)]
    out = streams.run_available(streams.windowed_costs(stream(spark, tmp_path, rows, "ts timestamp, amount double"), "ts", "amount", "1 hour", "10 minutes"), "c")
    assert sorted(r.cost for r in out.collect())[:2] == [1.5, 3.0]
    at = str(tmp_path / "table")
    streams.keep_latest(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, o int, v string"), 0, at, "k", "o")
    streams.keep_latest(spark.createDataFrame([("a", 2, "y"), ("b", 0, "old")], "k string, o int, v string"), 1, at, "k", "o")
    assert {(r.k, r.v) for r in spark.read.parquet(f"{at}/v1").collect()} == {("a", "y"), ("b", "x")}
