"""Catalog queries against DuckDB on the smallest tables, where those are there."""

import glob
import os

import duckdb
import pytest

from tallyforge import plans

DATA = os.environ.get("TALLYFORGE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    cur = duck.execute(plans.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=str)
    assert key(df.select(*cols).collect()) == key(cur.fetchall())


@pytest.mark.parametrize("name", ["token_jaccard_members", "token_jaccard_pairs", "near_duplicate_survivors"])
def test_of_two_texts_of_one_id_the_smaller_counts_before_lower_case(spark, tmp_path, name):
    texts = [("a", "Zulu one two"), ("a", "alpha three four"), ("b", "zulu one two"), ("c", "zulu ONE two"), ("d", "alpha three four"), ("e", "one two zulu x y")]
    texts += [("f", "Zulu one two three four"), ("f", "a"), ("g", "one two three four five zulu"), ("g", "Zulu one two THREE four"), ("h", "!?"), ("i", None), (None, "zulu one two")]
    c = duckdb.connect()
    rows = ", ".join(f"({repr(i) if i else 'NULL'}, struct_pack(subject := NULL::VARCHAR, body := {repr(t) if t else 'NULL'}), struct_pack(deterministic_checks := ['x']))" for i, t in texts)
    c.execute(f"CREATE TABLE judge_filter_accepted AS SELECT * FROM (VALUES {rows}) AS v(task_id, candidate_output, rubric)")
    c.execute(f"COPY judge_filter_accepted TO '{tmp_path}/judge_filter_accepted.parquet'")
    df = plans.QUERIES[name](spark, str(tmp_path))
    cur = c.execute(plans.SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(cur.fetchall())


def test_entry_runs_without_the_optional_package(spark):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries()) and set(plans.SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
