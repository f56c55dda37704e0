from pyspark.sql import functions as F

from tallyforge.functions import fields, scoring
from tallyforge.functions import text as tx

INPUT = "struct<signal_brief:struct<signal_line:string>,thread_stage:string,prior_thread:array<struct<role:string,content:string>>,capacity_request:array<struct<stack:string,requested_count:int,seniority:string,lead_days:int>>,bench_summary:struct<stacks:map<string,struct<available_engineers:int,time_to_deploy_days:int,note:string,bench_state:string,seniority_mix:map<string,int>>>>>"
SCHEMA = f"id string, input {INPUT}, out struct<subject:string,body:string>, checks array<string>"


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).collect()[0].x


def test_words_and_content_lines(spark):
    assert one(spark, tx.words(F.col("s")), s="Ab-c_d é1, É") == ["ab", "c", "d", "é1", "é"]
    assert one(spark, tx.words(F.col("s")), s=None) == []
    for s in ("Beta alpha. (Ref tbv02-00000012)", "[ref: tbv02-00000012] beta ALPHA", "Ref=tbv02-h00012 alpha, beta beta", "ref#tbv0200000012 beta/alpha"):
        assert one(spark, tx.content_line(F.col("s")), s=s) == "alpha beta"
    assert one(spark, tx.content_line(F.col("s")), s="preref tbv02-1 x") == "1 preref tbv02 x"
    assert one(spark, tx.content_line(F.col("s")), s=None) == ""


def test_fields(spark):
    assert one(spark, fields.token_estimate(F.col("s")), s="abcde") == 2 and one(spark, fields.token_estimate(F.col("s")), s=None) == 0
    assert one(spark, fields.slug(F.col("s")), s=" Über-Cool  Name! ") == "ber-cool-name"
    assert one(spark, fields.normal_subject(F.col("s")), s=" Re: re:  A\n B ") == "re: a b"
    assert one(spark, fields.redacted(F.col("s")), s="a@b.co +1234567") == "[email] [phone]" and one(spark, fields.redacted(F.col("s")), s="call +1234567") == "call +1234567"
    assert one(spark, fields.stripped(F.col("s")), s=" \t x y  ") == "x y"
    for given, want in ((" ", ""), ("a", "a"), ("a b", "a and b"), ("a b c", "a, b, and c")):
        assert one(spark, fields.english_list(F.filter(F.split("s", " "), lambda w: w != "")), s=given) == want
    assert str(one(spark, fields.iso_date(F.col("s")), s="2026-02-28")) == "2026-02-28" and one(spark, fields.iso_date(F.col("s")), s="2026-02-31") is None and one(spark, fields.iso_date(F.col("s")), s="28/2/2026") is None
    assert one(spark, fields.stable_key(F.col("a"), F.col("b")), a="ab", b="c") != one(spark, fields.stable_key(F.col("a"), F.col("b")), a="a", b="bc")


def score(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.id: r.s for r in df.select("id", scoring.score(F.col("input"), F.col("out"), F.col("checks")).alias("s")).collect()}


def test_scores(spark):
    stack = {"go": (2, 9, "limited availability", None, {}), "qa": (5, 30, "", None, {"senior_4_plus_yrs": 1})}
    i = lambda line, stage="reply_active", req=None, st=None: ((line,), stage, [], req, (st,) if st else None)
    all_checks = list(scoring.CHECKS)
    got = score(
        spark,
        [
            ("clean", i("Nova opened 40 roles"), ("Hi", "I saw Nova has 40 roles open."), all_checks),
            ("banned", i("Nova 40"), ("A 10x ninja", "Nova 40 book a slot"), ["banned_phrase_check", "booking_stage_check", "no_such_check"]),
            ("missing", i("x"), ("s", None), all_checks),
            ("nothing", i(None), None, None),
            ("none asked", i("x"), ("s", "b"), None),
            ("stage", i("Nova 40", "ready_to_schedule"), ("s", "schedule a facebook call"), ["booking_stage_check"]),
            ("promise", i("a", req=[("qa", 2, "senior", None)], st=stack), ("s", "We can cover 2 people"), ["bench_capacity_check"]),
            ("partial", i("a", req=[("qa", 2, "senior", None)], st=stack), ("s", "We can cover 1 person, not more"), ["bench_capacity_check"]),
            ("format", i("a"), ("x" * 61, "Greetings, " + "w " * 121 + "unmatched"), ["format_check"]),
        ],
    )
    assert (got["clean"].passed, got["clean"].score) == (5, 1.0)
    assert got["banned"].failed == ["banned_phrase_check", "booking_stage_check", "no_such_check"] and got["banned"].score == 0.0
    assert got["missing"].total == got["nothing"].total == got["none asked"].total == 0
    assert got["stage"].passed == 1 and got["promise"].passed == 0 and got["partial"].passed == 1 and got["format"].passed == 0


def test_capacity_reasons_in_order(spark):
    stack = {"go": (2, 9, "On hold", None, {}), "qa": (5, 30, None, None, {"senior_4_plus_yrs": 1, "junior_0_2_yrs": 4})}
    asked = [("rust", 1, None, None), ("go", 9, None, None), (" QA ", 9, None, None), ("qa", 2, "boss", None), ("qa", 2, "Senior", None), ("qa", 2, "junior", 10), ("qa", 2, "junior", 30), (None, 1, None, None), ("qa", None, None, None)]
    df = spark.createDataFrame([("x", ((None,), None, None, asked, (stack,)), None, None)], SCHEMA)
    got = df.select(F.transform("input.capacity_request", lambda r: scoring.capacity_reason(F.col("input.bench_summary.stacks"), r)).alias("x")).collect()[0].x
    assert got == ["absent", "committed", "count", "unknown seniority", "seniority", "lead time", None, "malformed", "malformed"]
