"""Rule checks over tasks and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import fields, scoring
from tallyforge.plans.registry import query
from tallyforge.plans.texts import CANDIDATE, STACKS
from tallyforge.session import read

_q = lambda s: "'" + s.replace("'", "''") + "'"
_BODY = "lower(coalesce(candidate_output.body, ''))"
_any = lambda t, ps: "(" + " OR ".join(f"contains({t}, {_q(p)})" for p in ps) + ")"
_hits = lambda t, ps: "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches({t}, {_q(rf'(?i)\b{p}\b')}) THEN {_q(p)} END" for p in ps) + "], lambda x: x IS NOT NULL)"
_TOKENS = f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(input.signal_brief.signal_line, ''), '[A-Za-z0-9$]+'), lambda t: lower(t)), lambda t: (length(t) >= 4 OR regexp_matches(t, '[0-9]')) AND contains({_BODY}, t)))"
_SENIOR = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in scoring.SENIORITY.items())
_HELD = "input.bench_summary.stacks[lower(trim(r.stack))]"
_REASON = f"""CASE WHEN r.stack IS NULL OR r.requested_count IS NULL THEN 'malformed' WHEN {_HELD} IS NULL THEN 'absent' WHEN {_any(f"lower(coalesce({_HELD}.note, ''))", scoring.COMMITMENT)} THEN 'committed'
    WHEN coalesce({_HELD}.available_engineers, 0) < r.requested_count THEN 'count'
    WHEN coalesce(r.seniority, '') != '' AND (CASE lower(r.seniority) {_SENIOR} END) IS NULL THEN 'unknown seniority'
    WHEN coalesce(r.seniority, '') != '' AND coalesce({_HELD}.seniority_mix[CASE lower(r.seniority) {_SENIOR} END], 0) < r.requested_count THEN 'seniority'
    WHEN r.lead_days IS NOT NULL AND coalesce({_HELD}.time_to_deploy_days, 0) > r.lead_days THEN 'lead time' END"""
_BANNED_OK = f"len({_hits(CANDIDATE, scoring.BANNED)}) = 0"
_GROUND_OK = f"len({_TOKENS}) >= 2"
_BOOK_OK = f"NOT ({_any(_BODY, scoring.BOOKING_HINTS)} AND coalesce(input.thread_stage, '') != 'ready_to_schedule')"
_SAID = f"(regexp_matches({_BODY}, concat('\\b', r.requested_count, '\\b')) AND {_any(_BODY, scoring.AFFIRMATIVE)})"
_BENCH_OK = f"(input.bench_summary.stacks IS NULL OR len(coalesce(input.capacity_request, [])) = 0 OR len(list_filter(list_transform(input.capacity_request, lambda r: CASE WHEN ({_REASON}) = 'malformed' OR {_SAID} THEN {_REASON} END), lambda x: x IS NOT NULL)) = 0)"
_FORMAT_OK = rf"(length(coalesce(candidate_output.subject, '')) <= 60 AND len(regexp_extract_all(coalesce(candidate_output.body, ''), '\S+')) <= 120 AND NOT regexp_matches(regexp_replace(coalesce(candidate_output.body, ''), '^\s+', ''), {_q(scoring.FILLER)}) AND NOT regexp_matches(coalesce(candidate_output.body, ''), {_q(scoring.SUPERLATIVE)}))"
_NAMED = {"banned_phrase_check": _BANNED_OK, "signal_grounding_check": _GROUND_OK, "booking_stage_check": _BOOK_OK, "bench_capacity_check": _BENCH_OK, "format_check": _FORMAT_OK}
_FLAGS = ", ".join(f"{v} AS {k}" for k, v in _NAMED.items())


@query(f"SELECT task_id, {_FLAGS} FROM tasks")
def check_results(spark: SparkSession, d: str) -> DataFrame:
    """Every check on every task."""
    i, o = F.col("input"), F.col("candidate_output")
    return read(spark, d, "tasks").select("task_id", *[(F.size(f(i, o)) == 0).alias(k) for k, f in scoring.CHECKS.items()])


SCORES = f"""SELECT task_id, CAST(total - len(failed) AS INTEGER) AS passed, CAST(total AS INTEGER) AS total, CASE WHEN total > 0 THEN round_even((total - len(failed))::DOUBLE / total, 4) ELSE 0.0 END AS score, array_to_string(failed, ',') AS failed FROM (
    SELECT task_id, len(names) AS total, list_filter(names, lambda n: NOT coalesce(CASE n {' '.join(f"WHEN {_q(k)} THEN {k}" for k in _NAMED)} ELSE false END, false)) AS failed FROM (
        SELECT task_id, {_FLAGS}, CASE WHEN candidate_output.subject IS NOT NULL AND candidate_output.body IS NOT NULL THEN coalesce(rubric.deterministic_checks, []) ELSE [] END AS names FROM tasks))"""


@query(SCORES)
def task_scores(spark: SparkSession, d: str) -> DataFrame:
    """The checks that a rubric asks for, dispatched by name."""
    s = scoring.score(F.col("input"), F.col("candidate_output"), F.col("rubric.deterministic_checks"))
    return read(spark, d, "tasks").select("task_id", s.alias("s")).select("task_id", "s.passed", "s.total", "s.score", F.array_join("s.failed", ",").alias("failed"))


PHRASES = ["no pressure", "notes in full", "rate card", "happy to", "partial start"]


@query(f"SELECT doc_id, array_to_string({_hits('text', PHRASES)}, ',') AS phrases FROM documents WHERE len({_hits('text', PHRASES)}) > 0")
def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """The phrase check with a phrase list of this corpus."""
    hits = scoring.banned_hits(F.col("text"), PHRASES)
    return read(spark, d, "documents").where(F.size(hits) > 0).select("doc_id", F.array_join(hits, ",").alias("phrases"))


@query(f"SELECT task_id, array_to_string(list_sort({_TOKENS}), ',') AS tokens FROM tasks WHERE len({_TOKENS}) > 0")
def grounded_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = scoring.grounded_tokens(F.col("input"), F.col("candidate_output"))
    return read(spark, d, "tasks").where(F.size(t) > 0).select("task_id", F.array_join(F.array_sort(t), ",").alias("tokens"))


@query(f"SELECT task_id, CAST(o AS INTEGER) AS place, r.stack AS stack, r.requested_count AS requested, {_REASON} AS reason FROM (SELECT *, unnest(input.capacity_request) AS r, generate_subscripts(input.capacity_request, 1) - 1 AS o FROM tasks WHERE input.bench_summary.stacks IS NOT NULL)")
def capacity_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Each request looked up in its task's map of stacks."""
    t = read(spark, d, "tasks").where("input.bench_summary.stacks IS NOT NULL").select("task_id", "input", F.posexplode("input.capacity_request").alias("place", "r"))
    return t.select("task_id", "place", "r.stack", F.col("r.requested_count").alias("requested"), scoring.capacity_reason(F.col("input.bench_summary.stacks"), F.col("r")).alias("reason"))


_W = r"len(regexp_extract_all(coalesce({0}, ''), '\S+'))"


@query(
    f"""SELECT pair_id, array_to_string(list_filter([CASE WHEN {_W.format('chosen')} > 60 THEN 'long' END, CASE WHEN {_W.format('chosen')} < 8 THEN 'short' END,
    CASE WHEN len({_hits('chosen', ['bench', 'handover', 'scope'])}) > 0 THEN 'jargon' END, CASE WHEN NOT contains(coalesce(chosen, ''), '?') THEN 'no question' END], lambda x: x IS NOT NULL), ',') AS violations FROM preference_pairs_audit"""
)
def draft_violations(spark: SparkSession, d: str) -> DataFrame:
    """Reasons in a fixed order: limits by words, jargon, missing question."""
    n = F.size(F.regexp_extract_all(F.coalesce("chosen", F.lit("")), F.lit(r"\S+"), F.lit(0)))
    jargon = F.size(scoring.banned_hits(F.col("chosen"), ["bench", "handover", "scope"])) > 0
    v = F.array(F.when(n > 60, "long"), F.when(n < 8, "short"), F.when(jargon, "jargon"), F.when(~F.coalesce("chosen", F.lit("")).contains("?"), "no question"))
    return read(spark, d, "preference_pairs_audit").select("pair_id", F.array_join(F.array_compact(v), ",").alias("violations"))


_JUDGE = rf"""SELECT task_id, CASE WHEN len(regexp_extract_all({CANDIDATE}, '\S+')) >= 8 THEN CASE WHEN rubric IS NULL THEN 3 ELSE 5 END ELSE 1 END AS coherence,
    CASE WHEN coalesce(input.signal_brief.signal_line, '') != '' OR len(coalesce(rubric.deterministic_checks, [])) > 0 THEN CASE WHEN len(coalesce(rubric.deterministic_checks, [])) = 0 THEN 3 ELSE 5 END ELSE 1 END AS verifiability,
    CASE WHEN len(coalesce(rubric.deterministic_checks, [])) > 0 THEN CASE WHEN coalesce(rubric.notes, '') = '' THEN 3 ELSE 5 END ELSE 1 END AS rubric_clarity FROM tasks"""


def judged(t: DataFrame) -> DataFrame:
    """Heuristic 1 / 3 / 5 scores of a task."""
    checks = F.size(F.coalesce("rubric.deterministic_checks", F.array())) > 0
    words = F.size(F.regexp_extract_all(fields.candidate_text(F.col("candidate_output")), F.lit(r"\S+"), F.lit(0)))
    return t.select(
        "task_id",
        F.when(words >= 8, F.when(F.col("rubric").isNull(), 3).otherwise(5)).otherwise(1).alias("coherence"),
        F.when((F.coalesce("input.signal_brief.signal_line", F.lit("")) != "") | checks, F.when(checks, 5).otherwise(3)).otherwise(1).alias("verifiability"),
        F.when(checks, F.when(F.coalesce("rubric.notes", F.lit("")) == "", 3).otherwise(5)).otherwise(1).alias("rubric_clarity"),
    )


@query(_JUDGE)
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    return judged(read(spark, d, "tasks"))


_GATE = "list_filter([CASE WHEN coherence < 5 THEN 'coherence<5' END, CASE WHEN verifiability < 3 THEN 'verifiability<3' END, CASE WHEN rubric_clarity < 5 THEN 'rubric_clarity<5' END], lambda x: x IS NOT NULL)"


@query(f"SELECT task_id, CASE WHEN len({_GATE}) > 0 THEN 'reject' ELSE 'accept' END AS decision, array_to_string({_GATE}, ', ') AS reasons FROM ({_JUDGE})")
def threshold_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rejects below any minimum, with all reasons."""
    r = F.array_compact(F.array(*[F.when(F.col(c) < m, f"{c}<{m}") for c, m in (("coherence", 5), ("verifiability", 3), ("rubric_clarity", 5))]))
    return judged(read(spark, d, "tasks")).select("task_id", F.when(F.size(r) > 0, "reject").otherwise("accept").alias("decision"), F.array_join(r, ", ").alias("reasons"))


@query(
    """SELECT task_id, array_to_string(list_filter([CASE WHEN metadata.signal_source IS NULL THEN 'no source' END, CASE WHEN input.signal_brief.signal_confidence_tier IN ('low', 'none') THEN 'weak signal' END,
    CASE WHEN input.signal_brief.ai_maturity_score IS NULL THEN 'maturity unknown' END, CASE WHEN coalesce(trim(input.company_name), '') = '' THEN 'no company' END], lambda x: x IS NOT NULL), ';') AS flags FROM tasks"""
)
def honesty_flags(spark: SparkSession, d: str) -> DataFrame:
    f = F.array(
        F.when(F.col("metadata.signal_source").isNull(), "no source"), F.when(F.col("input.signal_brief.signal_confidence_tier").isin("low", "none"), "weak signal"),
        F.when(F.col("input.signal_brief.ai_maturity_score").isNull(), "maturity unknown"), F.when(F.coalesce(F.trim("input.company_name"), F.lit("")) == "", "no company"),
    )
    return read(spark, d, "tasks").select("task_id", F.array_join(F.array_compact(f), ";").alias("flags"))


# fixed values of this corpus: words that stand for a stack, first match first
ALIASES = [("kubernetes", "infra"), ("devops", "infra"), ("infra", "infra"), ("machine", "ml"), ("ml", "ml"), ("data", "data"), ("frontend", "frontend"), ("mobile", "mobile"), ("python", "python"), ("rust", "rust"), ("go", "go")]
_ALIAS = "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(lower(text), '\b{a}\b') THEN '{b}' END" for a, b in ALIASES) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_ALIAS})), ',') AS stacks FROM documents WHERE len({_ALIAS}) > 0")
def inferred_stacks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labels of an ordered alias list."""
    hit = F.array_compact(F.array(*[F.when(F.lower("text").rlike(rf"\b{a}\b"), b) for a, b in ALIASES]))
    return read(spark, d, "documents").where(F.size(hit) > 0).select("doc_id", F.array_join(F.array_sort(F.array_distinct(hit)), ",").alias("stacks"))


_NEED = f"list_filter([{', '.join(rf"CASE WHEN regexp_matches(lower(input.signal_brief.signal_line), '\b{s}\b') THEN '{s}' END" for s in STACKS)}], lambda x: x IS NOT NULL)"


@query(
    f"""SELECT task_id, array_to_string(list_sort(need), ',') AS needed, array_to_string(list_sort(list_filter(need, lambda s: coalesce(stacks[s].available_engineers, 0) <= 0)), ',') AS gaps,
    array_to_string(list_sort(list_filter(map_keys(stacks), lambda k: coalesce(stacks[k].available_engineers, 0) <= 0)), ',') AS empty_stacks
    FROM (SELECT task_id, {_NEED} AS need, input.bench_summary.stacks AS stacks FROM tasks WHERE input.bench_summary.stacks IS NOT NULL)"""
)
def bench_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Stacks that a line asks for, those without people, and all empty stacks of the map."""
    line, stacks = F.lower("input.signal_brief.signal_line"), F.col("input.bench_summary.stacks")
    need = F.array_compact(F.array(*[F.when(line.rlike(rf"\b{s}\b"), s) for s in STACKS]))
    none = lambda s: F.coalesce(F.try_element_at(stacks, s)["available_engineers"], F.lit(0)) <= 0
    join = lambda a: F.array_join(F.array_sort(a), ",")
    empty = F.map_keys(F.map_filter(stacks, lambda k, v: F.coalesce(v["available_engineers"], F.lit(0)) <= 0))
    return read(spark, d, "tasks").where("input.bench_summary.stacks IS NOT NULL").select("task_id", join(need).alias("needed"), join(F.filter(need, none)).alias("gaps"), join(empty).alias("empty_stacks"))


# fixed values: ordered phrase lists; the first that hits names the reply
REPLY_RULES = [
    ("hard_no", ["not interested", "no thanks", "stop emailing", "unsubscribe", "remove me", "remove us", "please remove", "take me off", "do not contact"]),
    ("soft_defer", ["not right now", "not now", "reach out", "q3", "next quarter", "too busy", "later"]),
    ("objection", ["price", "pricing", "cost", "india", "offshore", "vendor", "already have", "incumbent"]),
    ("curious", ["tell me more", "learn more", "what do you do", "send details", "more info", "details?"]),
]
_REPLY = r"trim(regexp_replace(lower(coalesce(text, '')), '[ \t\r\n]+', ' ', 'g'))"


@query(
    f"""SELECT doc_id, CASE {' '.join(f"WHEN {_any('t', ps)} THEN '{k}'" for k, ps in REPLY_RULES)} WHEN length(t) < 180 AND contains(t, '?') THEN 'curious'
    WHEN length(t) >= 180 OR (contains(t, '?') AND length(t) >= 60) THEN 'engaged' ELSE 'unknown' END AS label FROM (SELECT doc_id, {_REPLY} AS t FROM documents WHERE source = 'prospect_reply')"""
)
def reply_labels(spark: SparkSession, d: str) -> DataFrame:
    """Ordered phrase lists, then length and question rules."""
    t = F.col("t")
    out = F.when(F.lit(False), "")
    for k, ps in REPLY_RULES:
        out = out.when(_spark_any(t, ps), k)
    out = out.when((F.length(t) < 180) & t.contains("?"), "curious").when((F.length(t) >= 180) | (t.contains("?") & (F.length(t) >= 60)), "engaged").otherwise("unknown")
    docs = read(spark, d, "documents").where("source = 'prospect_reply'").select("doc_id", F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\r\n]+", " ")).alias("t"))
    return docs.select("doc_id", out.alias("label"))


def _spark_any(t, ps):
    hit = F.lit(False)
    for p in ps:
        hit = hit | t.contains(p)
    return hit


@query(rf"SELECT thread_key, min(doc_id) AS doc_id, arg_min(lower(regexp_extract(text, '(?i)\b(budget|freeze|release|capacity)\b', 1)), doc_id) AS word FROM documents WHERE regexp_matches(text, '(?i)\b(budget|freeze|release|capacity)\b') GROUP BY thread_key")
def first_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first document of a thread that holds a keyword, in id order."""
    rx = r"(?i)\b(budget|freeze|release|capacity)\b"
    hit = read(spark, d, "documents").where(F.col("text").rlike(rx)).select("thread_key", "doc_id", F.lower(F.regexp_extract("text", rx, 1)).alias("word"))
    return hit.groupBy("thread_key").agg(F.min("doc_id").alias("doc_id"), F.min_by("word", "doc_id").alias("word"))


_ENG = r"(?i)\b(engineer|engineers|developer|architect|sre|devops|backend|frontend|platform)\b"
_AI = r"(?i)\b(ml|ai|llm|data|model)\b"


@query(
    rf"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line FROM documents)
    SELECT doc_id, count_if(regexp_matches(line, {_q(_ENG)})) AS role_lines, count_if(regexp_matches(line, {_q(_AI)})) AS ai_lines,
    count(DISTINCT CASE WHEN regexp_matches(line, {_q(_ENG)}) AND length(line) <= 90 THEN lower(line) END) AS titles,
    CASE WHEN count_if(regexp_matches(line, {_q(_ENG)})) > 0 THEN round_even(count_if(regexp_matches(line, {_q(_AI)}))::DOUBLE / count_if(regexp_matches(line, {_q(_ENG)})), 3) ELSE 0.0 END AS ai_share
    FROM l WHERE line != '' GROUP BY doc_id"""
)
def role_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that name a role, distinct short ones among them, and the share about models or data."""
    line = F.col("line")
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "").alias("line")).where("line != ''")
    g = lines.groupBy("doc_id").agg(F.count_if(line.rlike(_ENG)).alias("role_lines"), F.count_if(line.rlike(_AI)).alias("ai_lines"), F.count_distinct(F.when(line.rlike(_ENG) & (F.length(line) <= 90), F.lower(line))).alias("titles"))
    return g.withColumn("ai_share", F.when(F.col("role_lines") > 0, F.bround(F.col("ai_lines") / F.col("role_lines"), 3)).otherwise(0.0))
