"""Sampling, splitting, validation and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import fields, scoring
from tallyforge.operators import sampling, validation
from tallyforge.plans.aggregates import CATEGORY, SUCCESS, category, successes
from tallyforge.plans.registry import query
from tallyforge.plans.texts import FAMILY, SIGNAL_DATE
from tallyforge.session import read

_U = "CAST(concat('0x', substr(md5(concat('{1}|', {0})), 1, 8)) AS BIGINT) / 4294967296.0"
SLOTS = {"size": ["startup", "mid", "enterprise"], "segment": [1, 2, 3], "headcount": ["15_to_80", "80_to_200", "200_to_500", "500_to_2000"], "stack": ["python", "go", "data", "infra"], "state": ["green", "yellow", "red"], "maturity": [0, 1, 2, 3, 4]}


@query("SELECT * FROM " + ", ".join(f"(SELECT unnest([{', '.join(repr(str(x)) for x in v)}]) AS {k})" for k, v in SLOTS.items()))
def slot_combinations(spark: SparkSession, d: str) -> DataFrame:
    """The product of six literal lists: 2,160 rows whatever the data."""
    return sampling.slot_product(spark, SLOTS)


@query(f"SELECT task_id, CASE WHEN {_U.format('task_id', 'mode')} < 0.3 THEN 'trace' WHEN {_U.format('task_id', 'mode')} < 0.6 THEN 'programmatic' WHEN {_U.format('task_id', 'mode')} < 0.85 THEN 'synthesis' ELSE 'hand' END AS mode FROM (SELECT DISTINCT task_id FROM tasks)")
def stratified_modes(spark: SparkSession, d: str) -> DataFrame:
    mix = [("trace", 0.30), ("programmatic", 0.30), ("synthesis", 0.25), ("hand", 0.15)]
    return read(spark, d, "tasks").select("task_id").distinct().select("task_id", sampling.stratified_choice(F.col("task_id"), "mode", mix).alias("mode"))


@query(
    f"""SELECT DISTINCT concat('clone-', task_id) AS task_id, task_id AS scaled_from, coalesce(strftime({SIGNAL_DATE} + INTERVAL 14 DAY, '%Y-%m-%d'), metadata.signal_date) AS signal_date, 'Ref=clone-' || task_id || ' pending signal' AS signal_line, 0 AS turns
    FROM judge_filter_accepted WHERE {_U.format('task_id', 'clone')} < 0.25"""
)
def cloned_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Copies with changed nested fields."""
    raw = F.col("metadata.signal_date")
    moved = F.coalesce(F.date_format(F.date_add(fields.iso_date(raw), 14), "yyyy-MM-dd"), raw)
    t = read(spark, d, "judge_filter_accepted").where(sampling.hashed_share(F.col("task_id"), "clone") < 0.25)
    t = t.withColumn("metadata", F.col("metadata").withField("scaled_from_task_id", F.col("task_id")).withField("signal_date", moved))
    brief = F.col("input.signal_brief").withField("signal_line", F.concat(F.lit("Ref=clone-"), "task_id", F.lit(" pending signal")))
    t = t.withColumn("input", F.col("input").withField("signal_brief", brief).withField("prior_thread", F.slice("input.prior_thread", 1, 0)))
    return t.select(F.concat(F.lit("clone-"), "task_id").alias("task_id"), F.col("metadata.scaled_from_task_id").alias("scaled_from"), F.col("metadata.signal_date").alias("signal_date"), F.col("input.signal_brief.signal_line").alias("signal_line"), F.coalesce(F.nullif(F.size("input.prior_thread"), F.lit(-1)), F.lit(0)).alias("turns")).distinct()


@query(
    f"""WITH t AS (SELECT task_id, {FAMILY} AS family, {CATEGORY.format('metadata.failure_category')} AS category FROM judge_filter_accepted),
    f AS (SELECT family, count(DISTINCT task_id) AS size, arg_min(category, {{'t': task_id, 'c': category}}) AS category FROM t GROUP BY family),
    r AS (SELECT *, (2 * sum(size) OVER (PARTITION BY category ORDER BY md5(concat('split|', family)), family) - size) / (2.0 * sum(size) OVER (PARTITION BY category)) AS middle FROM f)
    SELECT family, category, size, CASE WHEN middle < 0.5 THEN 'train' WHEN middle < 0.8 THEN 'dev' ELSE 'held_out' END AS part FROM r"""
)
def family_split(spark: SparkSession, d: str) -> DataFrame:
    """Families of accepted tasks over three parts, none broken."""
    t = read(spark, d, "judge_filter_accepted").select("task_id", fields.family_key(F.col("metadata"), F.col("source_mode")).alias("family"), category(F.col("metadata.failure_category")).alias("category"))
    f = t.groupBy("family").agg(F.count_distinct("task_id").alias("size"), F.min_by("category", F.struct("task_id", "category")).alias("category"))
    return sampling.family_split(f.select("family", "category", "size"))


@query(f"SELECT task_id, CASE WHEN {_U.format('task_id', 'ratio')} < 0.9 THEN 'train' ELSE 'eval' END AS part FROM (SELECT DISTINCT task_id FROM judge_filter_accepted)")
def ratio_split(spark: SparkSession, d: str) -> DataFrame:
    """A seeded split by hash: no sort and no counts."""
    u = sampling.hashed_share(F.col("task_id"), "ratio")
    return read(spark, d, "judge_filter_accepted").select("task_id").distinct().select("task_id", F.when(u < 0.9, "train").otherwise("eval").alias("part"))


_ROUTE = f"""SELECT task_id, CASE WHEN source_mode = 'trace_derived' THEN 'rewrite' WHEN source_mode = 'multi_llm_synthesis' THEN CASE WHEN {_U.format('task_id', 'route')} < 0.1 THEN 'calibration' ELSE 'batch' END
    WHEN {CATEGORY.format('metadata.failure_category')} IN ('gap_overclaiming', 'tone_drift', 'dual_control_coordination') OR contains(lower(coalesce(metadata.notes, '')), 'subtle') THEN 'nuanced' ELSE 'paraphrase' END AS route FROM tasks"""


@query(f"SELECT task_id, route, route IN ('rewrite', 'calibration', 'nuanced') AS eval_tier, route != 'rewrite' AS pairwise FROM ({_ROUTE})")
def task_routes(spark: SparkSession, d: str) -> DataFrame:
    """Ordered routing rules with a hashed sample."""
    mode = F.col("source_mode")
    fine = category(F.col("metadata.failure_category")).isin("gap_overclaiming", "tone_drift", "dual_control_coordination") | F.lower(F.coalesce("metadata.notes", F.lit(""))).contains("subtle")
    route = F.when(mode == "trace_derived", "rewrite").when(mode == "multi_llm_synthesis", F.when(sampling.hashed_share(F.col("task_id"), "route") < 0.1, "calibration").otherwise("batch")).when(fine, "nuanced").otherwise("paraphrase")
    r = read(spark, d, "tasks").select("task_id", route.alias("route"))
    return r.withColumns({"eval_tier": F.col("route").isin("rewrite", "calibration", "nuanced"), "pairwise": F.col("route") != "rewrite"})


JUDGES = ["local-a-7b", "hosted-c", "remote-d"]
_TURN = "list_concat((['local-a-7b', 'hosted-c', 'remote-d'])[pair_id % 3 + 1:3], (['local-a-7b', 'hosted-c', 'remote-d'])[1:pair_id % 3])"


@query(f"SELECT DISTINCT pair_id, generator_model, coalesce(list_filter({_TURN}, lambda m: split_part(m, '-', 1) != split_part(generator_model, '-', 1))[1], ({_TURN})[1]) AS judge FROM preference_pairs_audit")
def rotated_judges(spark: SparkSession, d: str) -> DataFrame:
    """Judges in rotation, of another family than the generator."""
    start = F.pmod("pair_id", F.lit(len(JUDGES))).cast("int")
    judge = sampling.rotated_pick(start, F.array(*map(F.lit, JUDGES)), F.split_part("generator_model", F.lit("-"), F.lit(1)))
    return read(spark, d, "preference_pairs_audit").select("pair_id", "generator_model", judge.alias("judge")).distinct()


@query(
    """SELECT pair_id, CASE WHEN len(coalesce(chosen_checks_failed, [])) > 0 THEN 'skipped_chosen_fails' WHEN len(coalesce(rejected_checks_failed, [])) = 0 THEN 'skipped_rejected_passes' ELSE 'accepted' END AS derived,
    lower(trim(status)) AS given FROM preference_pairs_audit"""
)
def pair_status_machine(spark: SparkSession, d: str) -> DataFrame:
    """A pair's status from the failed checks of both answers."""
    failed = lambda c: F.size(F.coalesce(c, F.array())) > 0
    s = F.when(failed("chosen_checks_failed"), "skipped_chosen_fails").when(~failed("rejected_checks_failed"), "skipped_rejected_passes").otherwise("accepted")
    return read(spark, d, "preference_pairs_audit").select("pair_id", s.alias("derived"), F.lower(F.trim("status")).alias("given"))


# fixed values: the schema of a task record
STATES = ["green", "yellow", "red"]
TASK_SCHEMA = {
    "required": ["task_id", "task_type", "difficulty", "source_mode", "metadata", "input", "candidate_output", "ground_truth_output", "rubric"],
    "properties": {
        "task_type": {"enum": ["cold_outbound_email", "warm_reply_email", "re_engagement_email"]},
        "difficulty": {"enum": ["easy", "medium", "hard"]},
        "source_mode": {"enum": ["trace_derived", "programmatic", "multi_llm_synthesis", "hand_authored"]},
        "input": {
            "required": ["company_name", "icp_segment", "signal_brief", "bench_summary"],
            "properties": {
                "company_name": {"minLength": 1},
                "icp_segment": {"minimum": 0, "maximum": 4},
                "thread_stage": {"enum": ["cold_first_touch", "reply_active", "ready_to_schedule", "re_engagement"]},
                "signal_brief": {"required": ["signal_line"], "properties": {"signal_confidence_tier": {"enum": ["high", "medium", "low", "none"]}, "ai_maturity_score": {"minimum": 0, "maximum": 3}}},
                "prior_thread": {"items": {"required": ["role", "content"], "properties": {"role": {"enum": ["prospect", "agent"]}}}},
                "capacity_request": {"items": {"required": ["stack", "requested_count"], "properties": {"requested_count": {"minimum": 1}, "lead_days": {"minimum": 1}, "seniority": {"enum": ["junior", "mid", "senior", "mixed"]}}}},
            },
        },
        "candidate_output": {"required": ["subject", "body"]},
        "rubric": {"required": ["deterministic_checks"], "properties": {"deterministic_checks": {"minItems": 1}}},
    },
}


def _sql_problems(schema: dict, value: str, path: str) -> list[str]:
    """SELECTs of (task_id, path, message), one for each rule; value and path are SQL over tasks t and the items of arrays."""
    rows, dot = [], f"{path} || CASE WHEN {path} = '' THEN '' ELSE '.' END || "
    add = lambda where, p, message: rows.append(f"SELECT t.task_id, {p} AS path, {message} AS message FROM tasks t {{join}} WHERE {where}")
    if "enum" in schema:
        said = ", ".join(schema["enum"])
        add(f"{value} NOT IN ({', '.join(repr(e) for e in schema['enum'])})", path, f"{value} || ' is not one of {said}'")
    for name, sign, word in (("minimum", "<", "less"), ("maximum", ">", "greater")):
        if name in schema:
            add(f"{value} {sign} {schema[name]}", path, f"CAST({value} AS VARCHAR) || ' is {word} than {schema[name]}'")
    if "minLength" in schema:
        add(f"length(trim({value})) < {schema['minLength']}", path, f"'is shorter than {schema['minLength']}'")
    if "minItems" in schema:
        add(f"len({value}) < {schema['minItems']}", path, f"'has fewer than {schema['minItems']} items'")
    for name in schema.get("required", ()):
        field = f"{value}.{name}"
        add(f"CASE WHEN {value} IS NOT NULL THEN {field} IS NULL ELSE false END" if value != "t" else f"{field} IS NULL", dot + repr(name), "'is required'")
    for name, inner in schema.get("properties", {}).items():
        rows += _sql_problems(inner, f"{value}.{name}", dot + repr(name))
    if "items" in schema:
        inner = _sql_problems(schema["items"], "u.x", f"{path} || '[' || CAST(u.i AS VARCHAR) || ']'")
        rows += [r.replace("{join}", f", LATERAL (SELECT unnest({value}) AS x, unnest(range(len({value}))) AS i) u") for r in inner]
    return rows


@query(" UNION ALL ".join(r.replace("{join}", "") for r in _sql_problems(TASK_SCHEMA, "t", "''")))
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """Each breach of the task schema, with its path, indices included, and a message; the check is one projection."""
    t = read(spark, d, "tasks")
    return t.select("task_id", F.explode(validation.problems(TASK_SCHEMA, F.struct(*t.columns))).alias("p")).select("task_id", "p.path", "p.message")


@query(
    r"""SELECT doc_id, regexp_full_match(thread_key, 'thr-\d{2}-\d{6}') AS key_ok, length(coalesce(text, '')) BETWEEN 1 AND 20000 AS length_ok, regexp_matches(coalesce(text, ''), '(^|[^0-9])\+[1-9][0-9]{6,14}([^0-9]|$)') AS has_e164 FROM documents"""
)
def event_validation(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", F.col("thread_key").rlike(r"^thr-\d{2}-\d{6}$").alias("key_ok"), F.length(t).between(1, 20000).alias("length_ok"), t.rlike(r"(^|[^0-9])\+[1-9][0-9]{6,14}([^0-9]|$)").alias("has_e164"))


_BRACED = r"regexp_extract(model_output, '(?s)\{.*\}')"


@query(
    rf"""WITH t AS (SELECT trace_id, {_BRACED} AS j, model_output AS o FROM held_out_traces_raw)
    SELECT trace_id, CASE WHEN coalesce(CASE WHEN json_valid(j) THEN json_extract_string(j, '$.verdict') END, nullif(regexp_extract(o, '(?i)verdict(?: is|:)\s*(PASS|FAIL)', 1), ''), nullif(regexp_extract(o, '^(PASS|FAIL)', 1), '')) = 'PASS' THEN 'accept' ELSE 'reject' END AS decision,
    json_valid(j) AND j != '' AS parsed FROM t"""
)
def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """JSON between the outer braces, else a pattern; anything malformed is rejected."""
    o = F.col("model_output")
    j = F.from_json(F.regexp_extract(o, r"(?s)\{.*\}", 0), "verdict string, reason string")
    by_text = F.coalesce(F.nullif(F.regexp_extract(o, r"(?i)verdict(?: is|:)\s*(PASS|FAIL)", 1), F.lit("")), F.nullif(F.regexp_extract(o, r"^(PASS|FAIL)", 1), F.lit("")))
    braces = F.regexp_extract(o, r"(?s)\{.*\}", 0)
    parsed = F.expr("try_parse_json(regexp_extract(model_output, '(?s)\\\\{.*\\\\}', 0))").isNotNull() & (braces != "")
    return read(spark, d, "held_out_traces_raw").select("trace_id", F.when(F.coalesce(F.when(parsed, j["verdict"]), by_text) == "PASS", "accept").otherwise("reject").alias("decision"), F.when(o.isNotNull(), parsed).alias("parsed"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.k') IS NULL AS malformed FROM events")
def parsed_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").select("event_id", k.alias("k"), k.isNull().alias("malformed"))


@query("SELECT task_id, unnest(map_keys(input.bench_summary.stacks)) AS stack, unnest(map_values(input.bench_summary.stacks)).available_engineers AS available FROM tasks WHERE input.bench_summary.stacks IS NOT NULL")
def flattened_stacks(spark: SparkSession, d: str) -> DataFrame:
    """A map of structs as rows."""
    return read(spark, d, "tasks").select("task_id", F.explode("input.bench_summary.stacks").alias("stack", "v")).select("task_id", "stack", F.col("v.available_engineers").alias("available"))


@query(
    """WITH b AS (SELECT pair_id, arg_min({'s': status, 'm': mode, 'c': chosen_score}, built_at) AS r FROM preference_pairs_audit GROUP BY pair_id),
    u AS (SELECT pair_id, arg_max({'s': status, 'm': mode, 'c': chosen_score}, built_at) AS r FROM preference_pairs_audit WHERE pair_id % 2 = 0 GROUP BY pair_id)
    SELECT coalesce(b.pair_id, u.pair_id) AS pair_id, CASE WHEN u.pair_id IS NOT NULL THEN u.r.s ELSE b.r.s END AS replaced_status, coalesce(b.r.c, u.r.c) AS filled_score FROM b FULL JOIN u USING (pair_id)"""
)
def upserted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Full-row replacement and fill-nulls-only update of a base by a later batch."""
    p = read(spark, d, "preference_pairs_audit")
    row = F.struct(F.col("status").alias("s"), F.col("chosen_score").alias("c"))
    base = p.groupBy("pair_id").agg(F.min_by(row, "built_at").alias("b"))
    late = p.where("pair_id % 2 = 0").groupBy("pair_id").agg(F.max_by(row, "built_at").alias("u"))
    j = base.join(late, "pair_id", "full_outer")
    return j.select("pair_id", F.when(F.col("u").isNotNull(), F.col("u.s")).otherwise(F.col("b.s")).alias("replaced_status"), F.coalesce("b.c", "u.c").alias("filled_score"))


@query(
    """WITH m AS (SELECT task_id, min(thread_key) AS into_key FROM documents WHERE task_id IS NOT NULL AND thread_key IS NOT NULL GROUP BY task_id HAVING count(DISTINCT thread_key) > 1),
    r AS (SELECT d.thread_key, min(m.into_key) AS into_key FROM documents d JOIN m USING (task_id) GROUP BY d.thread_key)
    SELECT doc_id, coalesce(least(r.into_key, documents.thread_key), documents.thread_key) AS thread_key FROM documents LEFT JOIN r ON documents.thread_key = r.thread_key"""
)
def merged_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads of one task merged into the first; children are re-pointed."""
    t = read(spark, d, "documents").select("doc_id", "task_id", "thread_key")
    both = t.where("task_id IS NOT NULL AND thread_key IS NOT NULL").select("task_id", "thread_key").distinct()
    m = both.groupBy("task_id").agg(F.min("thread_key").alias("into_key"), F.count("*").alias("n")).where("n > 1").drop("n")
    r = both.join(m, "task_id").groupBy("thread_key").agg(F.min("into_key").alias("into_key"))
    return t.join(r, "thread_key", "left").select("doc_id", F.coalesce(F.least("into_key", "thread_key"), "thread_key").alias("thread_key"))


@query(f"SELECT family, count(DISTINCT task_id) AS tasks FROM (SELECT task_id, {FAMILY} AS family FROM tasks) GROUP BY family HAVING count(DISTINCT task_id) > 1")
def family_sizes(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tasks").select("task_id", fields.family_key(F.col("metadata"), F.col("source_mode")).alias("family"))
    return t.groupBy("family").agg(F.count_distinct("task_id").alias("tasks")).where("tasks > 1")


@query()
def named_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registry of named checks."""
    return spark.createDataFrame([(k,) for k in sorted(scoring.CHECKS)], "name string")


@query("SELECT pair_id, CASE WHEN chosen_score IS NULL THEN 'unknown' WHEN chosen_score >= 0.75 THEN 'high' WHEN chosen_score >= 0.35 THEN 'medium' ELSE 'low' END AS tier FROM preference_pairs_audit")
def score_tiers(spark: SparkSession, d: str) -> DataFrame:
    tier = sampling.stepped(F.col("chosen_score"), [(0.75, "high"), (0.35, "medium")], "low", "unknown")
    return read(spark, d, "preference_pairs_audit").select("pair_id", tier.alias("tier"))


@query(
    """SELECT pair_id, round((coalesce(chosen_score, 0) * 0.7 + coalesce(rejected_score, 0) * 0.3) / nullif(CASE WHEN chosen_score IS NULL THEN 0 ELSE 0.7 END + CASE WHEN rejected_score IS NULL THEN 0 ELSE 0.3 END, 0), 6) AS confidence FROM preference_pairs_audit"""
)
def weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    """A weighted mean over the parts that are there."""
    mean = sampling.weighted_mean([(F.col("chosen_score"), 0.7), (F.col("rejected_score"), 0.3)])
    return read(spark, d, "preference_pairs_audit").select("pair_id", F.round(mean, 6).alias("confidence"))


# fixed values of this corpus: words that send a text to a section, first match first
SECTIONS = [("pricing", ["rate", "price", "charge"]), ("capacity", ["bench", "seats", "cover"]), ("timing", ["freeze", "week", "days"])]
_SECTION = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in SECTIONS)


@query(f"SELECT doc_id, CASE {_SECTION} ELSE 'general' END AS section FROM documents WHERE text IS NOT NULL")
def keyword_routes(spark: SparkSession, d: str) -> DataFrame:
    text, out = F.lower("text"), F.when(F.lit(False), "")
    for k, ws in SECTIONS:
        hit = F.lit(False)
        for w in ws:
            hit = hit | text.contains(w)
        out = out.when(hit, k)
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", out.otherwise("general").alias("section"))


@query(f"SELECT t.trace_id, t.task_id, t.latency_ms, s.same, s.base, s.trained FROM (SELECT trace_id, min(task_id) AS task_id, min(latency_ms) AS latency_ms FROM held_out_traces_raw GROUP BY trace_id) t LEFT JOIN ({SUCCESS}) s ON t.task_id = s.task_id")
def trace_table(spark: SparkSession, d: str) -> DataFrame:
    """Traces with the success flags of their task."""
    t = read(spark, d, "held_out_traces_raw").groupBy("trace_id").agg(F.min("task_id").alias("task_id"), F.min("latency_ms").alias("latency_ms"))
    return t.join(successes(spark, d), "task_id", "left").select("trace_id", "task_id", "latency_ms", "same", "base", "trained")


@query("SELECT pair_id, CAST(len(regexp_extract_all(coalesce(chosen, ''), '[^ \\t\\n\\r]+')) AS BIGINT) AS words, len(regexp_extract_all(coalesce(chosen, ''), '[^ \\t\\n\\r]+')) >= 8 AS accepted FROM preference_pairs_audit")
def plugged_judge(spark: SparkSession, d: str) -> DataFrame:
    """The hook of a learned judge, with a rule in its place."""

    def judge(pdf):
        n = pdf["chosen"].fillna("").str.count("[^ \\t\\n\\r]+")
        return pdf[["pair_id"]].assign(words=n.astype("int64"), accepted=n >= 8)

    return sampling.plugged(read(spark, d, "preference_pairs_audit").select("pair_id", "chosen"), judge, "pair_id long, words long, accepted boolean")
