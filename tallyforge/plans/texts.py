"""Projections and filters over task, pair and document records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import fields
from tallyforge.plans.registry import query
from tallyforge.session import read

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
CANDIDATE = r"regexp_replace(concat(coalesce(candidate_output.subject, ''), chr(10), coalesce(candidate_output.body, '')), '^\s+|\s+$', '', 'g')"
INPUT = r"lower(regexp_replace(concat(coalesce(input.signal_brief.signal_line, ''), ' ', array_to_string(list_transform(coalesce(input.prior_thread, []), lambda t: coalesce(t.content, '')), ' ')), '^\s+|\s+$', '', 'g'))"
FAMILY = """CASE WHEN coalesce(metadata.scaled_from_task_id, '') != '' THEN 'seed::' || metadata.scaled_from_task_id
    WHEN len(list_filter(coalesce(metadata.week10_probe_ids, []), lambda p: p IS NOT NULL)) > 0
        THEN 'probe::' || array_to_string(list_sort(list_filter(metadata.week10_probe_ids, lambda p: p IS NOT NULL)), '|')
    ELSE 'fallback::' || coalesce(metadata.failure_category, '') || '::' || coalesce(source_mode, '') END"""
DATE = r"CASE WHEN regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast({0} AS DATE) END"
SIGNAL_DATE = DATE.format("metadata.signal_date")


@query("SELECT source, count(*) AS documents, count(DISTINCT thread_key) AS threads, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters FROM documents GROUP BY source")
def document_sources(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_distinct("thread_key").alias("threads"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))


@query(f"SELECT task_id, md5({CANDIDATE}) AS text_md5, CAST(length({CANDIDATE}) AS INTEGER) AS n FROM tasks")
def candidate_texts(spark: SparkSession, d: str) -> DataFrame:
    t = fields.candidate_text(F.col("candidate_output"))
    return read(spark, d, "tasks").select("task_id", F.md5(t).alias("text_md5"), F.length(t).alias("n"))


@query(f"SELECT task_id, {INPUT} AS text FROM tasks")
def input_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "tasks").select("task_id", fields.input_text(F.col("input")).alias("text"))


@query(f"SELECT task_id, {FAMILY} AS family FROM tasks")
def family_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "tasks").select("task_id", fields.family_key(F.col("metadata"), F.col("source_mode")).alias("family"))


@query(f"SELECT task_id, coalesce(strftime({SIGNAL_DATE} + INTERVAL 7 DAY, '%Y-%m-%d'), metadata.signal_date) AS shifted FROM tasks")
def shifted_dates(spark: SparkSession, d: str) -> DataFrame:
    """ISO dates moved by a week; anything else passes."""
    raw = F.col("metadata.signal_date")
    return read(spark, d, "tasks").select("task_id", F.coalesce(F.date_format(F.date_add(fields.iso_date(raw), 7), "yyyy-MM-dd"), raw).alias("shifted"))


@query(
    """SELECT task_id, concat_ws(chr(10), 'Company: ' || nullif(trim(input.company_name), ''), 'Stage: ' || nullif(input.thread_stage, ''), 'Signal: ' || nullif(input.signal_brief.signal_line, ''),
    CASE WHEN len(coalesce(input.prior_thread, [])) > 0 THEN array_to_string(list_transform(input.prior_thread, lambda t: coalesce(t.role, '') || ': ' || coalesce(t.content, '')), chr(10)) END,
    CASE WHEN len(coalesce(input.capacity_request, [])) > 0 THEN 'Requested: ' || array_to_string(list_transform(input.capacity_request, lambda r: concat(r.requested_count, 'x', r.stack)), ', ') END) AS prompt FROM tasks"""
)
def assembled_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompt lines; a line without content is left out."""
    i = F.col("input")
    lead = lambda label, c: F.concat(F.lit(label), F.nullif(c, F.lit("")))
    turns = F.array_join(F.transform(i["prior_thread"], lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit(": "), F.coalesce(t["content"], F.lit("")))), "\n")
    asked = F.array_join(F.transform(i["capacity_request"], lambda r: F.concat(F.coalesce(r["requested_count"].cast("string"), F.lit("")), F.lit("x"), F.coalesce(r["stack"], F.lit("")))), ", ")
    return read(spark, d, "tasks").select(
        "task_id",
        F.concat_ws(
            "\n", lead("Company: ", F.trim(i["company_name"])), lead("Stage: ", i["thread_stage"]), lead("Signal: ", i["signal_brief"]["signal_line"]),
            F.when(F.size(F.coalesce(i["prior_thread"], F.array())) > 0, turns), F.when(F.size(F.coalesce(i["capacity_request"], F.array())) > 0, F.concat(F.lit("Requested: "), asked)),
        ).alias("prompt"),
    )


@query(
    r"""SELECT task_id, CASE WHEN coalesce(trim(input.signal_brief.signal_line), '') = '' THEN 'empty'
    WHEN regexp_matches(input.signal_brief.signal_line, '^Ref=tbv\d{2}-\d+\s') AND length(input.signal_brief.signal_line) < 60 THEN 'stub' ELSE 'substantive' END AS line_class FROM tasks"""
)
def signal_line_classes(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("input.signal_brief.signal_line")
    kind = F.when(F.coalesce(F.trim(line), F.lit("")) == "", "empty").when(line.rlike(r"^Ref=tbv\d{2}-\d+\s") & (F.length(line) < 60), "stub").otherwise("substantive")
    return read(spark, d, "tasks").select("task_id", kind.alias("line_class"))


@query(
    """WITH t AS (SELECT pair_id, CASE WHEN length(coalesce(prompt, '')) = 0 THEN 0 ELSE CAST(greatest(1, ceil(length(prompt) / 4.0)) AS INTEGER) END AS prompt_tokens,
    CASE WHEN length(coalesce(chosen, '')) = 0 THEN 0 ELSE CAST(greatest(1, ceil(length(chosen) / 4.0)) AS INTEGER) END AS answer_tokens FROM preference_pairs_audit)
    SELECT pair_id, prompt_tokens, answer_tokens, round((prompt_tokens * 0.15 + answer_tokens * 0.6) / 1e6, 10) AS projected_cost FROM t"""
)
def token_costs(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens and their cost at a price per million tokens, both parameters of the projection."""
    t = read(spark, d, "preference_pairs_audit").select("pair_id", fields.token_estimate(F.col("prompt")).alias("prompt_tokens"), fields.token_estimate(F.col("chosen")).alias("answer_tokens"))
    return t.withColumn("projected_cost", F.round((F.col("prompt_tokens") * F.lit(0.15) + F.col("answer_tokens") * F.lit(0.6)) / F.lit(1e6), 10))


_MAIL = f"regexp_extract(lower(text), '{fields.EMAIL}')"


@query(
    f"""WITH m AS (SELECT doc_id, {_MAIL} AS email FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '{fields.EMAIL}')),
    p AS (SELECT doc_id, email, split_part(email, '@', 1) AS l, split_part(email, '@', 2) AS domain FROM m)
    SELECT doc_id, email, domain, CASE WHEN len(string_split(domain, '.')) >= 2 THEN string_split(domain, '.')[-2] ELSE domain END AS root_label,
    array_to_string(list_transform(list_filter(regexp_split_to_array(l, '[^a-z]+'), lambda w: w != ''), lambda w: upper(w[1]) || w[2:]), ' ') AS display_name FROM p"""
)
def mail_domains(spark: SparkSession, d: str) -> DataFrame:
    """The first address of each text: its domain, the label before the last one, and a name made of its local part."""
    docs = read(spark, d, "documents").withColumn("email", F.regexp_extract(F.lower("text"), f"({fields.EMAIL})", 1)).where("email != ''")
    domain = F.split_part("email", F.lit("@"), F.lit(2))
    labels = F.split(domain, r"\.")
    name = F.array_join(F.transform(F.filter(F.split(F.split_part("email", F.lit("@"), F.lit(1)), "[^a-z]+"), lambda w: w != ""), lambda w: F.initcap(w)), " ")
    return docs.select("doc_id", "email", domain.alias("domain"), F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(domain).alias("root_label"), name.alias("display_name"))


@query(
    r"""SELECT task_id, left(regexp_replace(regexp_replace(lower(regexp_replace(candidate_output.subject, '^\s+|\s+$', '', 'g')), '^(re|fwd)\s*:\s*', ''), '\s+', ' ', 'g'), 255) AS subject,
    left(sha256(concat(coalesce(task_id, ''), chr(0), coalesce(input.company_name, ''), chr(0))), 24) AS thread_key,
    concat_ws(':', 'outbound', coalesce(input.thread_stage, ''), task_id) AS idempotency_key,
    regexp_replace(regexp_replace(lower(input.company_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM tasks"""
)
def normal_keys(spark: SparkSession, d: str) -> DataFrame:
    """Subjects, hashed thread keys, idempotency keys and slugs."""
    return read(spark, d, "tasks").select(
        "task_id", fields.normal_subject(F.col("candidate_output.subject")).alias("subject"), fields.stable_key(F.col("task_id"), F.col("input.company_name")).alias("thread_key"),
        F.concat_ws(":", F.lit("outbound"), F.coalesce("input.thread_stage", F.lit("")), "task_id").alias("idempotency_key"), fields.slug(F.col("input.company_name")).alias("slug"),
    )


@query(
    r"""SELECT doc_id, md5(CASE WHEN contains(text, '@') OR starts_with(text, '+') THEN regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\+\d{7,15}', '[phone]', 'g') ELSE text END) AS text_md5,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS INTEGER) AS mails FROM documents"""
)
def redacted_contacts(spark: SparkSession, d: str) -> DataFrame:
    """The plain two-pattern redaction."""
    mails = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)))
    return read(spark, d, "documents").select("doc_id", F.md5(fields.redacted(F.col("text"))).alias("text_md5"), mails.alias("mails"))


_MID = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fields.HEADCOUNT_MIDPOINTS.items())


@query(
    f"""SELECT pair_id, t.midpoint, CASE WHEN t.midpoint > 0 THEN round_even(100.0 * len(p.prompt) / t.midpoint, 1) END AS share FROM preference_pairs_audit p
    LEFT JOIN (SELECT task_id, min(CASE input.signal_brief.headcount_range {_MID} END) AS midpoint FROM tasks GROUP BY task_id) t ON p.task_id = t.task_id"""
)
def headcount_shares(spark: SparkSession, d: str) -> DataFrame:
    """Range names to midpoints by a literal map, and a share of them, null where the base is missing."""
    mids = F.create_map(*[F.lit(x) for kv in fields.HEADCOUNT_MIDPOINTS.items() for x in kv])
    t = read(spark, d, "tasks").groupBy("task_id").agg(F.min(F.try_element_at(mids, F.col("input.signal_brief.headcount_range"))).alias("midpoint"))
    return read(spark, d, "preference_pairs_audit").join(t, "task_id", "left").select("pair_id", "midpoint", F.bround(F.try_divide(100.0 * F.length("prompt"), F.col("midpoint")), 1).alias("share"))


@query(
    r"""SELECT doc_id, regexp_extract(text, '(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::\d{2})?)?', 1) || 'T' || coalesce(nullif(regexp_extract(text, '(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::\d{2})?)?', 2), ''), '00:00') || ':00' AS starts_at
    FROM documents WHERE regexp_matches(text, '\d{4}-\d{2}-\d{2}')"""
)
def start_times(spark: SparkSession, d: str) -> DataFrame:
    """The first ISO time of a text, padded to seconds."""
    rx = r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::\d{2})?)?"
    at = lambda k: F.regexp_extract("text", rx, k)
    return read(spark, d, "documents").where(F.col("text").rlike(r"\d{4}-\d{2}-\d{2}")).select("doc_id", F.concat(at(1), F.lit("T"), F.coalesce(F.nullif(at(2), F.lit("")), F.lit("00:00")), F.lit(":00")).alias("starts_at"))


STACKS = ["python", "go", "rust", "frontend", "data", "infra", "security", "mobile"]
_STACK_LIST = ", ".join(f"CASE WHEN regexp_matches(lower(input.signal_brief.signal_line), '(^|[^a-z0-9]){s}([^a-z0-9]|$)') THEN '{s}' END" for s in STACKS)


@query(
    f"""WITH f AS (SELECT task_id, candidate_output.subject AS s, list_filter([{_STACK_LIST}], lambda x: x IS NOT NULL) AS l FROM tasks)
    SELECT task_id, CASE len(l) WHEN 0 THEN '' WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[-1] END AS focus,
    CASE WHEN length(s) <= 24 THEN s ELSE rtrim(left(s, 23)) || '…' END AS capped FROM f"""
)
def focus_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ordered distinct keyword labels as an English list; subjects cut to a length."""
    line, s = F.lower("input.signal_brief.signal_line"), F.col("candidate_output.subject")
    found = F.array_compact(F.array(*[F.when(line.rlike(f"(^|[^a-z0-9]){w}([^a-z0-9]|$)"), w) for w in STACKS]))
    return read(spark, d, "tasks").select("task_id", fields.english_list(found).alias("focus"), F.when(F.length(s) <= 24, s).otherwise(F.concat(F.rtrim(F.left(s, F.lit(23))), F.lit("…"))).alias("capped"))


@query(
    rf"""WITH t AS (SELECT DISTINCT task_id, regexp_replace(coalesce(candidate_output.body, ''), '\s+', ' ', 'g') AS b FROM tasks),
    r AS (SELECT task_id, unnest([{{'o': 0, 't': b}}, {{'o': 1, 't': regexp_replace(b, '^[^.?!]*[.?!] ', '')}}, {{'o': 2, 't': regexp_extract(b, '^[^.?!]*[.?!]')}}, {{'o': 3, 't': array_to_string((string_split(b, ' '))[1:12], ' ')}}]) AS c FROM t)
    SELECT task_id, CAST(arg_min(c.o, c.o) AS INTEGER) AS rule, arg_min(c.t, c.o) AS text FROM r WHERE len(regexp_extract_all(c.t, '[^ ]+')) BETWEEN 1 AND 20 GROUP BY task_id"""
)
def first_passing_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rewrite rules; the first rewrite that still passes a check wins."""
    t = read(spark, d, "tasks").select("task_id", F.regexp_replace(F.coalesce("candidate_output.body", F.lit("")), r"\s+", " ").alias("b")).distinct()
    b = F.col("b")
    rules = [b, F.regexp_replace(b, "^[^.?!]*[.?!] ", ""), F.regexp_extract(b, "^[^.?!]*[.?!]", 0), F.array_join(F.slice(F.split(b, " "), 1, 12), " ")]
    each = t.select("task_id", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), r.alias("t")) for i, r in enumerate(rules)])).alias("c"))
    ok = F.size(F.regexp_extract_all("c.t", F.lit("[^ ]+"), F.lit(0))).between(1, 20)
    return each.where(ok).groupBy("task_id").agg(F.min("c.o").alias("rule"), F.min_by("c.t", "c.o").alias("text"))


@query(
    f"""SELECT task_id, CAST(len(coalesce(input.prior_thread, [])) AS INTEGER) AS turns FROM tasks WHERE len(coalesce(input.prior_thread, [])) >= 2
    AND (contains({INPUT}, 'cover') OR contains({INPUT}, 'price') OR contains({INPUT}, 'rate'))"""
)
def keyword_threads(spark: SparkSession, d: str) -> DataFrame:
    """Keyword-any over a record's text, and an array-length predicate."""
    text, turns = fields.input_text(F.col("input")), F.size(F.coalesce("input.prior_thread", F.array()))
    return read(spark, d, "tasks").where((turns >= 2) & (text.contains("cover") | text.contains("price") | text.contains("rate"))).select("task_id", turns.alias("turns"))


# fixed values: days for which a signal of a source counts; others count for OTHER_DAYS
WINDOW_DAYS = {"funding": 180, "layoffs": 120, "leadership": 90, "hiring": 60}
OTHER_DAYS = 120
_DAYS = "CASE " + " ".join(f"WHEN contains(lower(coalesce(metadata.signal_source, '')), '{k}') THEN {n}" for k, n in WINDOW_DAYS.items()) + f" ELSE {OTHER_DAYS} END"


@query(
    f"""WITH now AS (SELECT CAST(max(loaded_at) AS DATE) AS today FROM tasks)
    SELECT task_id, {SIGNAL_DATE} AS signal_date, CAST({_DAYS} AS INTEGER) AS days FROM tasks, now WHERE {SIGNAL_DATE} IS NULL OR {SIGNAL_DATE} >= today - CAST({_DAYS} AS INTEGER)"""
)
def recent_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals inside of the window of their source, in days before the newest delivery; undated ones pass."""
    t = read(spark, d, "tasks")
    today = t.agg(F.max("loaded_at").cast("date").alias("today")).first().today
    day, source = fields.iso_date(F.col("metadata.signal_date")), F.lower(F.coalesce("metadata.signal_source", F.lit("")))
    days = F.when(F.lit(False), 0)
    for kind, n in WINDOW_DAYS.items():
        days = days.when(source.contains(kind), n)
    days = days.otherwise(OTHER_DAYS)
    return t.where(day.isNull() | (day >= F.date_sub(F.lit(today), days))).select("task_id", day.alias("signal_date"), days.alias("days"))


@query(r"SELECT doc_id, lower(regexp_extract(text, '(?i)\b(CTO|VP Engineering|head of data|product owner|founder|engineering manager)\b', 1)) AS title FROM documents WHERE regexp_matches(text, '(?i)\b(CTO|VP Engineering|head of data|product owner|founder|engineering manager)\b')")
def title_mentions(spark: SparkSession, d: str) -> DataFrame:
    rx = r"(?i)\b(CTO|VP Engineering|head of data|product owner|founder|engineering manager)\b"
    return read(spark, d, "documents").where(F.col("text").rlike(rx)).select("doc_id", F.lower(F.regexp_extract("text", rx, 1)).alias("title"))


@query("SELECT pair_id, split_part(generator_model, '-', 1) AS family FROM preference_pairs_audit WHERE split_part(generator_model, '-', 1) = split_part('local-b-3b', '-', 1)")
def rotation_violations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose generator is of the judge's model family."""
    family = F.split_part("generator_model", F.lit("-"), F.lit(1))
    return read(spark, d, "preference_pairs_audit").where(family == "local").select("pair_id", family.alias("family"))


@query(
    """SELECT coalesce(split_name, 'none') AS split_name, count(DISTINCT task_id) AS tasks, count(DISTINCT task_id) BETWEEN 200 AND 5000 AS within, count(DISTINCT metadata.failure_category) >= 8 AS covered
    FROM tasks GROUP BY coalesce(split_name, 'none')"""
)
def coverage_guards(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "tasks").groupBy(F.coalesce("split_name", F.lit("none")).alias("split_name")).agg(F.count_distinct("task_id").alias("tasks"), F.count_distinct("metadata.failure_category").alias("c"))
    return g.select("split_name", "tasks", F.col("tasks").between(200, 5000).alias("within"), (F.col("c") >= 8).alias("covered"))
