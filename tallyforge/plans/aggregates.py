"""Aggregations, paired statistics, windows and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scoring
from tallyforge.operators import stats
from tallyforge.plans.checks import _NAMED
from tallyforge.plans.registry import query
from tallyforge.session import read

CATEGORY = "coalesce(nullif(lower(trim(regexp_replace({0}, '[ -]', '_', 'g'), '_ ')), ''), 'unknown')"


def category(c):
    """Spellings of a category as one; null and blank are unknown."""
    return F.coalesce(F.nullif(F.lower(F.trim(F.regexp_replace(c, "[ -]", "_"), F.lit("_ "))), F.lit("")), F.lit("unknown"))


@query(
    """SELECT coalesce(CAST(grouping(split_name) * 4 + grouping(source_mode) * 2 + grouping(difficulty) AS INTEGER), 0) AS level, split_name, source_mode, difficulty, count(*) AS n
    FROM tasks GROUP BY GROUPING SETS ((split_name), (source_mode), (difficulty), ())"""
)
def counts_by_sets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by three keys and in all, in one pass."""
    read(spark, d, "tasks").select("split_name", "source_mode", "difficulty").createOrReplaceTempView("tf_counts")
    return spark.sql("SELECT CAST(grouping(split_name) * 4 + grouping(source_mode) * 2 + grouping(difficulty) AS INT) AS level, split_name, source_mode, difficulty, count(*) AS n FROM tf_counts GROUP BY GROUPING SETS ((split_name), (source_mode), (difficulty), ())")


@query(f"SELECT {CATEGORY.format('metadata.failure_category')} AS category, count(DISTINCT task_id) AS tasks FROM tasks GROUP BY 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "tasks").groupBy(category(F.col("metadata.failure_category")).alias("category")).agg(F.count_distinct("task_id").alias("tasks")).orderBy(F.desc("tasks"), "category")


@query(
    """SELECT mode, count_if(lower(trim(status)) = 'accepted') AS accepted, count_if(lower(trim(status)) = 'skipped_rejected_passes') AS rejected_passes, count_if(lower(trim(status)) = 'skipped_chosen_fails') AS chosen_fails,
    count_if(status IS NULL) AS unknown, round(avg(chosen_score), 6) AS mean_score FROM (SELECT pair_id, min(mode) AS mode, min(status) AS status, min(chosen_score) AS chosen_score FROM preference_pairs_audit GROUP BY pair_id) GROUP BY mode"""
)
def pair_status_counts(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "preference_pairs_audit").groupBy("pair_id").agg(*[F.min(c).alias(c) for c in ("mode", "status", "chosen_score")])
    s = F.lower(F.trim("status"))
    return p.groupBy("mode").agg(
        F.count_if(s == "accepted").alias("accepted"), F.count_if(s == "skipped_rejected_passes").alias("rejected_passes"), F.count_if(s == "skipped_chosen_fails").alias("chosen_fails"),
        F.count_if(F.col("status").isNull()).alias("unknown"), F.round(F.avg("chosen_score"), 6).alias("mean_score"),
    )


_PAIRS = "SELECT pair_id, min(failure_category) AS failure_category, min(chosen) AS chosen, min(rejected) AS rejected, min(chosen_score) AS c, min(rejected_score) AS r FROM preference_pairs_audit GROUP BY pair_id"


def _pairs(spark, d):
    return read(spark, d, "preference_pairs_audit").groupBy("pair_id").agg(
        F.min("failure_category").alias("failure_category"), F.min("chosen").alias("chosen"), F.min("rejected").alias("rejected"), F.min("chosen_score").alias("c"), F.min("rejected_score").alias("r")
    )


@query(
    f"""SELECT {CATEGORY.format('failure_category')} AS category, count(*) AS n, count_if(chosen = rejected) AS same_text, round(avg(CASE WHEN chosen = rejected OR c > r THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
    round(avg(CASE WHEN chosen IS DISTINCT FROM rejected THEN CASE WHEN c > r THEN 1.0 ELSE 0.0 END END), 6) AS accuracy_different, round(avg(c - r), 6) AS mean_margin FROM ({_PAIRS}) WHERE c IS NOT NULL AND r IS NOT NULL GROUP BY 1"""
)
def preference_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of pairs whose chosen answer scores higher, with and without equal texts, and the mean margin."""
    p = _pairs(spark, d).where("c IS NOT NULL AND r IS NOT NULL")
    same, win = F.coalesce(F.col("chosen") == F.col("rejected"), F.lit(False)), F.col("c") > F.col("r")
    different = F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.when(win, 1.0).otherwise(0.0))
    return p.groupBy(category(F.col("failure_category")).alias("category")).agg(
        F.count("*").alias("n"), F.count_if(same).alias("same_text"), F.round(F.avg(F.when(same | win, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.avg(different), 6).alias("accuracy_different"),
        F.round(F.avg(F.col("c") - F.col("r")), 6).alias("mean_margin"),
    )


@query(f"SELECT {CATEGORY.format('failure_category')} AS category, (list_sort(list(latency_ms)))[len(list(latency_ms)) // 2 + 1] AS p50, round(avg(latency_ms), 6) AS mean_ms, count(*) AS n FROM held_out_traces_raw WHERE latency_ms IS NOT NULL GROUP BY 1")
def latency_by_category(spark: SparkSession, d: str) -> DataFrame:
    """The upper median: the value at place n div 2 of its group, by distributed ranks."""
    t = read(spark, d, "held_out_traces_raw").where("latency_ms IS NOT NULL").select(category(F.col("failure_category")).alias("category"), "latency_ms")
    p50 = F.min(F.when(F.col("k") == F.floor(F.col("n") / 2), F.col("latency_ms")))
    return stats.ranked(t, ["category"], "latency_ms", "latency_ms").groupBy("category").agg(p50.alias("p50"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.count("*").alias("n"))


@query("SELECT source, CAST(list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS BIGINT) AS p50 FROM documents WHERE n_chars IS NOT NULL GROUP BY source")
def length_medians(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").where("n_chars IS NOT NULL").select("source", "n_chars")
    return stats.ranked(t, ["source"], "n_chars", "n_chars").where("k = n div 2").select("source", F.col("n_chars").alias("p50"))


@query(
    """SELECT failure_category, count(DISTINCT chosen) AS unique_answers, CAST(max(k) AS BIGINT) AS most_repeats FROM (SELECT failure_category, chosen, count(*) AS k FROM preference_pairs_audit WHERE failure_category IS NOT NULL GROUP BY ALL) GROUP BY failure_category"""
)
def answer_repeats(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "preference_pairs_audit").where("failure_category IS NOT NULL").groupBy("failure_category", "chosen").agg(F.count("*").alias("k"))
    return k.groupBy("failure_category").agg(F.count("chosen").alias("unique_answers"), F.max("k").alias("most_repeats"))


@query("SELECT input.icp_segment AS segment, count_if(s = 0) AS score_0, count_if(s = 1) AS score_1, count_if(s = 2) AS score_2, count_if(s = 3) AS score_3, count_if(s IS NULL) AS missing FROM (SELECT *, input.signal_brief.ai_maturity_score AS s FROM tasks) GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("input.signal_brief.ai_maturity_score")
    return read(spark, d, "tasks").groupBy(F.col("input.icp_segment").alias("segment")).agg(*[F.count_if(s == k).alias(f"score_{k}") for k in range(4)], F.count_if(s.isNull()).alias("missing"))





@query(
    """SELECT s_suppkey, round_even(count(b) ::DOUBLE / any_value(n), 3) AS percentile, CAST(any_value(rk) AS INTEGER) AS rank0 FROM (
    SELECT a.s_suppkey, b.s_suppkey AS b, rk, n FROM (SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) - 1 AS rk, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) a
    JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal <= a.s_acctbal) GROUP BY s_suppkey"""
)
def peer_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Share of peers at or below a score, and the 0-based rank where ties share the best one."""
    r = stats.ranked(read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], "s_acctbal", "s_suppkey")
    return r.select("s_suppkey", F.bround(F.col("upto") / F.col("n"), 3).alias("percentile"), (F.col("n") - F.col("upto")).cast("int").alias("rank0"))


@query(
    """WITH a AS (SELECT p_brand, list_sort(list(p_size)) AS l FROM part GROUP BY p_brand), t AS (SELECT p_brand, l, l[CAST(round_even(0.75 * (len(l) - 1), 0) AS INTEGER) + 1] AS cut FROM a)
    SELECT p_brand, cut, len(list_filter(l, lambda x: x >= cut)) AS members, round_even(list_sum(list_filter(l, lambda x: x >= cut))::DOUBLE / len(list_filter(l, lambda x: x >= cut)), 3) AS mean FROM t"""
)
def top_quartiles(spark: SparkSession, d: str) -> DataFrame:
    """Inclusive top quartile by counts of each value."""
    k = read(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("k"))
    k = k.withColumns({"upto": F.expr("sum(k) OVER (PARTITION BY p_brand ORDER BY p_size)"), "n": F.expr("sum(k) OVER (PARTITION BY p_brand)")})
    cut = k.groupBy("p_brand").agg(F.min(F.when(F.col("upto") > F.bround(0.75 * (F.col("n") - 1), 0), F.col("p_size"))).alias("cut"))
    top = k.join(cut, "p_brand").where("p_size >= cut")
    return top.groupBy("p_brand", "cut").agg(F.sum("k").alias("members"), F.bround(F.sum(F.col("p_size") * F.col("k")) / F.sum("k"), 3).alias("mean"))


@query(
    """SELECT generator_model, CAST(sum(length(prompt)) AS BIGINT) AS prompt_chars, CAST(sum(length(chosen)) AS BIGINT) AS answer_chars, round(avg(length(chosen)), 6) AS mean_chars, least(1.0, round_even(count(*) / 4000.0, 3)) AS strength FROM preference_pairs_audit GROUP BY generator_model"""
)
def volume_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Sums and means, and a capped evidence strength."""
    return read(spark, d, "preference_pairs_audit").groupBy("generator_model").agg(
        F.sum(F.length("prompt")).alias("prompt_chars"), F.sum(F.length("chosen")).alias("answer_chars"), F.round(F.avg(F.length("chosen")), 6).alias("mean_chars"),
        F.least(F.lit(1.0), F.bround(F.count("*") / 4000.0, 3)).alias("strength"),
    )


@query(
    """SELECT coalesce(passes_no_overlap_rule, false) AS passes, count(*) AS rows, count_if(max_8gram_overlap_with_held_out > 0) AS overlaps, count_if(max_8gram_overlap_with_held_out > 0 AND nearest_held_out_task_id IS NULL) AS unnamed,
    count_if(passes_no_overlap_rule AND max_8gram_overlap_with_held_out > 0) AS contradictions FROM contamination_preference_pairs GROUP BY 1"""
)
def report_failures(spark: SparkSession, d: str) -> DataFrame:
    """Counters of simple and compound conditions."""
    o = F.col("max_8gram_overlap_with_held_out") > 0
    return read(spark, d, "contamination_preference_pairs").groupBy(F.coalesce("passes_no_overlap_rule", F.lit(False)).alias("passes")).agg(
        F.count("*").alias("rows"), F.count_if(o).alias("overlaps"), F.count_if(o & F.col("nearest_held_out_task_id").isNull()).alias("unnamed"), F.count_if(F.col("passes_no_overlap_rule") & o).alias("contradictions")
    )


@query(
    """SELECT task_id, len(list_filter(input.prior_thread, lambda t: coalesce(t.content, '') = '')) = 0 AS all_said, len(list_filter(input.prior_thread, lambda t: t.role = 'agent')) > 0 AS any_agent FROM tasks WHERE input.prior_thread IS NOT NULL"""
)
def thread_quality(spark: SparkSession, d: str) -> DataFrame:
    """All and any over an array."""
    p = F.col("input.prior_thread")
    return read(spark, d, "tasks").where(p.isNotNull()).select("task_id", F.coalesce(F.forall(p, lambda t: F.coalesce(t["content"], F.lit("")) != ""), F.lit(True)).alias("all_said"), F.coalesce(F.exists(p, lambda t: F.coalesce(t["role"] == "agent", F.lit(False))), F.lit(False)).alias("any_agent"))


@query(
    """SELECT t.split_name, count(*) AS tasks, count_if(c.task_id IS NOT NULL) AS labelled, count_if(h.task_id IS NOT NULL) AS traced, count_if(c.task_id IS NOT NULL AND h.task_id IS NOT NULL) AS complete
    FROM (SELECT DISTINCT task_id, split_name FROM tasks) t LEFT JOIN (SELECT DISTINCT task_id FROM contamination_check WHERE passes_less_than_8gram_rule IS NOT NULL) c USING (task_id) LEFT JOIN (SELECT DISTINCT task_id FROM held_out_traces_raw) h USING (task_id) GROUP BY t.split_name"""
)
def label_completion(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "tasks").select("task_id", "split_name").distinct()
    c = read(spark, d, "contamination_check").where("passes_less_than_8gram_rule IS NOT NULL").select("task_id").distinct().withColumn("c", F.lit(True))
    h = read(spark, d, "held_out_traces_raw").select("task_id").distinct().withColumn("h", F.lit(True))
    j = t.join(c, "task_id", "left").join(h, "task_id", "left")
    return j.groupBy("split_name").agg(F.count("*").alias("tasks"), F.count_if("c").alias("labelled"), F.count_if("h").alias("traced"), F.count_if(F.col("c") & F.col("h")).alias("complete"))


@query("SELECT event_type, CAST(user_id % 4 AS INTEGER) AS provider, round(sum(value), 4) AS cost, count(*) AS n FROM events GROUP BY ALL")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type", F.pmod("user_id", F.lit(4)).cast("int").alias("provider")).agg(F.round(F.sum("value"), 4).alias("cost"), F.count("*").alias("n"))


_FOLD = """count_if(event_type = 'error') AS errors, count_if(event_type = 'view') AS views, max(CASE WHEN event_type = 'view' THEN ts END) AS last_view, bool_or(event_type = 'purchase') AS bought,
    arg_max(event_type, {'t': ts, 'e': event_id}) AS last_type, coalesce(arg_max(event_type = 'signup', {'t': ts, 'e': event_id}) FILTER (WHERE event_type IN ('signup', 'error')), false) AS opted_in"""


@query(f"SELECT user_id, {_FOLD} FROM (SELECT event_id, ts, user_id, event_type FROM events) GROUP BY user_id")
def state_fold(spark: SparkSession, d: str) -> DataFrame:
    """A thread's state from its events: the latest by time and id wins, as partial aggregates without sorting a thread."""
    e, t = read(spark, d, "events"), F.col("event_type")
    at = F.struct("ts", "event_id")
    switch = F.max_by(t == "signup", F.when(t.isin("signup", "error"), at))
    return e.groupBy("user_id").agg(
        F.count_if(t == "error").alias("errors"), F.count_if(t == "view").alias("views"), F.max(F.when(t == "view", F.col("ts"))).alias("last_view"), F.bool_or(t == "purchase").alias("bought"),
        F.max_by(t, at).alias("last_type"), F.coalesce(switch, F.lit(False)).alias("opted_in"),
    )


@query("SELECT user_id, coalesce(arg_min(event_type = 'signup', {'t': ts, 'e': event_id}) FILTER (WHERE event_type IN ('signup', 'error')), false) AS opted_in FROM events GROUP BY user_id")
def state_fold_oldest(spark: SparkSession, d: str) -> DataFrame:
    """The compatibility fold in which the oldest switch wins."""
    t = F.col("event_type")
    switch = F.min_by(t == "signup", F.when(t.isin("signup", "error"), F.struct("ts", "event_id")))
    return read(spark, d, "events").groupBy("user_id").agg(F.coalesce(switch, F.lit(False)).alias("opted_in"))



_REF = {k: v.replace("candidate_output", "ground_truth_output") for k, v in _NAMED.items()}
SUCCESS = f"""SELECT task_id, CAST(row_number() OVER (ORDER BY task_id) - 1 AS BIGINT) AS k, same, base, trained, ref_score = cand_score AS tie FROM (
    SELECT task_id, coalesce(ground_truth_output.subject = candidate_output.subject AND ground_truth_output.body = candidate_output.body, false) AS same,
    {' + '.join(f'CASE WHEN {v} THEN 1 ELSE 0 END' for v in _NAMED.values())} AS cand_score, {' + '.join(f'CASE WHEN {v} THEN 1 ELSE 0 END' for v in _REF.values())} AS ref_score,
    coalesce(ground_truth_output.subject = candidate_output.subject AND ground_truth_output.body = candidate_output.body, false) OR ref_score > cand_score AS base,
    length(coalesce(ground_truth_output.body, '')) <= length(coalesce(candidate_output.body, '')) AS trained
    FROM (SELECT * FROM tasks WHERE split_name = 'held_out' AND ground_truth_output IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY loaded_at) = 1))"""


def preference_success(t: DataFrame) -> DataFrame:
    """Success where the texts are the same or the reference passes more checks; ties are failures and are counted."""
    i, o, g = F.col("input"), F.col("candidate_output"), F.col("ground_truth_output")
    total = lambda out: sum(F.when(F.size(f(i, out)) == 0, 1).otherwise(0) for f in scoring.CHECKS.values())
    same = F.coalesce((g["subject"] == o["subject"]) & (g["body"] == o["body"]), F.lit(False))
    s = t.select("task_id", same.alias("same"), total(o).alias("c"), total(g).alias("r"), (F.length(F.coalesce(g["body"], F.lit(""))) <= F.length(F.coalesce(o["body"], F.lit("")))).alias("trained"))
    return s.select("task_id", "same", (F.col("same") | (F.col("r") > F.col("c"))).alias("base"), "trained", (F.col("r") == F.col("c")).alias("tie"))


def successes(spark, d):
    t = read(spark, d, "tasks").where("split_name = 'held_out' AND ground_truth_output IS NOT NULL").select("task_id", "input", "candidate_output", "ground_truth_output", "loaded_at")
    one = t.groupBy("task_id").agg(F.min_by(F.struct("input", "candidate_output", "ground_truth_output"), "loaded_at").alias("r")).select("task_id", "r.*")
    return preference_success(one)


@query(f"SELECT task_id, same, base, trained, tie FROM ({SUCCESS})")
def preference_successes(spark: SparkSession, d: str) -> DataFrame:
    return successes(spark, d)


_C = "SELECT count(*) AS n, count_if(base AND NOT trained) AS base_wins, count_if(trained AND NOT base) AS right_wins, avg(CAST(trained AS INTEGER) - CAST(base AS INTEGER)) AS lift FROM s"


@query(
    f"""WITH s AS ({SUCCESS}), c AS ({_C})
    SELECT n, base_wins, right_wins, round(lift, 10) AS lift, CASE WHEN base_wins + right_wins = 0 THEN 1.0 ELSE round((SELECT sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2))) FROM (SELECT base_wins + right_wins AS m, unnest(range(right_wins, base_wins + right_wins + 1)) AS k FROM c)), 6) END AS p FROM c"""
)
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    """Discordant pairs, lift and the exact one-sided tail."""
    b, t = F.col("base").cast("int"), F.col("trained").cast("int")
    c = successes(spark, d).agg(F.count("*").alias("n"), F.count_if(b > t).alias("base_wins"), F.count_if(t > b).alias("right_wins"), F.round(F.avg(t - b), 10).alias("lift"))
    tail = stats.mcnemar_p((F.col("base_wins") + F.col("right_wins")).cast("int"), F.col("right_wins").cast("int"))
    return c.withColumn("p", F.round(tail, 6))


_CI = f"""WITH s AS ({SUCCESS}), z AS (SELECT k, CAST(trained AS INTEGER) - CAST(base AS INTEGER) AS diff FROM s), n AS (SELECT count(*) AS n FROM z),
    r AS (SELECT b, i, CAST(concat('0x', substr(md5(concat(42, '|', b, '|', i)), 1, 8)) AS BIGINT) % n AS k FROM (SELECT unnest(range(200)) AS b), (SELECT unnest(range((SELECT n FROM n))) AS i), n),
    m AS (SELECT b, avg(diff) AS mean FROM r JOIN z USING (k) GROUP BY b), l AS (SELECT list_sort(list(mean)) AS l FROM m)
    SELECT round(l[6], 10) AS low, round(l[196], 10) AS high FROM l"""


@query(_CI)
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap of the lift over held-out tasks, numbered by id."""
    s = successes(spark, d).withColumn("diff", F.col("trained").cast("int") - F.col("base").cast("int")).select("task_id", "diff")
    return stats.bootstrap_ci(numbered(s, "task_id").select("k", "diff"), 200, 42)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """k from 0 in the order of a unique column."""
    return stats.ranked(df, [], order, order).drop("rank", "upto", "n")


@query(
    f"""WITH w AS (SELECT date_trunc('week', ts) AS week, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1)
    SELECT CAST(week AS DATE) AS week, round(rate, 6) AS rate, coalesce(rate >= 0.2 AND lag(rate) OVER (ORDER BY week) >= 0.2, false) AS stop FROM w"""
)
def stop_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Two consecutive weeks at or above a rate."""
    w = read(spark, d, "events").groupBy(F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").alias("week")).agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("rate"))
    before = F.expr("lag(rate) OVER (ORDER BY week)")
    return w.withColumn("before", before).select("week", F.round("rate", 6).alias("rate"), F.coalesce((F.col("rate") >= 0.2) & (F.col("before") >= 0.2), F.lit(False)).alias("stop"))


@query("SELECT user_id, event_id, ts, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    """The newest three events of each user; Spark keeps three rows a group before the shuffle."""
    rn = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)")
    return read(spark, d, "events").select("user_id", "event_id", "ts").withColumn("place", rn).where("place <= 3")


@query("SELECT task_id, split_name, metadata.signal_source AS source FROM tasks QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY loaded_at DESC) = 1")
def newest_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each key, by partial aggregation."""
    t = read(spark, d, "tasks").groupBy("task_id").agg(F.max_by(F.struct("split_name", F.col("metadata.signal_source").alias("source")), "loaded_at").alias("r"))
    return t.select("task_id", "r.split_name", "r.source")


@query("SELECT source, doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def longest_documents(spark: SparkSession, d: str) -> DataFrame:
    rn = F.expr("row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)")
    return read(spark, d, "documents").where("n_chars IS NOT NULL").select("source", "doc_id", "n_chars").withColumn("rn", rn).where("rn <= 5").drop("rn")


@query("SELECT thread_key, min(doc_id) AS first_doc, arg_min(source, doc_id) AS first_source FROM documents WHERE thread_key IS NOT NULL GROUP BY thread_key")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """First-seen distinct keys in order."""
    return read(spark, d, "documents").where("thread_key IS NOT NULL").groupBy("thread_key").agg(F.min("doc_id").alias("first_doc"), F.min_by("source", "doc_id").alias("first_source"))


@query("SELECT task_id, CASE WHEN row_number() OVER (ORDER BY task_id) <= least(50, count(*) OVER ()) THEN 'eval' ELSE 'dev' END AS tier FROM (SELECT DISTINCT task_id FROM judge_filter_accepted)")
def calibration_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty ids in order are the calibration tier: a top-k cut, not a global sort."""
    t = read(spark, d, "judge_filter_accepted").select("task_id").distinct()
    cut = t.orderBy("task_id").limit(50).withColumn("tier", F.lit("eval"))
    return t.join(F.broadcast(cut), "task_id", "left").select("task_id", F.coalesce("tier", F.lit("dev")).alias("tier"))


@query("SELECT task_id, CAST(ntile(7) OVER (ORDER BY task_id) AS INTEGER) AS shard FROM (SELECT DISTINCT task_id FROM judge_filter_accepted)")
def even_shards(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous shards whose sizes differ by one at most, from distributed row numbers."""
    t = stats.ranked(read(spark, d, "judge_filter_accepted").select("task_id").distinct(), [], "task_id", "task_id")
    small, extra = F.floor(F.col("n") / 7), F.col("n") % 7
    cut = (small + 1) * extra
    shard = F.when(F.col("k") < cut, F.floor(F.col("k") / (small + 1))).otherwise(extra + F.floor((F.col("k") - cut) / F.greatest(small, F.lit(1)))) + 1
    return t.select("task_id", shard.cast("int").alias("shard"))
