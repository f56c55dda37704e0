"""Joins, overlaps and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import fields
from tallyforge.functions.text import words
from tallyforge.operators import similarity, validation
from tallyforge.plans.registry import query
from tallyforge.plans.texts import CANDIDATE, FAMILY, INPUT, SIGNAL_DATE
from tallyforge.session import Scratch, read

TOKENS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w != '')"


def _tokens(c):
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _texts(spark, d, splits) -> DataFrame:
    t = read(spark, d, "tasks").where(F.col("split_name").isin(splits)).select(F.col("task_id").alias("id"), fields.input_text(F.col("input")).alias("text"))
    return t.groupBy("id").agg(F.min("text").alias("text")).select("id", _tokens(F.col("text")).alias("tokens"))


_SIDE = f"SELECT task_id AS id, {TOKENS.format(f'min({INPUT})')} AS t FROM tasks WHERE split_name IN ({{0}}) GROUP BY task_id"
_GRAM = "SELECT DISTINCT id, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))) AS g FROM {0} WHERE len(t) >= 8"
OVERLAP = f"""WITH l AS ({_SIDE.format("'held_out'")}), r AS ({_SIDE.format("'train', 'dev'")}), lg AS ({_GRAM.format('l')}), rg AS ({_GRAM.format('r')}),
p AS (SELECT lg.id AS a, rg.id AS b, count(*) AS n FROM lg JOIN rg USING (g) WHERE lg.id != rg.id GROUP BY ALL), m AS (SELECT a, max(n) AS n, arg_min(b, {{'n': -n, 'b': b}}) AS b FROM p GROUP BY a)
SELECT l.id AS task_id, CAST(greatest(len(l.t) - 7, 0) AS INTEGER) AS positions, len(l.t) >= 8 AS is_testable, coalesce(m.n, 0) AS max_overlap, m.b AS nearest_id FROM l LEFT JOIN m ON l.id = m.a"""


def _overlaps(spark, d) -> DataFrame:
    return similarity.nearest_overlap(_texts(spark, d, ["held_out"]), _texts(spark, d, ["train", "dev"])).withColumnRenamed("id", "task_id")


@query(OVERLAP)
def eightgram_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The training or dev task that shares most eight-grams with each held-out task."""
    return _overlaps(spark, d)


@query(f"SELECT count(*) AS records, count_if(is_testable) AS testable, count_if(is_testable AND max_overlap > 0) AS violations, count_if(is_testable AND max_overlap = 0) AS passes FROM ({OVERLAP})")
def contamination_summary(spark: SparkSession, d: str) -> DataFrame:
    """Passes are counted among testable records only; that a gram is shared is enough, so no pair is counted."""
    t, v = F.col("is_testable"), F.col("overlaps")
    found = similarity.any_overlap(_texts(spark, d, ["held_out"]), _texts(spark, d, ["train", "dev"]))
    return found.agg(F.count("*").alias("records"), F.count_if(t).alias("testable"), F.count_if(t & v).alias("violations"), F.count_if(t & ~v).alias("passes"))


_CT = f"list_distinct(regexp_extract_all(lower(min({CANDIDATE})), '[a-z0-9]+'))"


_NEAR_SETS = "len(list_intersect(a.t, b.t)) * 5 >= 4 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))"
_TOKEN_SETS = f"t AS (SELECT * FROM (SELECT task_id AS id, list_sort({_CT}) AS t FROM judge_filter_accepted WHERE task_id IS NOT NULL GROUP BY task_id) WHERE len(t) > 0), c AS (SELECT t, min(id) AS class_id, count(*) AS class_size FROM t GROUP BY t)"


def _token_sets(spark, d) -> DataFrame:
    t = read(spark, d, "judge_filter_accepted").select(F.col("task_id").alias("id"), fields.candidate_text(F.col("candidate_output")).alias("text"))
    return t.groupBy("id").agg(F.min("text").alias("text")).select("id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("tokens"))


@query(
    f"""WITH {_TOKEN_SETS}
    SELECT least(a.class_id, b.class_id) AS a, greatest(a.class_id, b.class_id) AS b, CAST(len(list_intersect(a.t, b.t)) AS INTEGER) AS shared, CAST(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS INTEGER) AS united
    FROM c a JOIN c b ON a.class_id < b.class_id WHERE {_NEAR_SETS}"""
)
def token_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Classes of accepted tasks, one for each set of answer tokens, that share four fifths of their tokens, by their smallest ids."""
    return similarity.TokenClasses(_token_sets(spark, d), 4, 5).pairs()


@query(
    f"""WITH {_TOKEN_SETS}, l AS (SELECT a.class_id, count(*) AS links FROM c a JOIN c b ON a.class_id != b.class_id WHERE {_NEAR_SETS} GROUP BY a.class_id)
    SELECT id, c.class_id, class_size, coalesce(links, 0) AS links FROM t JOIN c USING (t) LEFT JOIN l ON l.class_id = c.class_id"""
)
def token_jaccard_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of every accepted task with answer tokens, its size and the number of near classes."""
    return similarity.TokenClasses(_token_sets(spark, d), 4, 5).rows()


@query(
    f"""WITH t AS (SELECT * FROM (SELECT task_id AS id, {_CT} AS t, min(length({CANDIDATE})) AS n, min(len(coalesce(rubric.deterministic_checks, []))) AS s FROM judge_filter_accepted WHERE task_id IS NOT NULL GROUP BY task_id) WHERE len(t) > 0)
    SELECT a.id, arg_min(b.id, {{'s': -b.s, 'n': b.n, 'id': b.id}}) AS survivor, count(*) - 1 AS copies FROM t a JOIN t b ON {_NEAR_SETS} GROUP BY a.id"""
)
def near_duplicate_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Of a task and all its near copies the one with the highest total, else the shortest, else the first."""
    raw = read(spark, d, "judge_filter_accepted").select(F.col("task_id").alias("id"), fields.candidate_text(F.col("candidate_output")).alias("text"), F.size(F.coalesce("rubric.deterministic_checks", F.array())).alias("s"))
    ranks = raw.where("id IS NOT NULL").groupBy("id").agg(F.min(F.length("text")).alias("n"), F.min("s").alias("s")).select("id", F.struct((-F.col("s")).alias("s"), "n", "id").alias("rank"))
    return similarity.TokenClasses(_token_sets(spark, d), 4, 5).survivors(ranks)


@query(
    """WITH h AS (SELECT doc_id, sha256(concat(coalesce(text, ''), chr(0), coalesce(source, ''))) AS h FROM documents)
    SELECT h AS digest, count(*) AS copies, min(doc_id) AS survivor FROM h GROUP BY h HAVING count(*) > 1"""
)
def exact_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Digests of a chosen column set that occur more than once, with the copy that stays."""
    h = F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("\0"), F.coalesce("source", F.lit(""))), 256)
    return read(spark, d, "documents").groupBy(h.alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("survivor")).where("copies > 1")


@query(
    """WITH h AS (SELECT doc_id, thread_key, sha256(coalesce(text, '')) AS h FROM documents), n AS (SELECT h, min(doc_id) AS survivor, count(*) AS c FROM h GROUP BY h)
    SELECT count(*) AS distinct_texts, max(c) AS most_copies, CAST(sum(c - 1) AS BIGINT) AS dropped FROM n"""
)
def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.count("*").alias("c"))
    return n.agg(F.count("*").alias("distinct_texts"), F.max("c").alias("most_copies"), F.sum(F.col("c") - 1).alias("dropped"))


_TF = "SELECT id, tok, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all(t, '[A-Za-z0-9]+')) AS tok FROM {0}) GROUP BY ALL"


@query(
    f"""WITH lt AS (SELECT item_id AS id, passage AS t FROM held_out_items), rt AS (SELECT pair_id + 1000000000 AS id, min(chosen) AS t FROM preference_pairs_audit GROUP BY pair_id),
    l AS ({_TF.format('lt')}), r AS ({_TF.format('rt')}), nn AS (SELECT id, CAST(sum(c * c) AS BIGINT) AS norm2 FROM r GROUP BY id),
    p AS (SELECT l.id AS a, r.id AS b, CAST(sum(l.c * r.c) AS BIGINT) AS dot FROM l JOIN r USING (tok) GROUP BY ALL)
    SELECT a, m.b AS b, m.dot AS dot, m.norm2 AS norm2 FROM (SELECT a, arg_min({{'b': b, 'dot': dot, 'norm2': norm2}}, {{'k': -(dot * dot / norm2), 'b': b}}) AS m FROM p JOIN nn ON nn.id = p.b GROUP BY a)"""
)
def lexical_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The pair whose answer is lexically closest to each test item; ids of the two tables don't meet."""
    tok = lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))
    items = read(spark, d, "held_out_items").select(F.col("item_id").alias("id"), tok("passage").alias("tokens"))
    pairs = read(spark, d, "preference_pairs_audit").groupBy("pair_id").agg(F.min("chosen").alias("chosen")).select((F.col("pair_id") + 1_000_000_000).alias("id"), tok("chosen").alias("tokens"))
    return similarity.lexical_nearest(items, pairs)


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
    SELECT a.vec_id AS vec_id, arg_min(b.vec_id, {'c': -round(list_cosine_similarity(a.v, b.v), 9), 'b': b.vec_id}) AS nearest, round(max(list_cosine_similarity(a.v, b.v)), 6) AS cosine, max(list_cosine_similarity(a.v, b.v)) < 0.85 AS below
    FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id"""
)
def embedding_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vector of every query row (ids divisible by 20) among all rows."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    dim = len(v.limit(1).collect()[0].vec)
    near = similarity.dense_nearest(v.where("id % 20 = 0"), v, dim)
    return near.select(F.col("a").alias("vec_id"), F.col("b").alias("nearest"), F.round("cosine", 6).alias("cosine"), (F.col("cosine") < 0.85).alias("below"))


@query(
    f"""WITH t AS (SELECT DISTINCT task_id, split_name, {FAMILY} AS fam, {SIGNAL_DATE} AS day FROM tasks),
    h AS (SELECT * FROM t WHERE split_name = 'held_out'), o AS (SELECT * FROM t WHERE split_name = 'train'),
    j AS (SELECT h.task_id, o.task_id AS other, date_diff('day', o.day, h.day) AS gap FROM h JOIN o ON h.fam = o.fam)
    SELECT h.task_id, count(j.other) AS peers, CAST(min(j.gap) AS INTEGER) AS min_gap, arg_min(j.other, {{'g': j.gap, 'o': j.other}}) FILTER (WHERE j.gap IS NOT NULL) AS nearest, coalesce(min(j.gap) >= 7, true) AS passes
    FROM h LEFT JOIN j ON h.task_id = j.task_id GROUP BY h.task_id"""
)
def family_date_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Smallest signed gap in days to a training task of the same family; undated peers don't count.

    The smallest gap is the one to the family's latest day, so a family is aggregated before the join and its members are never paired."""
    t = read(spark, d, "tasks").select("task_id", "split_name", fields.family_key(F.col("metadata"), F.col("source_mode")).alias("fam"), fields.iso_date(F.col("metadata.signal_date")).alias("day")).distinct()
    o = t.where("split_name = 'train'").withColumn("late", F.when(F.col("day").isNotNull(), F.struct((-F.unix_date("day")).alias("o"), F.col("task_id").alias("id"))))
    o = o.groupBy("fam").agg(F.count("task_id").alias("peers"), F.max("day").alias("last"), F.min_by("task_id", "late").alias("latest"))
    h = t.where("split_name = 'held_out'").join(o, "fam", "left")
    # a task with several keys or days counts all its families
    g = h.withColumn("gap", F.datediff("day", "last")).withColumn("key", F.when(F.col("gap").isNotNull(), F.struct("gap", "latest")))
    g = g.groupBy("task_id").agg(F.coalesce(F.sum("peers"), F.lit(0)).alias("peers"), F.min("gap").alias("min_gap"), F.min_by("latest", "key").alias("nearest"))
    return g.withColumn("passes", F.coalesce(F.col("min_gap") >= 7, F.lit(True)))


@query(
    """SELECT t.trace_id, t.task_id, k.split_name, t.latency_ms FROM (SELECT trace_id, min(task_id) AS task_id, min(latency_ms) AS latency_ms FROM held_out_traces_raw GROUP BY trace_id) t
    JOIN (SELECT task_id, min(split_name) AS split_name FROM tasks GROUP BY task_id) k ON t.task_id = k.task_id"""
)
def trace_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Inner join on a key; the missing side is a separate report."""
    t = read(spark, d, "held_out_traces_raw").groupBy("trace_id").agg(F.min("task_id").alias("task_id"), F.min("latency_ms").alias("latency_ms"))
    return t.join(read(spark, d, "tasks").groupBy("task_id").agg(F.min("split_name").alias("split_name")), "task_id").select("trace_id", "task_id", "split_name", "latency_ms")


@query(
    """SELECT k.task_id, count(DISTINCT t.trace_id) AS traces, count(DISTINCT c.checked_at) AS checks, count(DISTINCT t.trace_id) = 0 OR count(DISTINCT c.checked_at) = 0 AS missing
    FROM (SELECT DISTINCT task_id FROM tasks WHERE split_name IN ('dev', 'held_out')) k LEFT JOIN held_out_traces_raw t USING (task_id) LEFT JOIN contamination_check c USING (task_id) GROUP BY k.task_id"""
)
def three_way_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with their traces and checks; each side is counted before it is joined."""
    k = read(spark, d, "tasks").where(F.col("split_name").isin("dev", "held_out")).select("task_id").distinct()
    t = read(spark, d, "held_out_traces_raw").groupBy("task_id").agg(F.count_distinct("trace_id").alias("traces"))
    c = read(spark, d, "contamination_check").groupBy("task_id").agg(F.count_distinct("checked_at").alias("checks"))
    j = k.join(t, "task_id", "left").join(c, "task_id", "left").fillna(0, ["traces", "checks"])
    return j.withColumn("missing", (F.col("traces") == 0) | (F.col("checks") == 0))


@query("SELECT DISTINCT p.pair_id, p.task_id FROM preference_pairs_audit p LEFT JOIN (SELECT DISTINCT task_id FROM documents WHERE task_id IS NOT NULL) t ON p.task_id = t.task_id WHERE t.task_id IS NULL")
def pairs_without_document(spark: SparkSession, d: str) -> DataFrame:
    """Keys of one side that the other lacks, as a violation report."""
    held = read(spark, d, "documents").where("task_id IS NOT NULL").select("task_id").distinct()
    return read(spark, d, "preference_pairs_audit").select("pair_id", "task_id").distinct().join(held, "task_id", "left_anti").select("pair_id", "task_id")


@query(
    """SELECT p.pair_id, coalesce(c.overlap, -1) AS overlap FROM (SELECT DISTINCT pair_id FROM preference_pairs_audit) p
    LEFT JOIN (SELECT pair_id, max(max_8gram_overlap_with_held_out) AS overlap FROM contamination_preference_pairs GROUP BY pair_id) c USING (pair_id)"""
)
def pair_overlap_default(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "contamination_preference_pairs").groupBy("pair_id").agg(F.max("max_8gram_overlap_with_held_out").alias("overlap"))
    return read(spark, d, "preference_pairs_audit").select("pair_id").distinct().join(c, "pair_id", "left").select("pair_id", F.coalesce("overlap", F.lit(-1)).alias("overlap"))


def _raters(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two passes of verdicts by (task, dimension): the first and the last check run of a task, with latency as a second dimension."""
    c = read(spark, d, "contamination_check").where("checked_at IS NOT NULL AND passes_less_than_8gram_rule IS NOT NULL")
    verdict = F.when(F.col("passes_less_than_8gram_rule"), "PASS").when(~F.col("passes_less_than_8gram_rule"), "FAIL")
    one = c.groupBy("task_id").agg(F.min_by(verdict, "checked_at").alias("v1"), F.max_by(verdict, "checked_at").alias("v2"), F.count("*").alias("n"))
    mark = read(spark, d, "held_out_traces_raw").groupBy("task_id").agg(F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi"))
    dim = lambda df, name, col: df.where(F.col(col).isNotNull()).select("task_id", F.lit(name).alias("dim"), F.col(col).alias("v"))
    slow = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col(c) > 800, "FAIL").otherwise("PASS"))
    mark = mark.select("task_id", slow("lo").alias("v1"), F.when(F.col("hi") < 2000, slow("hi")).alias("v2"))
    return dim(one, "overlap", "v1").unionByName(dim(mark, "latency", "v1")), dim(one.where("n > 1"), "overlap", "v2").unionByName(dim(mark, "latency", "v2"))


_V = "CASE WHEN {0} THEN 'PASS' WHEN NOT {0} THEN 'FAIL' END"
_SLOW = "CASE WHEN {0} IS NOT NULL THEN CASE WHEN {0} > 800 THEN 'FAIL' ELSE 'PASS' END END"
RATERS = f"""WITH c AS (SELECT task_id, arg_min({_V.format('passes_less_than_8gram_rule')}, checked_at) AS v1, arg_max({_V.format('passes_less_than_8gram_rule')}, checked_at) AS v2, count(*) AS n
    FROM contamination_check WHERE checked_at IS NOT NULL AND passes_less_than_8gram_rule IS NOT NULL GROUP BY task_id),
m AS (SELECT task_id, min(latency_ms) AS lo, max(latency_ms) AS hi FROM held_out_traces_raw GROUP BY task_id),
a AS (SELECT task_id, 'overlap' AS dim, v1 AS v FROM c WHERE v1 IS NOT NULL UNION ALL SELECT task_id, 'latency', {_SLOW.format('lo')} FROM m WHERE lo IS NOT NULL),
b AS (SELECT c.task_id, 'overlap' AS dim, v2 AS v FROM c WHERE n > 1 AND v2 IS NOT NULL UNION ALL SELECT task_id, 'latency', {_SLOW.format('hi')} FROM m WHERE hi < 2000)"""


@query(f"{RATERS} SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.dim, b.dim) AS dim, a.v AS v1, b.v AS v2, a.v IS NULL OR b.v IS NULL AS missing FROM a FULL JOIN b ON a.task_id = b.task_id AND a.dim = b.dim")
def rater_keys(spark: SparkSession, d: str) -> DataFrame:
    """Full outer join of two label passes; one-sided keys are missing."""
    a, b = _raters(spark, d)
    j = a.withColumnRenamed("v", "v1").join(b.withColumnRenamed("v", "v2"), ["task_id", "dim"], "full_outer")
    return j.withColumn("missing", F.col("v1").isNull() | F.col("v2").isNull())


@query(f"{RATERS} SELECT dim, count(*) AS total, count_if(a.v = b.v) AS matches, round_even(count_if(a.v = b.v)::DOUBLE / count(*), 4) AS agreement FROM a JOIN b USING (task_id, dim) GROUP BY dim")
def agreement_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    a, b = _raters(spark, d)
    j = a.withColumnRenamed("v", "v1").join(b.withColumnRenamed("v", "v2"), ["task_id", "dim"])
    same = F.count_if(F.col("v1") == F.col("v2"))
    return j.groupBy("dim").agg(F.count("*").alias("total"), same.alias("matches"), F.bround(same / F.count("*"), 4).alias("agreement"))


@query(
    r"""WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x != '')) AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, min(name_id) AS name_id FROM w JOIN (SELECT name_id, lower(name_text) AS w FROM known_names WHERE length(name_text) > 0) n USING (w) GROUP BY doc_id"""
)
def first_known_name(spark: SparkSession, d: str) -> DataFrame:
    """The first known name, in table order, that is a word of the text; empty names match nothing."""
    n = read(spark, d, "known_names").where(F.length("name_text") > 0).select("name_id", F.lower("name_text").alias("w"))
    w = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    return w.join(n, "w").groupBy("doc_id").agg(F.min("name_id").alias("name_id"))


@query(
    """WITH c AS (SELECT DISTINCT lower(input.company_name) AS company FROM tasks WHERE length(input.company_name) > 0), n AS (SELECT lower(name_text) AS name, min(name_id) AS name_id FROM known_names WHERE length(name_text) > 0 GROUP BY 1)
    SELECT company, min(name_id) AS name_id FROM c JOIN n ON contains(company, name) OR contains(name, company) GROUP BY company"""
)
def company_known_names(spark: SparkSession, d: str) -> DataFrame:
    """The first known name that stands in a company's name or holds it, wherever in a word."""
    c = read(spark, d, "tasks").where("length(input.company_name) > 0").select(F.lower("input.company_name").alias("id")).distinct()
    found = validation.first_contained(c.select("id", F.col("id").alias("text")), read(spark, d, "known_names").select("name_id", F.col("name_text").alias("name")))
    return found.withColumnRenamed("id", "company")


@query(
    """SELECT doc_id, min(name_id) AS name_id FROM documents JOIN (SELECT lower(name_text) AS name, name_id FROM known_names WHERE length(name_text) > 0) ON contains(lower(text), name) OR (length(text) > 0 AND contains(name, lower(text))) GROUP BY doc_id"""
)
def first_contained_name(spark: SparkSession, d: str) -> DataFrame:
    """The first known name that a document's text holds, or that holds the text."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return validation.first_contained(docs, read(spark, d, "known_names").select("name_id", F.col("name_text").alias("name"))).withColumnRenamed("id", "doc_id")


@query(
    """WITH e AS (SELECT event_id, user_id, ts, value, event_type FROM events), p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view'),
    j AS (SELECT p.event_id, p.value AS now, v.event_id AS vid, v.value AS was, abs(epoch_us(v.ts) - epoch_us(p.ts - INTERVAL 3 DAY)) AS off FROM p JOIN v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 4 DAY AND p.ts - INTERVAL 2 DAY),
    m AS (SELECT event_id, arg_min({'vid': vid, 'delta': now - was}, {'off': off, 'vid': vid}) AS m FROM j GROUP BY event_id)
    SELECT p.event_id, m.m.vid AS nearest, CASE WHEN m.m.vid IS NULL THEN 'insufficient' WHEN m.m.delta >= 5 THEN 'accelerating' WHEN m.m.delta <= -5 THEN 'declining' ELSE 'stable' END AS label FROM p LEFT JOIN m USING (event_id)"""
)
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The view nearest to three days before each purchase, within a day; delta as a label.

    Times are cut into day cells, so the join is an equi-join on user and cell and a user's whole history is never paired.
    """
    e = read(spark, d, "events").select("event_id", "user_id", "value", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    day = 86_400_000_000
    goal = F.col("us") - 3 * day
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("value").alias("now"), goal.alias("goal"))
    cells = p.withColumn("cell", F.explode(F.sequence(F.floor((F.col("goal") - day) / day), F.floor((F.col("goal") + day) / day))))
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("vid"), F.col("value").alias("was"), "us", F.floor(F.col("us") / day).alias("cell"))
    off = F.abs(F.col("us") - F.col("goal"))
    near = cells.join(v, ["user_id", "cell"]).where(off <= day).groupBy("event_id").agg(F.min_by(F.struct("vid", (F.col("now") - F.col("was")).alias("delta")), F.struct(off, F.col("vid"))).alias("m"))
    label = F.when(F.col("m").isNull(), "insufficient").when(F.col("m.delta") >= 5, "accelerating").when(F.col("m.delta") <= -5, "declining").otherwise("stable")
    return p.select("event_id").join(near, "event_id", "left").select("event_id", F.col("m.vid").alias("nearest"), label.alias("label"))


@query(
    """WITH k AS (SELECT DISTINCT task_id, unnest(metadata.week10_probe_ids) AS p, input.icp_segment AS seg FROM judge_filter_accepted),
    o AS (SELECT a.task_id AS a, b.task_id AS b, count(*) AS overlap, max(CASE WHEN a.seg = b.seg THEN 1 ELSE 0 END) AS same FROM k a JOIN k b ON a.p = b.p AND a.task_id != b.task_id GROUP BY ALL)
    SELECT a AS task_id, b AS peer, overlap, CAST(row_number() OVER (PARTITION BY a ORDER BY overlap DESC, same DESC, b DESC) AS INTEGER) AS place FROM o QUALIFY place <= 3"""
)
def overlap_peers(spark: SparkSession, d: str) -> DataFrame:
    """The three peers that share most probe ids, ties by segment and id.

    Tasks with equal probe ids and segment are one class: its overlaps are counted once, and of a class only the four greatest ids can
    be among anyone's three peers. A default id on very many tasks thus costs the square of the different sets that hold it, not of
    the tasks."""
    k = read(spark, d, "judge_filter_accepted").where("task_id IS NOT NULL").select("task_id", F.explode("metadata.week10_probe_ids").alias("p"), F.coalesce("input.icp_segment", F.lit(-(1 << 31))).alias("seg")).where("p IS NOT NULL")
    sets = k.groupBy("task_id", "seg").agg(F.array_sort(F.collect_set("p")).alias("ps"))  # a task's own ids
    one = sets.groupBy("task_id").agg(F.collect_list(F.struct("seg", "ps")).alias("parts")).withColumn("cls", F.xxhash64(F.array_sort("parts")))
    of = Scratch(spark, "peers").keep(one.select("task_id", "cls", "parts"))
    # the greatest ids of a class, ranked where they are before the shuffle, so no class is gathered
    top = of.withColumn("nth", F.expr("row_number() OVER (PARTITION BY cls ORDER BY task_id DESC)")).where("nth <= 4").select("cls", F.col("task_id").alias("peer"))
    held = of.groupBy("cls").agg(F.any_value("parts").alias("parts")).select("cls", F.explode("parts").alias("x")).select("cls", "x.seg", F.explode("x.ps").alias("p"))
    a, b = held.alias("a"), held.alias("b")
    same = F.max(F.when((F.col("a.seg") == F.col("b.seg")) & (F.col("a.seg") != -(1 << 31)), 1).otherwise(0))
    o = a.join(b, F.col("a.p") == F.col("b.p")).groupBy(F.col("a.cls").alias("cls"), F.col("b.cls").alias("other")).agg(F.count("*").alias("overlap"), same.alias("same"))
    place = lambda key: F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY overlap DESC, same DESC, peer DESC)")
    best = o.join(top.withColumnRenamed("cls", "other"), "other").withColumn("place", place("cls")).where("place <= 4").drop("place", "other")
    out = of.select("task_id", "cls").join(best, "cls").where("task_id != peer").withColumn("place", place("task_id"))
    return out.where("place <= 3").select("task_id", "peer", "overlap", "place")


@query(
    """WITH want AS (SELECT DISTINCT task_id FROM contamination_check), p AS (SELECT DISTINCT task_id, CASE split_name WHEN 'train' THEN 1 WHEN 'dev' THEN 2 WHEN 'held_out' THEN 3 ELSE 4 END AS o, split_name FROM tasks)
    SELECT w.task_id, arg_min(p.split_name, p.o) AS split_name, min(p.o) IS NOT NULL AS found FROM want w LEFT JOIN p USING (task_id) GROUP BY w.task_id"""
)
def first_partition_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first partition, in a fixed order, that holds an id; missing ids are reported."""
    o = F.when(F.col("split_name") == "train", 1).when(F.col("split_name") == "dev", 2).when(F.col("split_name") == "held_out", 3).otherwise(4)
    p = read(spark, d, "tasks").groupBy("task_id").agg(F.min_by("split_name", o).alias("split_name"), F.lit(True).alias("found"))
    return read(spark, d, "contamination_check").select("task_id").distinct().join(p, "task_id", "left").select("task_id", "split_name", F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT doc_id, task_id IN (SELECT task_id FROM tasks WHERE task_id IS NOT NULL) AS known FROM documents WHERE task_id IS NOT NULL")
def known_task_flags(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "tasks").select("task_id").distinct().withColumn("known", F.lit(True))
    return read(spark, d, "documents").where("task_id IS NOT NULL").join(k, "task_id", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("known"))


_DOM = r"regexp_extract(lower(text), '@([a-z0-9.-]+\.[a-z]{2,})', 1)"


@query(
    f"""WITH m AS (SELECT doc_id, thread_key, nullif({_DOM}, '') AS dom FROM documents), s AS (SELECT DISTINCT dom FROM m WHERE doc_id % 7 = 0 AND dom IS NOT NULL), t AS (SELECT DISTINCT thread_key FROM m WHERE doc_id % 97 = 0 AND thread_key IS NOT NULL)
    SELECT doc_id FROM m WHERE (dom IS NULL OR dom NOT IN (SELECT dom FROM s)) AND (thread_key IS NULL OR thread_key NOT IN (SELECT thread_key FROM t))"""
)
def suppressed_out(spark: SparkSession, d: str) -> DataFrame:
    """Anti-join on either of two keys, as two equi anti-joins; a null key suppresses nothing. The suppression lists are made of the table itself."""
    m = read(spark, d, "documents").select("doc_id", "thread_key", F.nullif(F.regexp_extract(F.lower("text"), r"@([a-z0-9.-]+\.[a-z]{2,})", 1), F.lit("")).alias("dom"))
    s, t = m.where("doc_id % 7 = 0 AND dom IS NOT NULL").select("dom").distinct(), m.where("doc_id % 97 = 0 AND thread_key IS NOT NULL").select("thread_key").distinct()
    return m.join(s, "dom", "left_anti").join(t, "thread_key", "left_anti").select("doc_id")


@query(
    """WITH c AS (SELECT doc_id, task_id, thread_key, loaded_at FROM documents), k AS (SELECT doc_id, 1 AS rule, task_id AS key FROM c WHERE task_id IS NOT NULL UNION ALL SELECT doc_id, 2, thread_key FROM c WHERE thread_key IS NOT NULL),
    own AS (SELECT 1 AS rule, task_id AS key, doc_id AS thread, loaded_at FROM c WHERE task_id IS NOT NULL UNION ALL SELECT 2, thread_key, doc_id, loaded_at FROM c WHERE thread_key IS NOT NULL),
    best AS (SELECT rule, key, arg_max(thread, {'t': loaded_at, 'd': thread}) AS thread FROM own GROUP BY ALL)
    SELECT c.doc_id, arg_min(b.thread, k.rule) AS thread, CAST(min(k.rule) AS INTEGER) AS rule FROM c JOIN k USING (doc_id) JOIN best b ON k.rule = b.rule AND k.key = b.key GROUP BY c.doc_id"""
)
def resolved_threads(spark: SparkSession, d: str) -> DataFrame:
    """Keys by priority: the task's newest document, else the thread's. The newest of a key is found before the join, so a hot key isn't paired."""
    c = read(spark, d, "documents").select("doc_id", "loaded_at", F.explode(F.array(F.struct(F.lit(1).alias("rule"), F.col("task_id").alias("key")), F.struct(F.lit(2).alias("rule"), F.col("thread_key").alias("key")))).alias("k")).where("k.key IS NOT NULL")
    keys = c.select("doc_id", "loaded_at", "k.rule", "k.key")
    best = keys.groupBy("rule", "key").agg(F.max_by("doc_id", F.struct("loaded_at", "doc_id")).alias("thread"))
    return keys.join(best, ["rule", "key"]).groupBy("doc_id").agg(F.min_by("thread", "rule").alias("thread"), F.min("rule").alias("rule"))


@query("SELECT pair_id, count(*) AS reruns FROM contamination_preference_pairs c WHERE NOT EXISTS (SELECT 1 FROM preference_pairs_audit p WHERE p.pair_id = c.pair_id AND p.status = 'skipped_chosen_fails') GROUP BY pair_id")
def reports_kept(spark: SparkSession, d: str) -> DataFrame:
    """A correlated NOT EXISTS as a left anti join."""
    gone = read(spark, d, "preference_pairs_audit").where("status = 'skipped_chosen_fails'").select("pair_id").distinct()
    return read(spark, d, "contamination_preference_pairs").join(gone, "pair_id", "left_anti").groupBy("pair_id").agg(F.count("*").alias("reruns"))
