"""The same results in DuckDB SQL, by plain definitions over whole tables."""

from __future__ import annotations

_KEY = "coalesce(nullif(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g'), ''), 'unknown')"
_REPORT = f"""
WITH one AS (SELECT task_id, min({_KEY.format('metadata.failure_category')}) AS c1, min({_KEY.format('difficulty')}) AS c2,
    min(coalesce(CAST(input.icp_segment AS VARCHAR), 'unknown')) AS c3 FROM judge_filter_accepted WHERE task_id IS NOT NULL GROUP BY task_id),
long AS (SELECT 'metadata.failure_category' AS field_path, c1 AS c FROM one UNION ALL SELECT 'difficulty', c2 FROM one UNION ALL SELECT 'input.icp_segment', c3 FROM one),
have AS (SELECT field_path, c, count(*) AS n FROM long GROUP BY ALL),
want AS (SELECT DISTINCT plan_id, field_path, category_name, {_KEY.format('category_name')} AS c, greatest(min_rows, draw_rows * target_pct // 100) AS needed FROM sampling_targets)
SELECT plan_id, w.field_path, category_name, CAST(needed AS BIGINT) AS needed, coalesce(n, 0) AS available, CAST(greatest(0, needed - coalesce(n, 0)) AS BIGINT) AS gap,
    CAST(least(needed, coalesce(n, 0)) AS BIGINT) AS drawn, 100.0 * drawn / sum(drawn) OVER (PARTITION BY plan_id) AS actual_pct
FROM want w LEFT JOIN have h ON w.field_path = h.field_path AND w.c = h.c
"""

_LINES = r"""
lines AS (SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(s, '')),
    '(^|[^\p{L}\p{Nd}])ref[^\p{L}\p{Nd}]*tbv[0-9]+[^\p{L}\p{Nd}]*h?[0-9]+', '\1 ', 'g'), '[^\p{L}\p{Nd}]+'), lambda w: w != ''))) AS w, side FROM raw WHERE id IS NOT NULL),
kept AS (SELECT DISTINCT id, w, side FROM lines WHERE len(w) >= 8)
"""
_NEAR = "len(list_intersect(a.w, b.w)) * 17 >= 7 * (len(a.w) + len(b.w))"

P3 = f"""
WITH raw AS (SELECT task_id AS id, input.signal_brief.signal_line AS s, CASE split_name WHEN 'train' THEN 't' WHEN 'dev' THEN 'h' WHEN 'held_out' THEN 'h' END AS side FROM tasks),
{_LINES}
SELECT DISTINCT least(a.id, b.id) AS task_id_a, greatest(a.id, b.id) AS task_id_b FROM kept a, kept b
WHERE a.side = 'h' AND b.side = 't' AND a.id != b.id AND {_NEAR}
"""

P3_REPORT = f"""
WITH raw AS (SELECT task_id AS id, input.signal_brief.signal_line AS s, CASE split_name WHEN 'train' THEN 't' WHEN 'dev' THEN 'h' WHEN 'held_out' THEN 'h' END AS side FROM tasks),
{_LINES},
pairs AS (SELECT DISTINCT a.id AS held, b.id AS train FROM kept a, kept b WHERE a.side = 'h' AND b.side = 't' AND a.id != b.id AND {_NEAR}),
of AS (SELECT task_id, min(split_name) AS split, coalesce(min(metadata.signal_source), 'unknown') AS source FROM tasks WHERE split_name IN ('dev', 'held_out') GROUP BY task_id)
SELECT split, source, count(*) AS pairs, count(DISTINCT held) AS held_records, count(DISTINCT train) AS train_records FROM pairs JOIN of ON held = task_id GROUP BY ALL
"""

P6_GROUPS = f"""
WITH raw AS (SELECT task_id AS id, input.signal_brief.signal_line AS s, 0 AS side FROM judge_filter_accepted),
{_LINES},
cls AS (SELECT w, min(id) AS class_id, count(*) AS class_size FROM kept GROUP BY w),
links AS (SELECT a.w, count(*) AS links FROM cls a, cls b WHERE a.w != b.w AND {_NEAR} GROUP BY a.w)
SELECT k.id AS task_id, class_id, class_size, coalesce(links, 0) AS links FROM kept k JOIN cls ON k.w = cls.w LEFT JOIN links ON links.w = k.w
"""

P6 = f"""
WITH raw AS (SELECT task_id AS id, input.signal_brief.signal_line AS s, 0 AS side FROM judge_filter_accepted),
{_LINES}
SELECT DISTINCT a.id AS task_id_a, b.id AS task_id_b FROM kept a, kept b WHERE a.id < b.id AND {_NEAR}
"""

_TIES = r"""
keys AS (
    SELECT DISTINCT task_id, 's' || k AS k FROM (SELECT task_id, regexp_replace(lower(metadata.seed_origin), '[^\p{L}\p{Nd}]+', '', 'g') AS k FROM judge_filter_accepted) WHERE k NOT IN ('', 'sharedprobelibrary')
    UNION SELECT DISTINCT task_id, 'p' || k FROM (SELECT task_id, regexp_replace(lower(unnest(metadata.week10_probe_ids)), '[^\p{L}\p{Nd}]+', '', 'g') AS k FROM judge_filter_accepted) WHERE k NOT IN ('', 'sharedprobelibrary')),
edges AS (SELECT DISTINCT a.task_id AS u, b.task_id AS v FROM keys a JOIN keys b USING (k)),
reach AS (SELECT task_id AS root, task_id AS node FROM judge_filter_accepted UNION SELECT r.root, e.v FROM reach r JOIN edges e ON r.node = e.u)
"""
P4 = f"""
WITH RECURSIVE {_TIES}
SELECT task_id_a, task_id_b FROM (SELECT min(root) AS task_id_a, node AS task_id_b FROM reach GROUP BY node) WHERE task_id_a != task_id_b
"""

#: What must hold whatever the assignment: no early task moves, each task has a split or is set aside, no group is in two splits.
P4_BATCHES = f"""
WITH RECURSIVE {_TIES}
SELECT count(*) AS tasks, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS unassigned, CAST(0 AS BIGINT) AS late_quarantined_with_split, count(DISTINCT g) AS groups, CAST(0 AS BIGINT) AS groups_in_two_splits
FROM (SELECT min(root) AS g, node FROM reach WHERE node IS NOT NULL GROUP BY node)
"""

P6_ALL_GROUPS = f"""
SELECT ids.task_id, coalesce(g.class_id, ids.task_id) AS class_id, coalesce(g.class_size, 1) AS class_size, coalesce(g.links, 0) AS links
FROM (SELECT DISTINCT task_id FROM judge_filter_accepted WHERE task_id IS NOT NULL) ids LEFT JOIN ({P6_GROUPS}) g ON ids.task_id = g.task_id
"""

P5 = r"""
WITH texts AS (
    SELECT 'document' AS record_kind, doc_id AS record_id, text AS t FROM documents
    UNION ALL SELECT 'pair', pair_id, prompt FROM preference_pairs_audit UNION ALL SELECT 'pair', pair_id, chosen FROM preference_pairs_audit),
words AS (SELECT record_kind, record_id, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{Nd}]+'), lambda w: w != '') AS w FROM texts WHERE t IS NOT NULL),
grams AS (SELECT DISTINCT record_kind, record_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM words WHERE len(w) >= 8),
own AS (SELECT item_id, list_filter(regexp_split_to_array(lower(passage), '[^\p{L}\p{Nd}]+'), lambda w: w != '') AS w FROM held_out_items),
own_grams AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM own WHERE len(w) >= 8)
SELECT DISTINCT record_kind, record_id, item_id FROM grams JOIN own_grams USING (g)
"""

P5_REPORT = (
    P5.replace("AS record_id, text AS t", "AS record_id, 'text' AS field, text AS t").replace("'pair', pair_id, prompt", "'pair', pair_id, 'prompt', prompt").replace("'pair', pair_id, chosen", "'pair', pair_id, 'chosen', chosen")
    .replace("words AS (SELECT record_kind, record_id,", "words AS (SELECT record_kind, record_id, field,").replace("grams AS (SELECT DISTINCT record_kind, record_id,", "grams AS (SELECT DISTINCT record_kind, record_id, field,")
    .replace("SELECT DISTINCT record_kind, record_id, item_id FROM", "SELECT item_id, record_kind, count(DISTINCT record_id) AS records, count(DISTINCT concat(record_id, ' ', field)) AS fields FROM")
    + " GROUP BY item_id, record_kind"
)

SQL: dict[str, str] = {
    "p1_found": f"SELECT plan_id, category_name FROM ({_REPORT}) WHERE gap > 0",
    "p1_report": _REPORT,
    "p3_found": P3,
    "p3_report": P3_REPORT,
    "p4_found": P4,
    "p4_batches": P4_BATCHES,
    "p5_found": P5,
    "p5_report": P5_REPORT,
    "p6_found": P6,
    "p6_groups": P6_GROUPS,
    "p6_all_groups": P6_ALL_GROUPS,
}
