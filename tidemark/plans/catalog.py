"""Relational queries over the review views, in SQL that Catalyst plans as it stands.

Every ordering has a unique last key, every rate guards its denominator, and
random choices are md5 orders of seed and id, so results are the same on any
cluster and in any engine. `DUCK` has the other dialect's text where it differs.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.stats import wilson_sql
from tidemark.plans.views import ALL, TABLES, duck, view

SQL: dict[str, str] = {}
DUCK: dict[str, str] = {}

def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = SQL[name]
    return spark.sql(sql, **{v: view(spark, sf_dir, v) for v in (*ALL, *TABLES) if f"{{{v}}}" in sql})

def rnd(seed: int, key: str = "review_id") -> str:
    return f"md5('{seed}:' || CAST({key} AS STRING))"

LOW, HIGH = wilson_sql("CAST(k AS DOUBLE)", "CAST(n AS DOUBLE)")
ROLL = "CASE WHEN grouping(app) = 1 THEN 'all' ELSE app END AS app"
DIV = "CAST({} AS DOUBLE) / NULLIF(CAST({} AS DOUBLE), 0e0)".format
#: The partial week that reports show.
SHOWN = "DATE '2024-01-29'"
_RANKED = f"SELECT review_id, app, weak_label, gold, score, row_number() OVER (PARTITION BY app, weak_label ORDER BY {rnd(42)}, review_id) AS rn, count(*) OVER (PARTITION BY app, weak_label) AS n FROM {{labeled}}"
#: The stratified sample, with its ranks.
_SAMPLE = f"(SELECT * FROM ({_RANKED}) AS t WHERE rn <= 50)"

# ---- scans, filters, cases
SQL["scan_parquet"] = "SELECT * FROM {orders}"
SQL["scan_pruned"] = "SELECT review_id, app, score FROM {reviews} WHERE score <= 2"
SQL["filter_complaints"] = "SELECT review_id, app, score, topic FROM {reviews} WHERE is_complaint AND NOT is_partial_week AND (topic <> -1 OR score = 1)"
SQL["filter_isin"] = "SELECT review_id, app, topic FROM {reviews} WHERE topic IN (1, 3, 5) AND app NOT IN ('app2')"
SQL["flagged_by"] = "SELECT review_id, CASE WHEN score <= 2 AND pred_label = 'negative' THEN 'star+model' WHEN score <= 2 THEN 'star rule' WHEN pred_label = 'negative' THEN 'model' ELSE '-' END AS flagged_by FROM {reviews}"
SQL["label_scheme"] = "SELECT review_id, CASE WHEN pred_label = 'negative' THEN 'complaint' ELSE 'other' END AS label FROM {reviews}"
SQL["weak_label"] = "SELECT review_id, CASE WHEN score IN (1, 2) THEN 'negative' WHEN score = 3 THEN 'neutral' WHEN score IN (4, 5) THEN 'positive' ELSE raise_error('unmapped score: ' || CAST(score AS STRING)) END AS weak_label FROM {reviews}"
DUCK["weak_label"] = "SELECT review_id, ['negative', 'negative', 'neutral', 'positive', 'positive'][score] AS weak_label FROM {reviews}"
SQL["scheme_spec"] = "SELECT review_id, weak_label AS label FROM {labeled}"
SQL["scheme_drop3"] = "SELECT review_id, CASE WHEN score <= 2 THEN 'negative' ELSE 'non_negative' END AS label FROM {labeled} WHERE score <> 3"
DUCK["scheme_drop3"] = "SELECT review_id, m.label FROM {labeled} JOIN (VALUES (1, 'negative'), (2, 'negative'), (4, 'non_negative'), (5, 'non_negative')) AS m(star, label) ON score = star"
SQL["scheme_3neg"] = "SELECT review_id, CASE WHEN score <= 3 THEN 'negative' ELSE 'non_negative' END AS label FROM {labeled}"
DUCK["scheme_3neg"] = "SELECT review_id, m.label FROM {labeled} JOIN (VALUES (1, 'negative'), (2, 'negative'), (3, 'negative'), (4, 'non_negative'), (5, 'non_negative')) AS m(star, label) ON score = star"
SQL["spike_window"] = "SELECT review_id, app, ts FROM {reviews} WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00'"
SQL["mask_notes"] = r"SELECT review_id, content LIKE '%Licensed%' AS has_license, content RLIKE '(?iU)\\b(?:the|que)\\b' AND length(content) > 1000 AS long_match FROM {texts}"
DUCK["mask_notes"] = r"SELECT review_id, contains(content, 'Licensed') AS has_license, regexp_matches(content, '(?i)(?:^|[^\p{L}\p{N}_])(?:the|que)(?:$|[^\p{L}\p{N}_])') AND length(content) > 1000 AS long_match FROM {texts}"
SQL["parse_review"] = "SELECT review_id, text_clean AS content, score, CASE WHEN trim(version) IN ('', '0') THEN NULL ELSE version END AS version, timestamp_micros(CAST(epoch_us AS BIGINT)) AS ts, app FROM (SELECT *, timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS epoch_us FROM {reviews}) AS raw"
DUCK["parse_review"] = "SELECT review_id, text_clean AS content, score, nullif(nullif(trim(version), ''), '0') AS version, ts, app FROM {reviews}"

# ---- joins
SQL["strata_weights"] = f"SELECT s.review_id, s.app, s.weak_label, CAST(p.n AS DOUBLE) / CAST(count(*) OVER (PARTITION BY s.app, s.weak_label) AS DOUBLE) AS weight FROM {_SAMPLE} s JOIN (SELECT app, weak_label, count(*) AS n FROM {{labeled}} GROUP BY app, weak_label) p ON s.app = p.app AND s.weak_label = p.weak_label"
SQL["topic_map"] = "SELECT r.review_id, r.topic, m.name FROM {reviews} r LEFT JOIN (VALUES (-1, 'outlier'), (0, 'login'), (1, 'payment'), (2, 'update'), (3, 'login')) AS m(topic, name) ON r.topic = m.topic"
SQL["join_semi"] = "SELECT review_id, app FROM {docs} WHERE review_id IN (SELECT doc_id FROM {labels} WHERE quality = 0)"
SQL["join_anti"] = "SELECT review_id, app FROM {texts} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.review_id)"
SQL["exclude_id_text"] = "SELECT review_id FROM {docs} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.review_id AND l.toxic = 1) AND NOT EXISTS (SELECT 1 FROM {labels} l JOIN {documents} x ON l.doc_id = x.doc_id WHERE l.toxic = 1 AND lower(x.text) = lower(d.content))"
DUCK["exclude_id_text"] = SQL["exclude_id_text"]
SQL["exclude_id_text"] = SQL["exclude_id_text"].replace("lower(x.text) = lower(d.content)", "sha2(lower(x.text), 256) = sha2(lower(d.content), 256)")
SQL["ordinal_check"] = "SELECT a.rn, a.review_id AS left_id, b.review_id AS right_id, a.review_id = b.review_id AS same FROM (SELECT review_id, row_number() OVER (ORDER BY review_id) AS rn FROM {texts}) a JOIN (SELECT review_id, row_number() OVER (ORDER BY app, review_id) AS rn FROM {texts}) b ON a.rn = b.rn"
#: Of the ranked sample, slots whose weak label is wrong get the usable reserve rows of their stratum in turn, up to the first that has no label yet (told by a digest).
SQL["replacement_plan"] = f"""
WITH r AS (SELECT * FROM ({_RANKED}) AS t WHERE rn <= 60),
slots AS (SELECT review_id AS slot_id, app, weak_label, row_number() OVER (PARTITION BY app, weak_label ORDER BY rn) AS k FROM r WHERE rn <= 40 AND gold <> weak_label),
reserve AS (SELECT review_id, app, weak_label, rn, gold = weak_label AS valid, sum(CASE WHEN {rnd(8)} LIKE '0%' THEN 1 ELSE 0 END) OVER (PARTITION BY app, weak_label ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unlabeled FROM r WHERE rn > 40),
usable AS (SELECT review_id, app, weak_label, row_number() OVER (PARTITION BY app, weak_label ORDER BY rn) AS k FROM reserve WHERE valid AND unlabeled = 0)
SELECT s.slot_id, s.app, s.weak_label, u.review_id AS replacement FROM slots s LEFT JOIN usable u ON s.app = u.app AND s.weak_label = u.weak_label AND s.k = u.k"""
DUCK["replacement_plan"] = f"""
WITH r AS (SELECT * FROM ({_RANKED}) AS t WHERE rn <= 60),
stop AS (SELECT app, weak_label, coalesce(min(rn) FILTER (rn > 40 AND {rnd(8)} LIKE '0%'), 1000) AS edge FROM r GROUP BY app, weak_label),
slots AS (SELECT app, weak_label, list(review_id ORDER BY rn) AS ids FROM r WHERE rn <= 40 AND gold <> weak_label GROUP BY app, weak_label),
usable AS (SELECT r.app, r.weak_label, list(review_id ORDER BY rn) AS ids FROM r JOIN stop USING (app, weak_label) WHERE rn > 40 AND rn < edge AND gold = weak_label GROUP BY r.app, r.weak_label)
SELECT unnest(s.ids) AS slot_id, s.app, s.weak_label, unnest(list_resize(coalesce(u.ids, []), len(s.ids))) AS replacement FROM slots s LEFT JOIN usable u ON s.app = u.app AND s.weak_label = u.weak_label"""
SQL["partition_bijection"] = "WITH pairs AS (SELECT DISTINCT topic AS old, topic % 4 AS new FROM {reviews}) SELECT old, new, count(*) OVER (PARTITION BY old) = 1 AND count(*) OVER (PARTITION BY new) = 1 AS one_to_one FROM pairs"

# ---- aggregations
SQL["complaint_share"] = f"SELECT basis, {ROLL}, count(*) AS n, count_if(is_complaint) AS k, {DIV('count_if(is_complaint)', 'count(*)')} AS share FROM (SELECT 'all rows' AS basis, app, is_complaint FROM {{reviews}} UNION ALL SELECT 'pool' AS basis, app, is_complaint FROM {{reviews}} WHERE review_id % 3 <> 0) AS t GROUP BY GROUPING SETS ((basis, app), (basis))"
SQL["short_report"] = f"SELECT app, score, count(*) AS n, count_if(length(text_clean) < 8) AS n_short, {DIV('count_if(length(text_clean) < 8)', 'count(*)')} AS share FROM {{reviews}} GROUP BY app, score"
SQL["dup_report"] = f"SELECT app, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS dups, {DIV('sum(n - 1)', 'sum(n)')} AS dup_share, {DIV('sum(CASE WHEN n_text > 100 THEN n - 1 ELSE 0 END)', 'sum(CASE WHEN n_text > 100 THEN n ELSE 0 END)')} AS long_dup_share FROM (SELECT app, count(*) AS n, max(length(content)) AS n_text FROM {{texts}} GROUP BY app, md5(lower(coalesce(content, '')))) AS t GROUP BY app"
DUCK["dup_report"] = f"SELECT app, count(*) AS n, count_if(rn > 1) AS dups, {DIV('count_if(rn > 1)', 'count(*)')} AS dup_share, {DIV('count_if(rn > 1 AND length(content) > 100)', 'count_if(length(content) > 100)')} AS long_dup_share FROM (SELECT app, content, row_number() OVER (PARTITION BY app, lower(content) ORDER BY review_id) AS rn FROM {{texts}}) AS t GROUP BY app"
SQL["dup_top_texts"] = "SELECT app, h, n, rn FROM (SELECT app, h, n, row_number() OVER (PARTITION BY app ORDER BY n DESC, h) AS rn FROM (SELECT app, md5(lower(coalesce(content, ''))) AS h, count(*) AS n FROM {texts} GROUP BY app, md5(lower(coalesce(content, '')))) AS c) AS t WHERE rn <= 5"
DUCK["dup_top_texts"] = "WITH c AS (SELECT app, md5(any_value(lower(content))) AS h, count(*) AS n FROM {texts} GROUP BY app, lower(content)), r AS (SELECT a.app, a.h, a.n, 1 + count(b.h) AS rn FROM c a LEFT JOIN c b ON a.app = b.app AND (b.n > a.n OR b.n = a.n AND b.h < a.h) GROUP BY a.app, a.h, a.n) SELECT * FROM r WHERE rn <= 5"
SQL["pool_report"] = "SELECT app, count(*) AS n, count_if(g = 1) AS in_pool, " + ", ".join(f"count_if(g = 1 AND q = {q}) AS q{q}" for q in (0, 1)) + ", count_if(g > 1 AND a = 1) AS only_global FROM (SELECT app, quality AS q, row_number() OVER (PARTITION BY sha2(lower(content), 256) ORDER BY review_id) AS g, row_number() OVER (PARTITION BY app, sha2(lower(content), 256) ORDER BY review_id) AS a FROM {docs}) AS t GROUP BY app"
DUCK["pool_report"] = SQL["pool_report"].replace("sha2(lower(content), 256)", "lower(content)")
SQL["version_summary"] = f"SELECT app, {DIV('count_if(version IS NULL)', 'count(*)')} AS null_share, count(DISTINCT version) AS n_versions FROM {{reviews}} GROUP BY app"
SQL["version_top"] = "SELECT app, version, n, rn FROM (SELECT app, version, count(*) AS n, row_number() OVER (PARTITION BY app ORDER BY count(*) DESC, version) AS rn FROM {reviews} WHERE version IS NOT NULL GROUP BY app, version) AS t WHERE rn <= 5"
SQL["ingest_summary"] = f"SELECT app, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT version) AS n_versions, round({DIV('count_if(version IS NULL)', 'count(*)')}, 4) AS null_version_share, " + ", ".join(f"count_if(score = {s}) AS s{s}" for s in range(1, 6)) + " FROM {reviews} GROUP BY app"
_SPINE = """
WITH counted AS (SELECT app, week, count(*) AS n FROM {reviews} WHERE topic <> 3 AND NOT (app = 'app1' AND week = DATE '2024-01-15') GROUP BY app, week),
bounds AS (SELECT app, min(week) AS a, max(week) AS b FROM counted GROUP BY app),
spine AS (SELECT app, a, b, explode(sequence(a, b, INTERVAL 7 DAYS)) AS week FROM bounds),
full_weeks AS (SELECT s.app, s.week, coalesce(c.n, 0) AS n FROM spine s LEFT JOIN counted c ON c.app = s.app AND c.week = s.week WHERE s.week > s.a AND s.week < s.b)
"""
_SPINE_DUCK = """
WITH kept AS (SELECT app, week FROM {reviews} WHERE topic <> 3 AND NOT (app = 'app1' AND week = DATE '2024-01-15')),
mondays AS (SELECT DISTINCT CAST(unnest(generate_series(TIMESTAMP '2000-01-03', TIMESTAMP '2040-01-02', INTERVAL 7 DAYS)) AS DATE) AS week),
full_weeks AS (SELECT e.app, m.week, (SELECT count(*) FROM kept k WHERE k.app = e.app AND k.week = m.week) AS n FROM (SELECT app, min(week) AS a, max(week) AS b FROM kept GROUP BY app) e JOIN mondays m ON m.week > e.a AND m.week < e.b)
"""
for _name, _tail in (
    ("weekly_spine", "SELECT app, CAST(week AS STRING) AS week, n FROM full_weeks"),
    ("weekly_stats", "SELECT app, count(*) AS full_weeks, min(n) AS least, CAST(median(n) AS DOUBLE) AS middle, max(n) AS most FROM full_weeks GROUP BY app"),
):
    SQL[_name], DUCK[_name] = _SPINE + _tail, _SPINE_DUCK + _tail
SQL["hidden_weekly"] = f"SELECT app, CAST(week AS STRING) AS week, partial, n, k, {DIV('k', 'n')} AS share, {LOW} AS lo, {HIGH} AS hi FROM (SELECT app, week, max(is_partial_week) AS partial, count(*) AS n, count_if(pred_label = 'negative') AS k FROM {{reviews}} WHERE score >= 4 AND (NOT is_partial_week OR week = {SHOWN}) GROUP BY app, week) AS t"
SQL["topic_weekly"] = f"""
WITH base AS (SELECT app, topic, week FROM {{reviews}} WHERE is_complaint AND NOT is_partial_week),
top AS (SELECT app, topic FROM (SELECT app, topic, row_number() OVER (PARTITION BY app ORDER BY count(*) DESC, topic) AS rn FROM base WHERE topic <> -1 GROUP BY app, topic) AS t WHERE rn <= 3),
weeks AS (SELECT app, week, count(*) AS n FROM base GROUP BY app, week),
hits AS (SELECT app, topic, week, count(*) AS k FROM base GROUP BY app, topic, week)
SELECT t.app, t.topic, CAST(w.week AS STRING) AS week, w.n, coalesce(h.k, 0) AS k, {DIV('coalesce(h.k, 0)', 'w.n')} AS share FROM top t JOIN weeks w ON t.app = w.app LEFT JOIN hits h ON h.app = t.app AND h.topic = t.topic AND h.week = w.week"""
SQL["version_share"] = f"""
WITH base AS (SELECT app, version, is_complaint, CAST(day AS STRING) IN ('2024-01-10', '2024-01-18') AS peak FROM {{reviews}} WHERE version IS NOT NULL),
agg AS (SELECT app, version, count(*) AS n, count_if(is_complaint) AS k, count_if(peak) AS n_peak, count_if(peak AND is_complaint) AS k_peak FROM base GROUP BY app, version)
SELECT app, version, n, k, {LOW} AS lo, {HIGH} AS hi, {DIV('k', 'n')} AS share, {DIV('k_peak', 'n_peak')} AS share_peak, {DIV('k - k_peak', 'n - n_peak')} AS share_rest FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY n DESC, version) AS rn FROM agg) AS t WHERE rn <= 5"""

SQL["crosstab_cube"] = "WITH c AS (SELECT CASE WHEN grouping(app) = 1 THEN 'all' ELSE app END AS app, CASE WHEN grouping(topic) = 1 THEN 'all' ELSE CAST(topic AS STRING) END AS topic, count(*) AS n FROM {reviews} GROUP BY CUBE (app, topic)) SELECT a.app, t.topic, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT app FROM c) a CROSS JOIN (SELECT DISTINCT topic FROM c) t LEFT JOIN c ON c.app = a.app AND c.topic = t.topic"
DUCK["crosstab_cube"] = "WITH r AS (SELECT app, CAST(topic AS STRING) AS topic FROM {reviews}), a AS (SELECT DISTINCT app FROM r UNION SELECT 'all'), t AS (SELECT DISTINCT topic FROM r UNION SELECT 'all') SELECT a.app, t.topic, (SELECT count(*) FROM r WHERE (a.app = 'all' OR r.app = a.app) AND (t.topic = 'all' OR r.topic = t.topic)) AS n FROM a CROSS JOIN t"
SQL["pivot_by_star"] = "SELECT app, " + ", ".join(f"count_if(score = {s}) AS star_{s}" for s in range(1, 6)) + " FROM {reviews} GROUP BY app"
SQL["value_share"] = f"SELECT pred_label, count(*) AS n, {DIV('count(*)', 'sum(count(*)) OVER ()')} AS share FROM {{reviews}} GROUP BY pred_label"
SQL["len_percentiles"] = "SELECT app, percentile(n_chars, 0.5) AS p50, percentile(n_chars, 0.9) AS p90, percentile(n_chars, 0.99) AS p99 FROM {texts} GROUP BY app"
DUCK["len_percentiles"] = SQL["len_percentiles"].replace("percentile(", "quantile_cont(")
SQL["len_above"] = f"SELECT app, count_if(n_chars > 1000) AS above_1000, {DIV('count_if(n_chars > 5000)', 'count(*)')} AS share_5000 FROM {{texts}} GROUP BY app"
SQL["weighted_share"] = f"SELECT app, {DIV('sum(CASE WHEN gold = weak_label THEN weight_units ELSE 0 END)', 'sum(weight_units)')} AS share FROM {{labeled}} GROUP BY app"
SQL["confusion"] = "WITH spine AS (SELECT a.l AS gold, b.l AS pred FROM (VALUES ('negative'), ('neutral'), ('positive')) AS a(l) CROSS JOIN (VALUES ('negative'), ('neutral'), ('positive')) AS b(l)), c AS (SELECT gold, pred_label AS pred, CAST(sum(weight_units) AS BIGINT) AS w FROM {labeled} GROUP BY gold, pred_label) SELECT s.gold, s.pred, coalesce(w, 0) AS w, coalesce(CAST(coalesce(w, 0) AS DOUBLE) / NULLIF(CAST(sum(coalesce(w, 0)) OVER (PARTITION BY s.gold) AS DOUBLE), 0e0), 0e0) AS row_share FROM spine s LEFT JOIN c ON s.gold = c.gold AND s.pred = c.pred"
_PRF = "SELECT label, coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0e0), 0e0) AS prec, coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0e0), 0e0) AS recall, coalesce(CAST(2 * tp AS DOUBLE) / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0e0), 0e0) AS f1 FROM (SELECT l.label, count_if(gold = label AND pred_label = label) AS tp, count_if(gold <> label AND pred_label = label) AS fp, count_if(gold = label AND pred_label <> label) AS fn FROM {labeled} CROSS JOIN (VALUES ('negative'), ('neutral'), ('positive')) AS l(label) GROUP BY l.label) AS t"
SQL["prf_metrics"] = _PRF
SQL["macro_f1"] = f"SELECT round(sum(f1) / 3e0, 9) AS macro_f1 FROM ({_PRF}) AS m"
_APP_F1 = "SELECT app, coalesce(CAST(2 * tp AS DOUBLE) / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0e0), 0e0) AS f1 FROM (SELECT app, count_if(gold = 'negative' AND pred_label = 'negative') AS tp, count_if(gold <> 'negative' AND pred_label = 'negative') AS fp, count_if(gold = 'negative' AND pred_label <> 'negative') AS fn FROM {labeled} GROUP BY app) AS t"
SQL["star_group_recall"] = f"SELECT CASE WHEN score <= 2 THEN '1-2' WHEN score = 3 THEN '3' ELSE '4-5' END AS stars, {DIV(chr(39).join(['count_if(gold = ', 'negative', ' AND pred_label = ', 'negative', ')']), chr(39).join(['count_if(gold = ', 'negative', ')']))} AS recall, {DIV(chr(39).join(['count_if(gold <> ', 'negative', ' AND pred_label = ', 'negative', ')']), chr(39).join(['count_if(gold <> ', 'negative', ')']))} AS false_alarm, {DIV(chr(39).join(['count_if(pred_label = ', 'negative', ')']), 'count(*)')} AS pred_neg_share FROM {{labeled}} GROUP BY 1"
_KAPPA = "WITH n AS (SELECT CAST(sum({w}) AS DOUBLE) AS n, CAST(sum(CASE WHEN gold = weak_label THEN {w} ELSE 0 END) AS DOUBLE) AS agree FROM {{labeled}}), m AS (SELECT sum(g * w) AS s FROM (SELECT CAST(sum(CASE WHEN gold = l THEN {w} ELSE 0 END) AS DOUBLE) AS g, CAST(sum(CASE WHEN weak_label = l THEN {w} ELSE 0 END) AS DOUBLE) AS w FROM {{labeled}} CROSS JOIN (VALUES ('negative'), ('neutral'), ('positive')) AS t(l) GROUP BY l) AS x) SELECT '{k}' AS kind, round((agree / n - s / (n * n)) / (1e0 - s / (n * n)), 9) AS kappa FROM n CROSS JOIN m".format
SQL["kappa"] = f"SELECT * FROM ({_KAPPA(w='1', k='raw')}) AS a UNION ALL SELECT * FROM ({_KAPPA(w='weight_units', k='weighted')}) AS b"
_CELLS = "SELECT gold AS g, weak_label AS w, CAST({x} AS DOUBLE) AS v FROM {{labeled}} GROUP BY gold, weak_label".format
_KAPPA_DUCK = "SELECT '{k}' AS kind, round((po - pe) / (1 - pe), 9) AS kappa FROM (SELECT (SELECT sum(v) FROM c WHERE g = w) / t AS po, (SELECT sum(a.s * b.s) FROM (SELECT g, sum(v) AS s FROM c GROUP BY g) a JOIN (SELECT w, sum(v) AS s FROM c GROUP BY w) b ON a.g = b.w) / (t * t) AS pe FROM (SELECT sum(v) AS t FROM c) AS u) AS q".format
DUCK["kappa"] = "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(f"WITH c AS ({_CELLS(x=x)}) {_KAPPA_DUCK(k=k)}" for x, k in (("count(*)", "raw"), ("sum(weight_units)", "weighted"))) + ")"
SQL["mismatch"] = f"SELECT score, {DIV('sum(CASE WHEN gold = ' + chr(39) + 'negative' + chr(39) + ' THEN weight_units ELSE 0 END)', 'sum(weight_units)')} AS negative_share FROM {{labeled}} WHERE score >= 4 GROUP BY score"
SQL["gold_by_star"] = f"SELECT score, gold, count(*) AS n, {DIV('sum(weight_units)', 'sum(sum(weight_units)) OVER (PARTITION BY score)')} AS w_share FROM {{labeled}} GROUP BY score, gold"
SQL["label_dist"] = f"SELECT app, gold, n, w, {DIV('n', 'sum(n) OVER (PARTITION BY app)')} AS share, {DIV('w', 'sum(w) OVER (PARTITION BY app)')} AS w_share FROM (SELECT {ROLL}, gold, count(*) AS n, CAST(sum(weight_units) AS BIGINT) AS w FROM {{labeled}} GROUP BY GROUPING SETS ((app, gold), (gold))) AS t"
_TAGS = "(SELECT review_id, source || ', ' || coalesce(CASE toxic WHEN 1 THEN 'Toxic' END, '') || ',' || app AS notes, quality FROM {docs})"
SQL["parse_tags"] = f"SELECT review_id, array_join(filter(transform(split(notes, ','), x -> lower(trim(x))), x -> x <> ''), '|') AS tags FROM {_TAGS} AS t"
DUCK["parse_tags"] = f"SELECT review_id, array_to_string(list_filter(list_transform(string_split(notes, ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS tags FROM {_TAGS} AS t"
_VOCABULARY = "(VALUES ('web'), ('toxic'), ('en'), ('de'), ('fr'), ('es'), ('sarcasm')) AS v(word)"
SQL["tag_counts"] = f"SELECT coalesce(tag, word) AS tag, count(tag) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS n_good FROM {_VOCABULARY} FULL JOIN (SELECT quality, explode(filter(transform(split(notes, ','), x -> lower(trim(x))), x -> x <> '')) AS tag FROM {_TAGS} AS t) AS e ON tag = word GROUP BY coalesce(tag, word)"
DUCK["tag_counts"] = f"SELECT coalesce(tag, word) AS tag, count(tag) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS n_good FROM {_VOCABULARY} FULL JOIN (SELECT quality, unnest(list_filter(list_transform(string_split(notes, ','), lambda x: lower(trim(x))), lambda x: x <> '')) AS tag FROM {_TAGS} AS t) AS e ON tag = word GROUP BY coalesce(tag, word)"
SQL["overlap_cells"] = "SELECT app, weak_label = 'negative' AS by_star, pred_label = 'negative' AS by_model, count(*) AS n FROM {labeled} WHERE score >= 4 AND gold = 'negative' GROUP BY app, weak_label = 'negative', pred_label = 'negative'"
_OPTIONS = "(VALUES ('star'), ('model'), ('either')) AS o(opt)"
_FLAGS = "CASE opt WHEN 'star' THEN score <= 2 WHEN 'model' THEN pred_label = 'negative' ELSE score <= 2 OR pred_label = 'negative' END"
SQL["star45_options"] = f"SELECT opt, app, count_if(hit) AS caught, count_if(NOT hit) AS missed FROM (SELECT opt, app, {_FLAGS} AS hit FROM {{labeled}} CROSS JOIN {_OPTIONS} WHERE score >= 4 AND gold = 'negative') AS t GROUP BY opt, app"
SQL["app_f1"] = _APP_F1
_OVER = "WITH c AS (SELECT topic, app, count(*) AS n FROM {reviews} WHERE is_complaint AND topic <> -1 GROUP BY topic, app), s AS (SELECT topic, app, n, sum(n) OVER (PARTITION BY app) AS app_n, sum(n) OVER (PARTITION BY topic) AS topic_n, sum(n) OVER () AS all_n FROM c)"
SQL["overrep_loo"] = f"{_OVER} SELECT * FROM (SELECT app, topic, n, ratio, row_number() OVER (PARTITION BY app ORDER BY ratio DESC, topic) AS place FROM (SELECT app, topic, n, CASE WHEN topic_n = n THEN CAST('Infinity' AS DOUBLE) ELSE (CAST(n AS DOUBLE) / CAST(app_n AS DOUBLE)) / (CAST(topic_n - n AS DOUBLE) / NULLIF(CAST(all_n - app_n AS DOUBLE), 0e0)) END AS ratio FROM s) AS r WHERE n >= 5) AS p WHERE place <= 3"
SQL["overrep_pooled"] = f"{_OVER} SELECT * FROM (SELECT app, topic, n, ratio, row_number() OVER (PARTITION BY app ORDER BY ratio DESC, topic) AS place FROM (SELECT app, topic, n, (CAST(n AS DOUBLE) / CAST(app_n AS DOUBLE)) / (CAST(topic_n AS DOUBLE) / CAST(all_n AS DOUBLE)) AS ratio FROM s) AS r WHERE n >= 5) AS p WHERE place <= 3"
SQL["app_profile"] = f"SELECT topic, app AS dominant, n, {DIV('n', 'total')} AS share, CAST(n AS DOUBLE) >= 0.8e0 * CAST(total AS DOUBLE) AS single FROM (SELECT topic, app, count(*) AS n, sum(count(*)) OVER (PARTITION BY topic) AS total, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, app) AS rn FROM {{reviews}} GROUP BY topic, app) AS t WHERE rn = 1"
SQL["bucket_shares"] = f"SELECT {ROLL}, {DIV('count_if(topic = -1)', 'count(*)')} AS outliers, {DIV('count_if(topic = 0)', 'count(*)')} AS unspecified FROM {{reviews}} WHERE is_complaint GROUP BY GROUPING SETS ((app), ())"
_GAPS = "(VALUES ('waste', '{a}(?:worthless|trash){z}'), ('terms', '{a}(?:license|licensed|copyright){z}'), ('names', '{a}(?:the|la|der){z}')) AS g(gap, pattern)".format
_GAP_TOP = "SELECT gap, CAST(docs AS BIGINT) AS docs, source, n, place, CAST(max(n) OVER (PARTITION BY gap) AS DOUBLE) / CAST(docs AS DOUBLE) AS share_in_top FROM (SELECT gap, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY gap) AS docs, row_number() OVER (PARTITION BY gap ORDER BY count(*) DESC, source) AS place FROM {{texts}} JOIN {g} ON {m} GROUP BY gap, source) AS t WHERE place <= 6".format
#: Whole words, as Unicode has them.
SQL["gap_check"] = _GAP_TOP(g=_GAPS(a=r"(?U)\\b", z=r"\\b"), m="lower(content) RLIKE pattern")
DUCK["gap_check"] = _GAP_TOP(g=_GAPS(a=r"(?:^|[^\p{L}\p{N}_])", z=r"(?:$|[^\p{L}\p{N}_])"), m="regexp_matches(lower(content), pattern)")
SQL["fit_shares"] = f"SELECT opt, k, n, {DIV('k', 'n')} AS share, {LOW} AS lo, {HIGH} AS hi FROM (SELECT o.opt, count_if(f.fits = o.opt) AS k, count(*) AS n FROM (SELECT CASE review_id % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'partly' ELSE 'yes' END AS fits FROM {{reviews}} WHERE is_complaint) f CROSS JOIN (VALUES ('yes'), ('partly'), ('no')) AS o(opt) GROUP BY o.opt) AS t"
SQL["poststratified"] = f"WITH cells AS (SELECT app, weak_label, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(gold = 'negative') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS m FROM {_SAMPLE} AS s GROUP BY app, weak_label), pop AS (SELECT app, weak_label, CAST(count(*) AS DOUBLE) AS w FROM {{labeled}} GROUP BY app, weak_label) SELECT round(sum(w * m) / sum(w), 9) AS share FROM cells JOIN pop ON cells.app = pop.app AND cells.weak_label = pop.weak_label"
SQL["cluster_summary"] = f"SELECT count_if(topic <> -1) AS n_topics, max(CASE WHEN topic <> -1 THEN n END) AS largest, min(CASE WHEN topic <> -1 THEN n END) AS smallest, {DIV('sum(CASE WHEN topic = -1 THEN n ELSE 0 END)', 'sum(n)')} AS outlier_share FROM (SELECT topic, count(*) AS n FROM {{vectors}} GROUP BY topic) AS t"
SQL["class_weights"] = "SELECT gold, n, CAST(total AS DOUBLE) / (3e0 * CAST(n AS DOUBLE)) AS balanced, sqrt(CAST(total AS DOUBLE) / (3e0 * CAST(n AS DOUBLE))) AS softened FROM (SELECT gold, count(*) AS n, sum(count(*)) OVER () AS total FROM {labeled} GROUP BY gold) AS t"
SQL["majority"] = "SELECT app, gold FROM (SELECT app, gold, row_number() OVER (PARTITION BY app ORDER BY count(*) DESC, gold) AS rn FROM {labeled} GROUP BY app, gold) AS t WHERE rn = 1"
SQL["rollup_bonus"] = "SELECT app, score, count(*) AS n FROM {reviews} GROUP BY ROLLUP (app, score)"

# ---- windows and samples
SQL["dup_flag_app"] = "WITH d AS (SELECT review_id, app, md5(lower(coalesce(content, ''))) AS h FROM {texts}), f AS (SELECT app, h, min(review_id) AS first FROM d GROUP BY app, h) SELECT review_id, review_id > first AS is_dup_text FROM d JOIN f ON f.app = d.app AND f.h = d.h"
DUCK["dup_flag_app"] = "SELECT review_id, row_number() OVER (PARTITION BY app, lower(content) ORDER BY review_id) > 1 AS is_dup_text FROM {texts}"
SQL["dup_flag_global"] = "WITH d AS (SELECT review_id, app, md5(lower(coalesce(content, ''))) AS h FROM {texts}), f AS (SELECT h, min(review_id) AS first FROM d GROUP BY h) SELECT review_id, review_id > first AS is_dup_text_global FROM d JOIN f ON f.h = d.h"
DUCK["dup_flag_global"] = "SELECT review_id, row_number() OVER (PARTITION BY lower(content) ORDER BY review_id) > 1 AS is_dup_text_global FROM {texts}"
SQL["model_pool"] = "SELECT min(review_id) AS review_id, min_by(app, review_id) AS app FROM {texts} GROUP BY md5(lower(coalesce(content, '')))"
DUCK["model_pool"] = "SELECT review_id, app FROM (SELECT review_id, app, row_number() OVER (PARTITION BY lower(content) ORDER BY review_id) AS rn FROM {texts}) AS t WHERE rn = 1"
SQL["one_per_text"] = "SELECT review_id, app, text_clean FROM (SELECT *, row_number() OVER (PARTITION BY text_clean ORDER BY ts, review_id) AS rn FROM {reviews}) AS t WHERE rn = 1"
SQL["topk_texts"] = "SELECT app, text_clean, n, rn FROM (SELECT app, text_clean, count(*) AS n, row_number() OVER (PARTITION BY app ORDER BY count(*) DESC, text_clean) AS rn FROM {reviews} GROUP BY app, text_clean) AS t WHERE rn <= 5"
#: Numbered within classes of the order, with what stands before each class added: no task sees all rows.
SQL["assign_ids"] = f"WITH k AS (SELECT review_id, {rnd(11)} AS o FROM {{docs}} WHERE quality IS NOT NULL), b AS (SELECT substr(o, 1, 3) AS class, count(*) AS n FROM k GROUP BY substr(o, 1, 3)), f AS (SELECT class, sum(n) OVER (ORDER BY class) - n AS before FROM b) SELECT 'G' || lpad(CAST(before + row_number() OVER (PARTITION BY class ORDER BY o, review_id) AS STRING), 5, '0') AS gold_id, review_id FROM k JOIN f ON class = substr(o, 1, 3)"
DUCK["assign_ids"] = f"SELECT 'G' || lpad(CAST(row_number() OVER (ORDER BY {rnd(11)}, review_id) AS STRING), 5, '0') AS gold_id, review_id FROM {{docs}} WHERE quality IS NOT NULL"
SQL["stratified_sample"] = f"SELECT review_id, app, weak_label FROM ({_RANKED}) AS t WHERE rn <= 50"
SQL["gold_reserve"] = f"SELECT review_id, app, weak_label, CASE WHEN rn <= 40 THEN 'gold' ELSE 'reserve' END AS part FROM ({_RANKED}) AS t WHERE rn <= 60"
SQL["roundrobin_errors"] = f"WITH e AS (SELECT review_id, gold || '>' || pred_label AS kind FROM {{labeled}} WHERE gold <> pred_label), r AS (SELECT review_id, kind, row_number() OVER (PARTITION BY kind ORDER BY {rnd(3)}, review_id) AS rn, count(*) OVER (PARTITION BY kind) AS size FROM e) SELECT review_id, kind, rn FROM r ORDER BY rn, size, kind LIMIT 40"
_ALLOC = "WITH c AS (SELECT app, count(*) AS n FROM {labeled} GROUP BY app), q AS (SELECT app, n, 1000 * n // (sum(n) OVER ()) AS base, (1000 * n) % (sum(n) OVER ()) AS rest FROM c), a AS (SELECT app, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, app) <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM q)"
_ALLOC_SPARK = _ALLOC.replace("1000 * n // (sum(n) OVER ())", "(1000 * n) DIV (sum(n) OVER ())")
SQL["allocate_prop"], DUCK["allocate_prop"] = (f"{a} SELECT app, n, alloc FROM a" for a in (_ALLOC_SPARK, _ALLOC))
SQL["downsample_week"], DUCK["downsample_week"] = (f"{a}, r AS (SELECT review_id, app, row_number() OVER (PARTITION BY app ORDER BY {rnd(5)}, review_id) AS rn FROM {{labeled}}) SELECT r.review_id, r.app FROM r JOIN a ON r.app = a.app WHERE rn <= alloc" for a in (_ALLOC_SPARK, _ALLOC))
SQL["split_train_val"] = f"SELECT review_id, CASE WHEN rn * 10 <= n THEN 'val' ELSE 'train' END AS part FROM ({_RANKED}) AS t"
SQL["smoke_sample"] = f"SELECT review_id, app FROM {{reviews}} ORDER BY {rnd(1)}, review_id LIMIT 200"

# ---- sorts and sets
SQL["sort_reviews"] = "SELECT review_id, app, row_number() OVER (PARTITION BY app ORDER BY ts, review_id) AS place FROM {reviews}"
SQL["topk_topics"] = "SELECT topic, count(*) AS n FROM {reviews} WHERE topic <> -1 GROUP BY topic ORDER BY n DESC, topic LIMIT 4"
SQL["union_all"] = "SELECT review_id, 'weak' AS kind, weak_label AS label FROM {labeled} UNION ALL SELECT review_id, 'gold' AS kind, gold AS label FROM {labeled}"
SQL["union_keys"] = "SELECT doc_id FROM {labels} UNION SELECT doc_id FROM {documents} WHERE n_chars < 500"
_SETS = "s AS (SELECT doc_id, 'labeled' AS part FROM {labels} UNION ALL SELECT doc_id, 'short' AS part FROM {documents} WHERE n_chars < 500 UNION ALL SELECT doc_id, 'english' AS part FROM {documents} WHERE lang = 'en' UNION ALL SELECT doc_id, 'french' AS part FROM {documents} WHERE lang = 'fr')"
SQL["pairwise_overlap"] = f"WITH {_SETS}, names AS (SELECT explode(array('labeled', 'short', 'english', 'french')) AS part), c AS (SELECT a.part AS a, b.part AS b, count(*) AS shared FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.part < b.part GROUP BY a.part, b.part) SELECT p.part AS a, q.part AS b, coalesce(shared, 0) AS shared FROM names p JOIN names q ON p.part < q.part LEFT JOIN c ON c.a = p.part AND c.b = q.part"
DUCK["pairwise_overlap"] = f"WITH {_SETS}, names AS (SELECT unnest(['labeled', 'short', 'english', 'french']) AS part) SELECT p.part AS a, q.part AS b, (SELECT count(*) FROM s x SEMI JOIN (SELECT doc_id FROM s WHERE part = q.part) y ON x.doc_id = y.doc_id WHERE x.part = p.part) AS shared FROM names p JOIN names q ON p.part < q.part"
SQL["except_ids"] = "SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}"
SQL["intersect_ids"] = "SELECT doc_id FROM {documents} WHERE lang = 'fr' INTERSECT SELECT doc_id FROM {labels}"
SQL["distinct_text"] = "SELECT DISTINCT text_clean FROM {reviews}"

# ---- scalar functions
SQL["week_start"] = "SELECT review_id, CAST(week AS STRING) AS week, CAST(day AS STRING) AS day FROM {reviews}"
SQL["partial_week_check"] = "SELECT CAST(week AS STRING) AS week, count(DISTINCT day) < 7 AS looks_partial, max(CASE WHEN is_partial_week THEN 1 ELSE 0 END) = 1 AS configured FROM {reviews} GROUP BY week"
SQL["wilson"] = f"SELECT k, n, {LOW} AS lo, {HIGH} AS hi FROM (SELECT count_if(is_complaint) AS k, count(*) AS n FROM {{reviews}} GROUP BY user_id) AS t"
#: The value of a rank: its class of equal widths is found from counts, and only that class is sorted.
SQL["calibrate_threshold"] = """
WITH v AS (SELECT review_id, value FROM {reviews} WHERE value IS NOT NULL),
r AS (SELECT min(value) AS lo, nullif(max(value) - min(value), 0e0) AS width, (count(*) + 9) DIV 10 AS target FROM v),
k AS (SELECT review_id, value, target, coalesce(CAST(floor((value - lo) / width * 1000) AS INT), 0) AS class FROM v CROSS JOIN r),
c AS (SELECT class AS c, n, sum(n) OVER (ORDER BY class) - n AS before FROM (SELECT class, count(*) AS n FROM k GROUP BY class) AS h),
p AS (SELECT c, before FROM c CROSS JOIN r WHERE before < target AND before + n >= target)
SELECT value + 1e-9 AS threshold FROM (SELECT value, target, before + row_number() OVER (ORDER BY value, review_id) AS rn FROM k JOIN p ON class = c) AS t WHERE rn = target"""
DUCK["calibrate_threshold"] = "SELECT value + 1e-9 AS threshold FROM (SELECT value, row_number() OVER (ORDER BY value, review_id) AS rn, count(*) OVER () AS n FROM {reviews} WHERE value IS NOT NULL) AS t WHERE rn = (n + 9) // 10"

# ---- topics and contracts
SQL["apply_merges"] = "WITH m AS (SELECT review_id, CASE topic WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE topic END AS merged FROM {reviews} WHERE is_complaint), z AS (SELECT merged, row_number() OVER (ORDER BY count(*) DESC, merged) - 1 AS renumbered FROM m WHERE merged <> -1 GROUP BY merged) SELECT m.review_id, CAST(coalesce(z.renumbered, -1) AS BIGINT) AS topic FROM m LEFT JOIN z ON m.merged = z.merged"
SQL["check_final"] = f"WITH s AS (SELECT review_id, app, weak_label FROM ({_RANKED}) AS t WHERE rn <= 40) SELECT app, weak_label, count(*) AS n, count(*) <> 40 AS unbalanced, count(*) <> count(DISTINCT review_id) AS repeated FROM s GROUP BY app, weak_label"
SQL["key_unique"] = "SELECT 'labels' AS part, count(*) - count(DISTINCT doc_id) AS repeats FROM {labels} UNION ALL SELECT 'documents', count(*) - count(DISTINCT doc_id) FROM {documents}"
SQL["row_conservation"] = "SELECT a.n AS before, b.n AS after, a.n = b.n AS kept FROM (SELECT count(*) AS n FROM {documents}) a CROSS JOIN (SELECT count(*) AS n FROM {docs}) b"
SQL["decision_rule"] = f"SELECT {DIV('count_if(review_id % 2 = 0 AND topic = 1)', 'count_if(topic = 1)')} > 0.45e0 AS adopt FROM {{reviews}}"
QUERIES = {name: partial(run, name) for name in SQL}
ORACLES = {name: duck(DUCK.get(name, sql)) for name, sql in SQL.items()}
