"""Review-shaped views of the driver's tables, as SQL that Spark and DuckDB both read (one function aside)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

REVIEWS = """
SELECT event_id AS review_id, 'app' || CAST(user_id % 4 AS STRING) AS app, user_id, CAST(1 + k % 5 AS INT) AS score, ts,
       event_type || ' ' || CAST(k % 50 AS STRING) AS text_clean, value,
       CASE event_type WHEN 'error' THEN 'negative' WHEN 'view' THEN 'neutral' ELSE 'positive' END AS pred_label,
       k % 5 <= 1 OR event_type = 'error' AS is_complaint, CAST(k % 9 - 1 AS INT) AS topic,
       CASE WHEN k % 10 <> 0 THEN CAST(user_id % 3 AS STRING) || '.' || CAST(k % 4 AS STRING) || '.0' END AS version,
       CAST(date_trunc('week', ts) AS DATE) AS week, CAST(ts AS DATE) AS day,
       CAST(date_trunc('week', ts) AS DATE) = DATE '2024-01-29' AS is_partial_week
FROM (SELECT *, CAST({json} AS BIGINT) AS k FROM {events}) AS parsed
"""
LABELED = """
SELECT o_orderkey AS review_id, c_mktsegment AS app, CAST(substr(o_orderpriority, 1, 1) AS INT) AS score, o_orderdate AS ts,
       CASE o_orderstatus WHEN 'F' THEN 'negative' WHEN 'O' THEN 'neutral' ELSE 'positive' END AS gold,
       CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) <= 2 THEN 'negative' WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) = 3 THEN 'neutral' ELSE 'positive' END AS weak_label,
       CASE WHEN o_orderkey % 5 < 3 THEN CASE o_orderstatus WHEN 'F' THEN 'negative' WHEN 'O' THEN 'neutral' ELSE 'positive' END
            WHEN o_orderkey % 5 = 3 THEN 'negative' ELSE 'positive' END AS pred_label,
       CAST(floor(o_totalprice) AS BIGINT) % 97 AS weight_units
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
DOCS = """
SELECT documents.doc_id AS review_id, lang AS app, source, text AS content, n_chars, quality, toxic
FROM {documents} AS documents LEFT JOIN {labels} AS labels ON documents.doc_id = labels.doc_id
"""
#: The same without labels, for what doesn't read them.
TEXTS = """
SELECT doc_id AS review_id, lang AS app, source, text AS content, n_chars FROM {documents}
"""
VECTORS = """
SELECT vec_id AS review_id, embedding, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS topic FROM {embeddings}
"""
ALL = {"reviews": REVIEWS, "labeled": LABELED, "docs": DOCS, "texts": TEXTS, "vectors": VECTORS}
JSON = {"spark": "get_json_object(props, '$.k')", "duck": "json_extract_string(props, '$.k')"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or table by name."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = ALL[name].replace("{json}", JSON["spark"])
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def _count_if(sql: str) -> str:
    """DuckDB's count_if is a 128-bit integer; make it the 64-bit one that Spark has."""
    out, at = [], 0
    while (found := sql.find("count_if(", at)) >= 0:
        end, depth = found + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(f"{sql[at:found]}CAST({sql[found:end]} AS BIGINT)")
        at = end
    return "".join(out) + sql[at:]


def duck(sql: str) -> str:
    """The same query over DuckDB's views of the tables."""
    sql = _count_if(sql)
    used = [v for v in ALL if f"{{{v}}}" in sql]
    for v in used:
        sql = sql.replace(f"{{{v}}}", v)
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    heads = []
    for v in used:
        body = ALL[v].replace("{json}", JSON["duck"])
        for t in TABLES:
            body = body.replace(f"{{{t}}}", t)
        heads.append(f"{v} AS ({body})")
    if not heads:
        return sql
    body = sql.strip()
    return "WITH " + ", ".join(heads) + (", " + body[5:] if body[:5].upper() == "WITH " else " " + body)
