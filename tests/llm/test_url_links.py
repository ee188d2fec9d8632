"""Which links of a page make aliases, in Spark and in its SQL."""

import html as html_library

import duckdb
from pyspark.sql import functions as F

from tidemark.llm.url_filter import OP5_SQL, decode_references, op5_url_filter

LINK = '<link rel="canonical" href="{}">'
BLOCKED = "http://a.net/es/x?a=1&b=2"
PAGES = [
    (1, BLOCKED, None),
    (2, "http://b.org/2", LINK.format("http://a.net/es/x?a=1&amp;b=2")),
    (3, "http://b.org/3", "<!--" + LINK.format(BLOCKED) + "-->"),
    (4, "http://b.org/4", "<!-- open " + LINK.format(BLOCKED)),
    (5, "http://b.org/5", "<!--> <!-- \n --> " + LINK.format("http://a.net/es&#x2F;x") + "<!-- x --!>"),
    (6, "http://a.net/6", LINK.format("&#47;es/&#0000120;?q=&#1114112;&#xD800;&nope;")),
    (7, "http://b.org/7", '<meta http-equiv="refresh" content="0; url=http://a.net/fr/&#8364;">'),
    (8, "http://b.org/8", "<!-- a --><LINK href='http://a.net/fr/1' rel='canonical'><!-- b -->"),
    (9, "http://b.org/9", "<!---->" + LINK.format("http://a.net/fr/&amp;amp;") + "<!--"),
    (10, "http://b.org/&amp;", ""),
    (11, None, LINK.format(BLOCKED)),
]
VERDICTS = {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "block", 9: "block", 10: "allow", 11: "allow"}


def test_links_of_comments_and_references(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    found = {tuple(r) for r in op5_url_filter(spark, folder).collect()}
    assert {r[0]: r[4] for r in found} == VERDICTS
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    assert set(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP5_SQL})").fetchall()) == found


def test_references(spark):
    texts = ["", "a", "&", "&amp;", "&amp;amp;", "&#38;&#x26;&#X26;", "a&lt;b&gt;c&quot;d&apos;e", "&#8364;&#x1F600;", "&#0;&#55296;&#1114112;", "&nope;&amp", "&#99999999;", "&amp;&amp;x&amp;", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode_references(F.col("t")).alias("d")).collect()
    unread = {"&#0;&#55296;&#1114112;", "&nope;&amp", "&#99999999;"}
    for r in rows:
        assert r.d == (r.t if r.t is None or r.t in unread else html_library.unescape(r.t)), r.t
