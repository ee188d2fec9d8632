"""URL rules with redirect equivalence, native DataFrame operations only.

Rules allow or block a host with its subdomains and a path prefix; the longest
rule that fits decides. Pages that redirect to each other or name each other as
canonical are one thing under several addresses: connected components over
those edges carry a block to addresses without a rule of their own. An explicit
allow takes precedence: it decides for its own page, and for all addresses of
its component that have no rule.

Defined results: a null url, or one without `://`, has empty host and path and
fits no rule; without edges to judged addresses the verdict is allow; repeated
rows are judged alike; an empty table gives an empty result. Only the columns
named are read, so others don't matter. Edge ends are compared as addresses:
host, path and query, without scheme and fragment. Links inside HTML comments
don't count, a comment that isn't closed runs to the page's end. In targets the
five basic named references and numeric ones are decoded, once; others, and
numbers of no character, stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import materialize

#: (verdict, host, path). Fixed values.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct (rule, verdict), or null. Length counts host, then path; allow wins a tie."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow"))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return F.coalesce(F.lit(None).cast("struct<rule: string, verdict: string>"), *[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered])


_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""

_COMMENT = r"(?s)<!--(?:-?>|.*?(?:--!?>|\z))"
_REFERENCE = r"&(?:amp|lt|gt|quot|apos|#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6});"
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def _character(reference: Column) -> Column:
    """What one reference stands for; itself if its number is no character's."""
    digits = F.regexp_extract(reference, "([0-9a-fA-F]+);", 1)
    code = F.when(F.lower(reference).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    out = F.when(reference.startswith("&#"), F.coalesce(F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")), reference))
    for name, character in _NAMED.items():
        out = out.when(reference == name, F.lit(character))
    return out


def decode_references(text: Column) -> Column:
    """Text with its character references decoded, each once."""
    between, found = F.split(text, _REFERENCE, -1), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(_character(b), F.lit("")))), "")).otherwise(text)


def resolve(target: Column, host: Column, path: Column) -> Column:
    """The absolute form of a link's target on a page; null for fragments. Dot segments stay as they are."""
    folder = F.coalesce(F.nullif(F.regexp_replace(path, "[^/]*$", ""), F.lit("")), F.lit("/"))
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(F.contains(target, F.lit("://")), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host, target))
        .when(target.startswith("?"), F.concat(F.lit("http://"), host, path, target))
        .otherwise(F.concat(F.lit("http://"), host, folder, target))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) addresses: from each page to the targets of all its canonical links and refresh redirects, relative ones resolved."""
    html, url = F.col(html_col), F.col(url_col)
    # Most pages have neither; a plain search is cheaper than the patterns.
    lowered = F.translate(html, _UPPER, _LOWER)
    named = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(x)) for x in ("canonical", "http-equiv")])
    shown = F.regexp_replace(html, _COMMENT, " ")
    found = F.concat(F.regexp_extract_all(shown, F.lit(_LINK), F.lit(1)), F.regexp_extract_all(shown, F.lit(_REFRESH), F.lit(1)))
    raw = pages.where(named).select(url.alias("src"), F.explode(found).alias("dst"))
    targets = raw.select("src", decode_references(F.col("dst")).alias("dst"))
    resolved = targets.select(address(F.col("src")).alias("src"), address(resolve(F.col("dst"), host_of(F.col("src")), path_of(F.col("src")))).alias("dst"))
    return resolved.where("src <> '' and dst <> ''")


def query_of(url: Column) -> Column:
    """From the first `?` up to `#` or the end, or nothing."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)^[^?#]*(\?[^#]*)", 1)), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query: pages that differ by their query alone are different pages."""
    return F.concat(host_of(url), path_of(url), query_of(url))


def judge_urls(pages: DataFrame, edges: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, by (rule, alias or default) of each page; `edges` has src and dst addresses."""
    url = F.col(url_col)
    judged = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("address"))
    judged = judged.select("*", match_rule(F.col("host"), F.col("path"), rules).alias("own"))
    edges = materialize(edges.select("src", "dst").where("src != '' and dst != ''"), "url-edges")
    if edges.isEmpty():
        carried = judged.withColumn("carried", F.lit(None).cast("string"))
    else:
        groups = connected_components(edges)
        # Every address in a component is judged, whether it has a page or is only linked to.
        host, path = (F.regexp_extract("node", pattern, 1) for pattern in (r"(?s)^([^/?]*)", r"(?s)^[^/?]*([^?]*)"))
        verdicts = groups.withColumn("v", match_rule(host, path, rules)["verdict"]).where("v is not null")
        verdicts = verdicts.groupBy("component").agg(F.min("v").alias("carried"))  # allow sorts before block
        verdicts = groups.join(verdicts, "component").select("node", "carried")
        # Pages without an address are in no component; they aren't joined, so they are no key either.
        carried = judged.where("address <> ''").join(verdicts, F.col("address") == F.col("node"), "left")
        carried = carried.unionByName(judged.where("address = ''").withColumn("carried", F.lit(None).cast("string")), allowMissingColumns=True)
    return carried.select(
        id_col, "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "carried", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("carried").isNotNull(), "alias").otherwise("default").alias("by"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, alias_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


#: Aliases spread through the recursive part; on tables without links it is empty.
OP5_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, regexp_replace(html, '(?s)<!--(?:-?>|.*?(?:--!?>|\z))', ' ', 'g') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, html,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(rest, ''), '^[^?#]*(\?[^#]*)', 1) AS query
  FROM u
), rules(v, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), targets AS (
  SELECT host, path, host || path || query AS src, unnest(
    list_concat(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    list_concat(regexp_extract_all(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS raw
  FROM p
), pieces AS (
  SELECT host, path, src, string_split_regex(raw, '&(?:amp|lt|gt|quot|apos|#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6});') AS parts,
         [CASE r WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&apos;' THEN '''' ELSE
           coalesce([chr(CASE WHEN c BETWEEN 1 AND 55295 OR c BETWEEN 57344 AND 1114111 THEN c END) for c in [CASE WHEN lower(r) LIKE '&#x%' THEN CAST('0x' || regexp_extract(r, '([0-9a-fA-F]+);', 1) AS INT) WHEN r LIKE '&#%' THEN CAST(regexp_extract(r, '([0-9]+);', 1) AS INT) END]][1], r) END
          for r in regexp_extract_all(raw, '&(?:amp|lt|gt|quot|apos|#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6});')] AS found
  FROM targets
), decoded AS (SELECT host, path, src, array_to_string([parts[i] || coalesce(found[i], '') for i in range(1, len(parts) + 1)], '') AS raw FROM pieces
), whole AS (
  SELECT src, CASE WHEN raw = '' OR raw LIKE '#%' THEN NULL WHEN strpos(raw, '://') > 0 THEN raw WHEN raw LIKE '//%' THEN 'http:' || raw
                   WHEN raw LIKE '/%' THEN 'http://' || host || raw WHEN raw LIKE '?%' THEN 'http://' || host || path || raw
                   ELSE 'http://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || raw END AS t
  FROM decoded
), edges AS (
  SELECT src, translate(regexp_extract(substr(t, strpos(t, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
              || regexp_extract(substr(t, strpos(t, '://') + 3), '^[^/?#]*([^#]*)', 1) AS dst
  FROM whole WHERE t IS NOT NULL AND src <> ''
), both_ways AS (SELECT src AS a, dst AS b FROM edges WHERE dst <> '' UNION SELECT dst, src FROM edges WHERE dst <> ''
), reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), judged AS (
  SELECT n.b, arg_max(r.v, length(r.h || r.pre)) AS v
  FROM (SELECT DISTINCT b FROM reach) n
  JOIN rules r ON (regexp_extract(n.b, '^([^/?]*)', 1) = r.h OR regexp_extract(n.b, '^([^/?]*)', 1) LIKE '%.' || r.h)
              AND regexp_extract(n.b, '^[^/?]*([^?]*)', 1) LIKE r.pre || '%'
  GROUP BY n.b
), carried AS (SELECT reach.a, min(v) AS v FROM reach JOIN judged USING (b) GROUP BY reach.a
), own AS (
  SELECT page_id, arg_max(r.h || r.pre, length(r.h || r.pre)) AS rule, arg_max(r.v, length(r.h || r.pre)) AS v
  FROM p JOIN rules r ON (p.host = r.h OR p.host LIKE '%.' || r.h) AND p.path LIKE r.pre || '%'
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.v, carried.v, 'allow') AS verdict
FROM p LEFT JOIN own USING (page_id) LEFT JOIN carried ON carried.a = p.host || p.path || p.query AND carried.a <> ''
"""
