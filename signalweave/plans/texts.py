"""Text queries over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.functions import expressions as X
from signalweave.operators import text as T
from signalweave.registry import register, table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


@register("text_shape", r"""
SELECT doc_id AS id, len(string_split(text, chr(10)))::BIGINT AS lines, len(regexp_extract_all(text, '\S+'))::BIGINT AS words,
       len(list_filter(string_split(text, chr(10)), lambda x: x LIKE '#%'))::INT AS headings FROM documents""")
def text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.text_shape(docs(spark, sf_dir), k=10_000).withColumn("headings", F.size("headings"))


@register("delimited_shape", r"""
WITH l AS (SELECT doc_id AS id, text, split_part(text, chr(10), 1) AS f FROM documents),
c AS (SELECT *, len(f) - len(replace(f, ',', '')) AS n1, len(f) - len(replace(f, ';', '')) AS n2, len(f) - len(replace(f, chr(9), '')) AS n3 FROM l),
d AS (SELECT *, CASE WHEN n1 = 0 AND n2 = 0 AND n3 = 0 THEN NULL WHEN n1 >= n2 AND n1 >= n3 THEN ',' WHEN n2 >= n3 THEN ';' ELSE chr(9) END AS delimiter FROM c)
SELECT id, delimiter, coalesce(len(string_split(f, delimiter)), 1)::INT AS columns,
       greatest(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) - 1, 0)::BIGINT AS rows FROM d""")
def delimited_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.delimited_shape(docs(spark, sf_dir)).withColumn("columns", F.size("columns"))


@register("looks_generated", r"""
WITH l AS (SELECT doc_id AS id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents)
SELECT id, len(lines) > 0 AND list_sum(list_transform(lines, lambda x: len(x))) > 200 * len(lines) AS generated FROM l""")
def looks_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("id", X.looks_generated(F.col("text")).alias("generated"))


@register("script_shares", r"""
WITH c AS (SELECT doc_id AS id, len(regexp_extract_all(text, '[A-Za-z]'))::BIGINT AS latin, len(regexp_extract_all(text, '[а-яА-ЯёЁ]'))::BIGINT AS cyrillic FROM documents)
SELECT *, CASE WHEN latin + cyrillic = 0 THEN NULL WHEN cyrillic / (latin + cyrillic) >= 0.15 THEN 'ru' ELSE 'en' END AS language FROM c""")
def script_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.script_shares(docs(spark, sf_dir))


_LINK = T.LINK.replace("'", "''")
_LINKS = rf"""
WITH raw AS (
  SELECT page_id, {", ".join(f"unnest(regexp_extract_all(html, '{_LINK}', {i})) AS g{i}" for i in range(1, 5))} FROM pages),
all_links AS (
  SELECT page_id, trim(concat(g1, g2, g3)) AS target, trim(regexp_replace(lower(regexp_replace(g4, '<[^>]*>', '', 'g')), '\s+', ' ', 'g')) AS anchor FROM raw),
links AS (SELECT * FROM all_links WHERE target <> '' AND target NOT LIKE '#%')
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.page_links(table(spark, sf_dir, "pages"))


@register("page_links", _LINKS + "SELECT page_id, anchor, target FROM links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir)


@register("ambiguous_anchors", _LINKS + "SELECT anchor, count(DISTINCT target) AS targets FROM links WHERE anchor <> '' GROUP BY anchor HAVING count(DISTINCT target) >= 2")
def ambiguous_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ambiguous_anchors(links(spark, sf_dir))


@register("link_checks", _LINKS + """,
s AS (SELECT page_id, count(*) AS k FROM (SELECT page_id, anchor FROM links WHERE anchor <> '' GROUP BY ALL HAVING count(DISTINCT target) >= 2) GROUP BY page_id)
SELECT page_id, count(*) AS links, count(*) FILTER (anchor = '') AS empty_anchors, coalesce(max(k), 0) AS split_anchors FROM links LEFT JOIN s USING (page_id) GROUP BY page_id""")
def link_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.link_checks(links(spark, sf_dir))


_REFUSAL = T.REFUSAL.replace("'", "''").replace("(?i)", "(?i)")


@register("refusals", f"""
SELECT conv_id, turn, coalesce(len(text) > 0 AND len(text) <= 600 AND regexp_matches(text, '{_REFUSAL}'), false) AS refused
FROM conversations WHERE role = 'assistant'""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detect_refusals(table(spark, sf_dir, "conversations"))


@register("refusal_stats", f"""
SELECT count(*) AS replies, count(*) FILTER (len(text) > 0 AND len(text) <= 600 AND regexp_matches(text, '{_REFUSAL}')) AS refused
FROM conversations WHERE role = 'assistant'""")
def refusal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detect_refusals(table(spark, sf_dir, "conversations")).agg(F.count(F.lit(1)).alias("replies"), F.count_if("refused").alias("refused"))


_BLOCKS = r"""
WITH m AS (
  SELECT doc_id AS id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: rtrim(regexp_replace(regexp_replace(x, '"[^"\n]*"', 'S', 'g'), '\d+', 'N', 'g'))) AS lines FROM documents),
b AS (SELECT id, array_to_string(lines[s:s + 2], chr(10)) AS body FROM (SELECT id, lines, unnest(range(1, len(lines) - 1)) AS s FROM m WHERE len(lines) >= 3))
"""


@register("exact_clones", _BLOCKS + "SELECT sha1(body) AS hash, count(*) AS n, count(DISTINCT id) AS docs FROM b WHERE len(body) >= 80 GROUP BY ALL HAVING count(*) >= 2")
def exact_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exact_clones(T.line_blocks(docs(spark, sf_dir), 3))


_SIM = r"""
WITH t AS (
  SELECT doc_id AS id, unnest(list_transform(list_filter(string_split(regexp_replace(lower(text), '[^a-zа-яё0-9]+', ' ', 'g'), ' '), lambda x: len(x) >= 3), lambda x: x[1:5])) AS token FROM documents),
c AS (SELECT id, token, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT id, n, ('0x' || substr(sha1(token), 1, 8))::BIGINT AS hi, ('0x' || substr(sha1(token), 9, 8))::BIGINT AS lo FROM c),
v AS (SELECT id, bit, sum(CASE WHEN ((CASE WHEN bit >= 32 THEN hi ELSE lo END) >> (bit % 32)::INT) & 1 = 1 THEN n ELSE -n END) AS votes FROM k, range(0, 64) r(bit) GROUP BY ALL),
h AS (
  SELECT id, sum(CASE WHEN votes > 0 AND bit < 32 THEN 1::BIGINT << bit::INT ELSE 0 END)::BIGINT AS low,
         sum(CASE WHEN votes > 0 AND bit >= 32 THEN 1::BIGINT << (bit - 32)::INT ELSE 0 END)::BIGINT AS high FROM v GROUP BY id
  UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT id FROM t))
"""


@register("simhash64", _SIM + "SELECT id, low, high FROM h")
def simhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.simhash64(docs(spark, sf_dir))
    return h.select("id", F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned("hash", 32).alias("high"))


@register("near_clones", _SIM + """,
u AS (SELECT low, high, min(id) AS id FROM h GROUP BY ALL),
p AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.low, y.low)) + bit_count(xor(x.high, y.high)) AS distance FROM u x JOIN u y ON x.id < y.id)
SELECT a, b, distance::INT AS distance FROM p WHERE distance <= 4""")
def near_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.near_hashes(T.simhash64(docs(spark, sf_dir)))


_NEAR = _SIM + """,
u AS (SELECT low, high, min(id) AS id FROM h GROUP BY ALL),
p AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id < y.id WHERE bit_count(xor(x.low, y.low)) + bit_count(xor(x.high, y.high)) <= 4),
q AS (SELECT node, list(a) FILTER (a < node) AS early, row_number() OVER (ORDER BY node) AS k FROM (SELECT a, a AS node FROM p UNION SELECT a, b FROM p) GROUP BY node),
g(k, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT q.k, CASE WHEN list_has_any(kept, coalesce(early, [])) THEN kept ELSE list_append(kept, node) END FROM g JOIN q ON q.k = g.k + 1)
"""


@register("greedy_clones", _NEAR.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """
SELECT u.id, u.id NOT IN (SELECT node FROM q) OR list_contains((SELECT kept FROM g ORDER BY k DESC LIMIT 1), u.id) AS kept FROM u""")
def greedy_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts with different hashes, those that no earlier kept one is near to."""
    return T.greedy_hashes(T.simhash64(docs(spark, sf_dir)))


_POLICY = """
WITH p AS (
  SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages),
k AS (SELECT unnest(['host', 'blob:', 'data:', '''self''', '''unsafe-inline''']) AS kind),
q AS (SELECT page_id, host, CASE WHEN kind = 'host' THEN host ELSE kind END AS wanted FROM p CROSS JOIN k)
"""


@register("policy_checks", _POLICY + """
SELECT page_id, wanted, CASE page_id % 6
  WHEN 0 THEN wanted = host WHEN 1 THEN wanted = 'data:' OR (wanted = host AND host LIKE '%.example.com') WHEN 2 THEN false
  WHEN 3 THEN wanted = '''self''' WHEN 4 THEN wanted IN ('blob:', host) ELSE true END AS allowed FROM q""")
def policy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's host and four other sources may be used under a policy that goes by the page's number; most have no directive but default-src."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    of = lambda *names: F.array(*[F.lit(n) if isinstance(n, str) else n for n in names])
    lists = [of("https:"), of("https://*.example.com:443/a", "data:"), of("'none'", F.col("host")), of("'self'", "http://other.example.org"), of("blob:", F.upper("host"))]
    kind = F.col("page_id") % 6
    listed = F.lit(None).cast("array<string>")
    for i, names in reversed(list(enumerate(lists))):
        listed = F.when(kind == i, names).otherwise(listed)
    policy = F.when(listed.isNotNull(), F.create_map(F.lit("default-src"), listed)).otherwise(F.create_map(F.lit("img-src"), of("'none'")))
    asked = p.withColumn("policy", policy).select("page_id", "policy", F.explode(of(F.col("host"), "blob:", "data:", "'self'", "'unsafe-inline'")).alias("wanted"))
    return asked.select("page_id", "wanted", X.csp_allows(X.csp_values(F.col("policy"), F.lit("script-src")), F.col("wanted")).alias("allowed"))


@register("mixed_script_words", r"""
WITH p AS (SELECT doc_id AS id, regexp_replace(text, '`[^`]*`|https?://\S+|\S*/\S*', ' ', 'g') AS t FROM documents),
w AS (SELECT id, list_sort(list_distinct(list_filter(regexp_extract_all(t, '[A-Za-zа-яА-ЯёЁ]+'), lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[а-яА-ЯёЁ]')))) AS words FROM p)
SELECT id, array_to_string(words, ' ') AS words FROM w WHERE len(words) > 0""")
def mixed_script_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mixed_script_words(docs(spark, sf_dir)).select("id", F.array_join("words", " ").alias("words"))


#: Rules as they come from a reviewer, one of which is not safe to run.
RULES = [("licence", "(?i)license"), ("number", "[0-9]{3}[- ][0-9]{4}"), ("repeat", "(a+)+b"), ("signs", "###"), ("no", "xy")]


@register("rule_hits", "SELECT doc_id AS path, rule_id FROM documents JOIN (VALUES ('licence', '(?i)license'), ('number', '[0-9]{3}[- ][0-9]{4}'), ('signs', '###')) r(rule_id, pattern) ON regexp_matches(text, pattern)")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_id string, pattern string")
    return T.apply_rules(docs(spark, sf_dir).select(F.col("id").alias("path"), F.col("text").alias("content")), rules)
