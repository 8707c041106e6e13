"""Queries that match: tokens, names, prefixes, neighbours, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import url as U
from quarrylight.operators import match, order
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table

#: Token sets that are looked for in sentences of decisions.
TOKEN_SETS = {"ruling": ("ruling", "under"), "settled": ("agreed", "settle"), "complaint": ("upheld", "complaint"), "changes": ("ordered", "changes", "claims")}


def _patterns(spark):
    return spark.createDataFrame([(k, t) for k, ts in TOKEN_SETS.items() for t in ts], "pattern string, token string")


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(summary), '[^a-z0-9]+'), lambda x: x <> ''))"
_PATTERNS = "pat(pattern, token) AS (VALUES " + ", ".join(f"('{k}', '{t}')" for k, ts in TOKEN_SETS.items() for t in ts) + ")"
_HITS = f"""{_PATTERNS}, tok AS (SELECT row_id, unnest({_TOK}) AS token FROM enforcement_actions),
hit AS (SELECT row_id, pattern, count(*) AS hits FROM tok JOIN pat USING (token) GROUP BY ALL)"""


def _actions(spark, sf):
    return table(spark, sf, "enforcement_actions").select("row_id", T.words("summary").alias("tokens"))


@query(f"WITH {_HITS} SELECT row_id, pattern, hits FROM hit JOIN (SELECT pattern, count(*) AS need FROM pat GROUP BY pattern) USING (pattern) WHERE hits = need")
def token_set_all(spark, sf):
    return match.token_hits(_actions(spark, sf), "row_id", "tokens", _patterns(spark), "pattern", "token", True)


@query(f"WITH {_HITS} SELECT row_id, pattern, hits FROM hit")
def token_set_any(spark, sf):
    return match.token_hits(_actions(spark, sf), "row_id", "tokens", _patterns(spark), "pattern", "token", False)


@query("""SELECT row_id, first_phrase FROM (SELECT row_id, CASE WHEN contains(lower(offending_quote), 'never lose') THEN 'never lose' WHEN contains(lower(offending_quote), 'guaranteed results') THEN 'guaranteed results'
  WHEN contains(lower(offending_quote), 'no risk') THEN 'no risk' END AS first_phrase FROM enforcement_actions) WHERE first_phrase IS NOT NULL""")
def phrase_hit(spark, sf):
    low = F.lower("offending_quote")
    first = F.coalesce(*(F.when(low.contains(p), p) for p in ("never lose", "guaranteed results", "no risk")))
    return table(spark, sf, "enforcement_actions").select("row_id", first.alias("first_phrase")).where("first_phrase is not null")


_LEGAL = "('" + "', '".join(T.LEGAL_FORMS) + "')"
_NORM = f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({{0}}), '&', ' and ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +'), lambda x: x <> '' AND x NOT IN {_LEGAL}), ' ')"


@query(f"SELECT row_id, {_NORM.format('entity_name')} AS name FROM enforcement_actions")
def name_normalise(spark, sf):
    return table(spark, sf, "enforcement_actions").select("row_id", T.normal_name("entity_name").alias("name"))


@query("""SELECT row_id, regexp_replace(regexp_replace(translate(lower(entity_name), 'àáâäçèéêëìíîïñòóôöùúûü', 'aaaaceeeeiiiinoooouuuu'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  array_to_string(list_transform(list_filter(regexp_split_to_array(entity_name, '[^A-Za-z]+'), lambda x: x <> ''), lambda x: upper(x[1])), '') AS initials FROM enforcement_actions""")
def name_slug(spark, sf):
    return table(spark, sf, "enforcement_actions").select("row_id", T.slug("entity_name").alias("slug"), T.initials("entity_name").alias("initials"))


_NAMES = f"""q AS (SELECT og_site_name AS query, list_distinct(string_split({_NORM.format('og_site_name')}, ' ')) AS t FROM (SELECT DISTINCT og_site_name FROM site_pages WHERE og_site_name IS NOT NULL)),
c AS (SELECT entity_name AS candidate, list_distinct(string_split({_NORM.format('entity_name')}, ' ')) AS t FROM (SELECT DISTINCT entity_name FROM enforcement_actions))"""


@query(f"""WITH {_NAMES}, s AS (SELECT query, candidate, len(list_intersect(q.t, c.t)) AS n, len(q.t) AS nq, len(c.t) AS nc FROM q, c WHERE len(list_intersect(q.t, c.t)) > 0),
r AS (SELECT query, candidate, n / (nq + nc - n) AS score FROM s WHERE n / (nq + nc - n) >= 0.6)
SELECT query, candidate, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS k FROM r) WHERE k = 1""")
def name_jaccard_best(spark, sf):
    tokens = lambda c: F.array_distinct(F.split(T.normal_name(c), " "))
    q = table(spark, sf, "site_pages").where("og_site_name is not null").select(F.col("og_site_name").alias("query")).distinct().withColumn("t", tokens("query"))
    c = table(spark, sf, "enforcement_actions").select(F.col("entity_name").alias("candidate")).distinct().withColumn("t", tokens("candidate"))
    return match.best_name(q, "query", c, "candidate", "t", 0.6).withColumn("score", F.round("score", 6))


PREFIXES = (("1300", "first"), ("13", "registry"), ("131", "second"), ("1301", "third"))


@query(f"""WITH r AS (SELECT row_id, regexp_extract(url, '([0-9]{{7}})', 1) AS ref FROM enforcement_actions), p(prefix, office) AS (VALUES {', '.join(str(x) for x in PREFIXES)})
SELECT row_id, ref, (SELECT office FROM p WHERE starts_with(ref, prefix) ORDER BY length(prefix) DESC LIMIT 1) AS office FROM r""")
def longest_prefix_map(spark, sf):
    refs = table(spark, sf, "enforcement_actions").select("row_id", F.regexp_extract("url", "([0-9]{7})", 1).alias("ref"))
    return match.longest_prefix(refs, "ref", spark.createDataFrame(list(PREFIXES), "prefix string, office string"), "prefix", "office", 4)


SUFFIXES = ("co.example", "test")


@query(f"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host FROM site_pages), s(suffix) AS (VALUES {', '.join(f"('{x}')" for x in SUFFIXES)})
SELECT page_id, host FROM h WHERE EXISTS (SELECT 1 FROM s WHERE host = suffix OR ends_with(host, '.' || suffix))""")
def host_suffix_match(spark, sf):
    hosts = table(spark, sf, "site_pages").select("page_id", U.host("url").alias("host"))
    return match.host_suffix(hosts, "host", spark.createDataFrame([(x,) for x in SUFFIXES], "suffix string"), "suffix")


@query("""SELECT e.event_id, e.user_id, (SELECT max_by(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND p.ts <= e.ts) AS signup_id FROM events e WHERE e.event_type = 'purchase'""")
def nearest_preceding(spark, sf):
    e = table(spark, sf, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    joined = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("at"))
    return order.as_of(bought, joined, ["user_id"], "ts", "at", ["signup_id"]).select("event_id", "user_id", "signup_id")


@query("""WITH m AS (SELECT bundle_id, footer_text, strpos(footer_text, 'VAT no.') AS pos FROM site_bundles WHERE footer_text IS NOT NULL)
SELECT bundle_id, pos, contains(substring(footer_text, CAST(greatest(1, pos - 120) AS INTEGER), 240), 'Company') AS in_context FROM m WHERE pos > 0""")
def context_window(spark, sf):
    m = table(spark, sf, "site_bundles").where("footer_text is not null").select("bundle_id", "footer_text", F.instr("footer_text", "VAT no.").alias("pos")).where("pos > 0")
    near = F.substring(F.col("footer_text"), F.greatest(F.lit(1), F.col("pos") - 120), F.lit(240))
    return m.select("bundle_id", "pos", near.contains("Company").alias("in_context"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT l_orderkey, min(a) AS a, max(b) AS b, count(*) AS parts FROM n GROUP BY l_orderkey, i""")
def interval_merge(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).alias("a"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("b"))
    return order.merged(lines, ["l_orderkey"], "a", "b")


_FINDINGS = """f AS (SELECT event_id, event_type AS path, CAST(value AS INTEGER) % 7 AS category, CAST(json_extract(props, '$.k') AS INTEGER) AS start_line, CAST(json_extract(props, '$.k') AS INTEGER) + 2 AS end_line, 'tool' || CAST(user_id % 4 AS VARCHAR) AS tool FROM events)"""


@query(f"""WITH {_FINDINGS}, m AS (SELECT *, max(end_line) OVER (PARTITION BY path, category ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR start_line - 6 > before THEN 1 ELSE 0 END) OVER (PARTITION BY path, category ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS cluster FROM m)
SELECT path, category, cluster, count(*) AS findings, count(DISTINCT tool) AS tools, count(DISTINCT tool) >= 2 AS corroborated, min(start_line) AS first_line FROM n GROUP BY ALL""")
def finding_cluster_islands(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    f = table(spark, sf, "events").select("event_id", F.col("event_type").alias("path"), (F.rint("value").cast("int") % 7).alias("category"), k.alias("start_line"), (k + 2).alias("end_line"), F.concat(F.lit("tool"), (F.col("user_id") % 4).cast("string")).alias("tool"))
    c = order.islands(f, ["path", "category"], "start_line", "end_line", 6)
    return c.groupBy("path", "category", "cluster").agg(F.count("*").alias("findings"), F.count_distinct("tool").alias("tools"), (F.count_distinct("tool") >= 2).alias("corroborated"), F.min("start_line").alias("first_line"))
