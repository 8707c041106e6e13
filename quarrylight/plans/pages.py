"""Queries over crawled pages: markup, addresses, classes, duplicates, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import url as U
from quarrylight.operators import order, rollup
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table

_HTML = (
    "concat('<html', CASE WHEN page_idx % 5 = 4 THEN '' ELSE ' lang=\"en\"' END, '><head><title>', coalesce(title, ''), '</title><script>var a = \"</p>\";</script>', CASE WHEN page_idx % 2 = 0 THEN '<meta name=\"description\" content=\"x\">' ELSE '' END, "
    "'</head><body><nav><a href=\"', url, '\">Up</a></nav><!-- no --><h1>', replace(coalesce(title, ''), '&', '&amp;'), '</h1><img src=\"a.png\"', CASE WHEN page_idx % 3 = 0 THEN '' ELSE ' alt=\"a\"' END, '><p>', replace(replace(coalesce(text, ''), '&', '&amp;'), chr(10), '</p><p>'), "
    "'</p><footer>&copy; ', domain, ' <a href=\"/privacy\">Privacy</a></footer><a href=\"/next\">N</a><script>x(')"
)
#: Paths of pages by class, first match wins.
PAGE_CLASSES = (("home", "^/$"), ("services", "(^|/)services(/|$)"), ("guide", "(^|/)guide(/|$)"), ("news", "(^|/)(news|blog)(/|$)"), ("about", "(^|/)about(/|$)"))


def _html(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages with markup around their titles and texts; the last script is never closed."""
    return table(spark, sf, "site_pages").select("page_id", F.expr(_HTML).alias("html"))


@query(f"""
WITH h AS (SELECT page_id, {_HTML} AS html FROM site_pages),
s AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?(</(script|style|noscript)>|$)', ' ', 'g') AS t FROM h),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?(-->|$)', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM s),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM c)
SELECT page_id, trim(regexp_replace(t, '[ \\t\\n\\r\\f\u00a0]+', ' ', 'g')) AS text FROM e""")
def html_strip(spark, sf):
    return _html(spark, sf).select("page_id", T.strip_html("html").alias("text"))


@query(f"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r\\f\u00a0]+', ' ', 'g')) AS title,
       lower(regexp_extract(html, '(?is)<html[^>]*\\slang=["'']?([a-zA-Z]{{2}})', 1)) AS lang
FROM (SELECT page_id, {_HTML} AS html FROM site_pages)""")
def html_title_lang(spark, sf):
    return _html(spark, sf).select("page_id", T.html_title("html").alias("title"), T.html_lang("html").alias("lang"))


@query(f"""
SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=["'']([^"''#]+)', 1)) AS href
FROM (SELECT page_id, {_HTML} AS html FROM site_pages)""")
def html_links(spark, sf):
    return _html(spark, sf).select("page_id", F.explode(T.hrefs("html")).alias("href"))


_URL = r"""
u AS (SELECT page_id, domain, page_idx, url, title, text, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host,
  CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path FROM site_pages),
v AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two, array_to_string(string_split(host, '.')[-3:], '.') AS three FROM u),
r AS (SELECT *, CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'co.nz', 'co.example', 'clinic.example') THEN three ELSE two END AS registered FROM v)
"""


@query(f"""WITH {_URL} SELECT page_id, host, registered, string_split(registered, '.')[1] AS stem, path,
  concat(regexp_replace(host, '^www\\.', ''), regexp_replace(path, '/+$', '')) AS url_key,
  len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM r""")
def url_parts(spark, sf):
    h = U.host("url")
    return table(spark, sf, "site_pages").select(
        "page_id", h.alias("host"), U.registrable(h).alias("registered"), U.stem(h).alias("stem"), U.path("url").alias("path"), U.key("url").alias("url_key"), F.size(F.filter(F.split(U.path("url"), "/"), lambda x: x != "")).alias("depth"))


def page_class_of(url: str = "url"):
    out = F.when(U.path(url).rlike(PAGE_CLASSES[0][1]), PAGE_CLASSES[0][0])
    for name, pattern in PAGE_CLASSES[1:]:
        out = out.when(U.path(url).rlike(pattern), name)
    return out.otherwise("other")


_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{n}'" for n, p in PAGE_CLASSES) + " ELSE 'other' END"


@query(f"WITH {_URL} SELECT page_id, {_CLASS} AS page_class FROM r")
def page_class(spark, sf):
    return table(spark, sf, "site_pages").select("page_id", page_class_of().alias("page_class"))


@query(f"""WITH {_URL}, t AS (SELECT domain, page_id, url, CASE {_CLASS} WHEN 'home' THEN 0 WHEN 'services' THEN 1 WHEN 'about' THEN 2 WHEN 'guide' THEN 3 ELSE 4 END AS tier, page_idx FROM r)
SELECT domain, page_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY tier, page_idx, page_id) AS rank FROM t) WHERE rank <= 5""")
def link_tier_topk(spark, sf):
    c = page_class_of()
    tier = F.when(c == "home", 0).when(c == "services", 1).when(c == "about", 2).when(c == "guide", 3).otherwise(4)
    pages = table(spark, sf, "site_pages").select("domain", "page_id", "page_idx", tier.alias("tier"))
    return rollup.top(pages, ["domain"], [F.col("tier"), F.col("page_idx"), F.col("page_id")], 5).select("domain", "page_id", "tier", "rank")


@query("""SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY domain, sha1(text) ORDER BY page_idx, page_id) AS n FROM site_pages WHERE text IS NOT NULL) WHERE n = 1""")
def body_hash_dedupe(spark, sf):
    pages = table(spark, sf, "site_pages").where("text is not null").select("page_id", "domain", "page_idx", F.sha1("text").alias("body"))
    return order.keep_first(pages, ["domain", "body"], [F.col("page_idx"), F.col("page_id")]).select("page_id")


@query(f"""WITH {_URL} SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY concat(regexp_replace(host, '^www\\.', ''), regexp_replace(path, '/+$', '')) ORDER BY page_id) AS n FROM r) WHERE n = 1""")
def url_key_dedupe(spark, sf):
    pages = table(spark, sf, "site_pages").select("page_id", U.key("url").alias("k"))
    return order.keep_first(pages, ["k"], [F.col("page_id")]).select("page_id")


@query(f"""WITH {_URL}, s AS (SELECT page_id, list_filter(regexp_split_to_array(lower(path), '[^a-z0-9]+'), lambda x: x <> '') AS tokens FROM r)
SELECT page_id FROM s WHERE contains(concat('/', array_to_string(tokens, '/'), '/'), '/home/visits/')""")
def path_segment_match(spark, sf):
    return table(spark, sf, "site_pages").where(U.has_run(U.segments("url"), ["home", "visits"])).select("page_id")


_CONTENT = """CASE WHEN text IS NULL OR trim(regexp_replace(text, '[ \\t\\n\\r\\f\u00a0]+', ' ', 'g')) = '' THEN 'empty'
  WHEN length(text) < 600 AND regexp_matches(lower(text), 'checking your browser|captcha') THEN 'challenge'
  WHEN length(text) < 600 AND regexp_matches(lower(text), 'log in|sign in') THEN 'login'
  WHEN length(text) < 600 AND regexp_matches(lower(text), 'error|not found|denied|nicht gefunden') THEN 'error'
  WHEN length(text) < 600 AND regexp_matches(lower(text), 'javascript') THEN 'shell' ELSE 'content' END"""


def content_class_of():
    short, low = F.length("text") < 600, F.lower("text")
    return (
        F.when(F.col("text").isNull() | T.is_blank("text"), "empty").when(short & low.rlike("checking your browser|captcha"), "challenge").when(short & low.rlike("log in|sign in"), "login")
        .when(short & low.rlike("error|not found|denied|nicht gefunden"), "error").when(short & low.rlike("javascript"), "shell").otherwise("content")
    )


@query(f"SELECT page_id, {_CONTENT} AS content_class FROM site_pages")
def content_class(spark, sf):
    return table(spark, sf, "site_pages").select("page_id", content_class_of().alias("content_class"))


@query(f"SELECT domain, {_CONTENT} AS content_class, count(*) AS pages FROM site_pages GROUP BY ALL")
def content_class_counts(spark, sf):
    return table(spark, sf, "site_pages").groupBy("domain", content_class_of().alias("content_class")).agg(F.count("*").alias("pages"))


@query("""SELECT page_id, CASE WHEN json_ld IS NULL THEN 'none' WHEN NOT json_valid(json_ld) THEN 'broken' ELSE 'ok' END AS state,
  CASE WHEN json_valid(json_ld) THEN json_extract_string(json_ld, '$[0]."@type"') END AS type, CASE WHEN json_valid(json_ld) THEN json_extract_string(json_ld, '$[0].name') END AS name FROM site_pages""")
def json_ld_facts(spark, sf):
    v = F.try_parse_json("json_ld")
    get = lambda p: F.try_variant_get(v, p, "string")
    state = F.when(F.col("json_ld").isNull(), "none").when(v.isNull(), "broken").otherwise("ok")
    return table(spark, sf, "site_pages").select("page_id", state.alias("state"), get('$[0]["@type"]').alias("type"), get("$[0].name").alias("name"))


_NEEDED = ("home", "services", "about", "guide", "news")


@query(f"""WITH {_URL}, c AS (SELECT DISTINCT domain, {_CLASS} AS page_class FROM r WHERE text IS NOT NULL)
SELECT domain, count(*) FILTER (WHERE page_class IN {_NEEDED}) AS covered, round(count(*) FILTER (WHERE page_class IN {_NEEDED}) / 5.0, 2) AS ratio,
  count(*) FILTER (WHERE page_class IN {_NEEDED}) / 5.0 >= 0.5 AS enough FROM c GROUP BY domain""")
def coverage_ratio(spark, sf):
    seen = table(spark, sf, "site_pages").where("text is not null").groupBy("domain").agg(F.collect_set(page_class_of()).alias("classes"))
    need = F.array(*map(F.lit, _NEEDED))
    covered = F.size(F.array_intersect("classes", need))
    return seen.select("domain", covered.alias("covered"), F.round(covered / 5.0, 2).alias("ratio"), (covered / 5.0 >= 0.5).alias("enough"))


@query(f"""WITH {_URL}, c AS (SELECT DISTINCT domain, {_CLASS} AS page_class FROM r WHERE text IS NOT NULL), d AS (SELECT DISTINCT domain FROM site_bundles)
SELECT d.domain, n.page_class AS missing FROM d CROSS JOIN (SELECT unnest(['home', 'services', 'about', 'guide', 'news']) AS page_class) n
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.domain = d.domain AND c.page_class = n.page_class)""")
def missing_classes(spark, sf):
    seen = table(spark, sf, "site_pages").where("text is not null").select("domain", page_class_of().alias("missing")).distinct()
    asked = table(spark, sf, "site_bundles").select("domain").distinct().withColumn("missing", F.explode(F.array(*map(F.lit, _NEEDED))))
    return asked.join(seen, ["domain", "missing"], "left_anti")


@query("""SELECT page_id FROM (SELECT page_id, domain, page_idx, row_number() OVER w AS n, sum(strlen(text)) OVER w AS bytes FROM site_pages WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY domain ORDER BY page_idx, page_id ROWS UNBOUNDED PRECEDING)) WHERE n <= 12 AND bytes <= 40000""")
def budget_cutoff(spark, sf):
    pages = table(spark, sf, "site_pages").where("text is not null").select("page_id", "domain", "page_idx", F.octet_length("text").alias("bytes"))
    return order.within_budget(pages, ["domain"], [F.col("page_idx"), F.col("page_id")], F.col("bytes"), 12, 40_000).select("page_id")
