"""What a crawl finds besides texts: sitemaps, robots rules, documents, markup and header signals, saved listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import url as U
from quarrylight.operators import match, rollup
from quarrylight.plans.pages import _HTML, _html
from quarrylight.plans.registry import query
from quarrylight.sources import crawl
from quarrylight.sources.tables import table

_SPACES = "[ \\t\\n\\r\\f\u00a0]+"


@query("""SELECT DISTINCT domain, url AS loc FROM site_pages WHERE url IS NOT NULL""")
def sitemap_urls(spark, sf):
    """Sitemaps of at most fifty addresses each, written and read again: every address once for each site."""
    p = table(spark, sf, "site_pages").where("url is not null").select("domain", "bundle_id", F.floor(F.col("page_idx") / 50).alias("part"), F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc><lastmod>2026-01-01</lastmod></url>")).alias("x"))
    maps = p.groupBy("domain", "bundle_id", "part").agg(F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(F.collect_list("x"), "\n"), F.lit("</urlset>")).alias("xml"))
    return maps.select("domain", F.explode(crawl.sitemap_locations("xml")).alias("loc")).distinct()


_ROBOTS = """CASE bundle_id % 4 WHEN 0 THEN 'User-agent: GPTBot|Disallow: /||User-agent: *|Disallow: /private' WHEN 1 THEN 'User-agent: *|Disallow: / # all' WHEN 2 THEN 'User-agent: *|Allow: /|Disallow:' ELSE 'user-agent: CCBot|User-Agent: GPTBot|Disallow: /||User-agent: *|Disallow: /x' END"""
BOTS = ("gptbot", "ccbot", "otherbot")


@query("""WITH b(kind, bot, blocked) AS (VALUES (0, 'gptbot', true), (0, 'ccbot', false), (0, 'otherbot', false), (1, 'gptbot', true), (1, 'ccbot', true), (1, 'otherbot', true), (2, 'gptbot', false), (2, 'ccbot', false), (2, 'otherbot', false), (3, 'gptbot', true), (3, 'ccbot', true), (3, 'otherbot', false))
SELECT bundle_id, bot, blocked FROM site_bundles JOIN b ON b.kind = bundle_id % 4""")
def robots_blocked(spark, sf):
    """Which bots a robots file keeps out of everything: the group that names the bot, or else the one for all."""
    r = table(spark, sf, "site_bundles").select("bundle_id", F.expr(f"replace({_ROBOTS}, '|', chr(10))").alias("robots"))
    return crawl.blocked_bots(r, "bundle_id", "robots", BOTS)


_POLICY = (("privacy", 1), ("cookie", 2), ("terms", 3), ("complaints", 4), ("fees sheet", 5), ("modern slavery", 6), ("accessibility", 7))
_RANK = "CASE " + " ".join(f"WHEN contains(label, '{w}') THEN {n}" for w, n in _POLICY) + " END"


@query(f"""WITH l AS (SELECT domain, page_id, lower(trim(unnest(string_split(text, chr(10))), ' •-–*»')) AS label FROM site_pages WHERE text IS NOT NULL),
d AS (SELECT domain, label, min(page_id) AS page_id, {_RANK} AS rank FROM l WHERE length(label) BETWEEN 4 AND 30 AND {_RANK} IS NOT NULL GROUP BY ALL)
SELECT domain, label, page_id, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rank, label) AS n FROM d) WHERE n <= 12""")
def policy_links(spark, sf):
    """The first twelve policy documents that a site links, by kind."""
    l = table(spark, sf, "site_pages").where("text is not null").select("domain", "page_id", F.explode(F.split("text", "\n")).alias("line")).select("domain", "page_id", F.lower(F.trim("line", F.lit(" •-–*»"))).alias("label"))
    rank = F.lit(None).cast("int")
    for w, n in reversed(_POLICY):
        rank = F.when(F.contains("label", F.lit(w)), n).otherwise(rank)
    d = l.where(F.length("label").between(4, 30) & rank.isNotNull()).groupBy("domain", "label").agg(F.min("page_id").alias("page_id"), F.min(rank).alias("_k"))
    return rollup.top(d, ["domain"], [F.col("_k"), F.col("label")], 12).select("domain", "label", "page_id", F.col("rank").alias("n"))


@query("""SELECT row_id, entity_name, decision_date, CASE WHEN currency = 'GBP' THEN CAST(penalty_amount AS BIGINT) END AS penalty FROM enforcement_actions""")
def collector_rows(spark, sf):
    """Saved listings of decisions, read by their markup: names unescaped, written-out dates, amounts with commas."""
    a = table(spark, sf, "enforcement_actions")
    name = F.replace(F.replace("entity_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pounds = F.when((F.col("currency") == "GBP") & F.col("penalty_amount").isNotNull(), F.concat(F.lit("fined £"), F.format_number("penalty_amount", 0), F.lit(" in all"))).otherwise("no fine")
    html = F.concat(F.lit('<tr class="row"><td class="n"><b>'), name, F.lit("</b></td><td>Decided on "), F.date_format("decision_date", "d MMMM yyyy"), F.lit("</td><td>"), pounds, F.lit("</td></tr>"))
    return crawl.listing_rows(a.select("row_id", html.alias("html")), "row_id", "html")


_ONPAGE = f"WITH h AS (SELECT page_id, {_HTML} AS html FROM site_pages)"


@query(f"""{_ONPAGE} SELECT page_id, length(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title_length, regexp_matches(html, '(?i)<meta[^>]+name="description"') AS described, len(regexp_extract_all(html, '(?i)<h1[ >]')) AS h1, len(regexp_extract_all(html, '(?i)<img[ >]')) AS images,
  len(regexp_extract_all(html, '(?i)<img[^>]*alt=')) AS images_named, len(regexp_extract_all(html, '(?i)<a[ >]')) AS links, regexp_matches(html, '(?i)<html[^>]* lang=') AS has_lang FROM h""")
def onpage_signals(spark, sf):
    """Counts and flags that a page's markup gives away, one pass over it."""
    h = _html(spark, sf)
    n = lambda p: F.regexp_count("html", F.lit(p))
    return h.select(
        "page_id", F.length(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title_length"), F.col("html").rlike('(?i)<meta[^>]+name="description"').alias("described"), n("(?i)<h1[ >]").alias("h1"),
        n("(?i)<img[ >]").alias("images"), n("(?i)<img[^>]*alt=").alias("images_named"), n("(?i)<a[ >]").alias("links"), F.col("html").rlike("(?i)<html[^>]* lang=").alias("has_lang"))


@query(f"""{_ONPAGE} SELECT page_id, trim(regexp_replace(regexp_replace(replace(regexp_extract(html, '(?is)<footer[^>]*>(.*?)</footer>', 1), '&copy;', '©'), '<[^>]*>', ' ', 'g'), '{_SPACES}', ' ', 'g')) AS footer FROM h""")
def html_footer(spark, sf):
    return _html(spark, sf).select("page_id", T.squeeze(F.regexp_replace(F.replace(F.regexp_extract("html", "(?is)<footer[^>]*>(.*?)</footer>", 1), F.lit("&copy;"), F.lit("©")), "<[^>]*>", " ")).alias("footer"))


@query(f"""{_ONPAGE}, r AS (SELECT page_id, 'html-lang' AS rule, CASE WHEN regexp_matches(html, '(?i)<html[^>]* lang=') THEN 'pass' ELSE 'violation' END AS outcome FROM h
UNION ALL SELECT page_id, 'img-alt', CASE WHEN NOT regexp_matches(html, '(?i)<img[ >]') THEN 'incomplete' WHEN regexp_matches(html, '(?i)<img(?: [a-z]+="[^"]*")*>') AND NOT regexp_matches(html, '(?i)<img[^>]* alt=') THEN 'violation' ELSE 'pass' END FROM h
UNION ALL SELECT page_id, 'document-title', CASE WHEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) = '' THEN 'violation' ELSE 'pass' END FROM h
UNION ALL SELECT page_id, 'link-name', CASE WHEN regexp_matches(html, '(?is)<a [^>]*>\\s*</a>') THEN 'violation' ELSE 'pass' END FROM h
UNION ALL SELECT page_id, 'one-h1', CASE WHEN len(regexp_extract_all(html, '(?i)<h1[ >]')) = 1 THEN 'pass' WHEN len(regexp_extract_all(html, '(?i)<h1[ >]')) = 0 THEN 'incomplete' ELSE 'violation' END FROM h
UNION ALL SELECT page_id, 'label', CASE WHEN regexp_matches(html, '(?i)<input[ >]') THEN 'violation' ELSE 'pass' END FROM h)
SELECT rule, outcome, count(*) AS pages FROM r GROUP BY ALL""")
def dom_predicates(spark, sf):
    """Rules over markup with three outcomes, as a union in one pass, and how many pages have each."""
    h = F.col("html")
    has = lambda p: h.rlike(p)
    h1 = F.regexp_count("html", F.lit("(?i)<h1[ >]"))
    rules = {
        "html-lang": F.when(has("(?i)<html[^>]* lang="), "pass").otherwise("violation"),
        "img-alt": F.when(~has("(?i)<img[ >]"), "incomplete").when(has('(?i)<img(?: [a-z]+="[^"]*")*>') & ~has("(?i)<img[^>]* alt="), "violation").otherwise("pass"),
        "document-title": F.when(F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)) == "", "violation").otherwise("pass"),
        "link-name": F.when(has(r"(?is)<a [^>]*>\s*</a>"), "violation").otherwise("pass"),
        "one-h1": F.when(h1 == 1, "pass").when(h1 == 0, "incomplete").otherwise("violation"),
        "label": F.when(has("(?i)<input[ >]"), "violation").otherwise("pass"),
    }
    each = _html(spark, sf).select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), c.alias("outcome")) for k, c in rules.items()))).alias("x")).select("x.*")
    return each.groupBy("rule", "outcome").agg(F.count("*").alias("pages"))


_HEADERS = "concat_ws(chr(10), 'Content-Type: text/html', CASE WHEN truncated THEN 'X-Frame-Options: DENY' END, CASE WHEN bundle_id % 3 = 0 THEN concat('Strict-Transport-Security: max-age=', CAST(bundle_id * 1000000 AS VARCHAR(20))) END, CASE WHEN spa_shell THEN 'content-security-policy: default-src self' END)"


@query(f"""WITH h AS (SELECT bundle_id, {_HEADERS} AS headers FROM site_bundles)
SELECT bundle_id, regexp_matches(headers, '(?im)^x-frame-options:') AS framed, regexp_matches(headers, '(?im)^content-security-policy:') AS csp, coalesce(TRY_CAST(nullif(regexp_extract(headers, '(?im)^strict-transport-security:.*max-age=([0-9]+)', 1), '') AS BIGINT) >= 31536000, false) AS hsts FROM h""")
def header_signals(spark, sf):
    """Security headers of a saved response."""
    h = table(spark, sf, "site_bundles").select("bundle_id", F.expr(_HEADERS).alias("headers"))
    age = F.nullif(F.regexp_extract("headers", "(?im)^strict-transport-security:.*max-age=([0-9]+)", 1), F.lit("")).try_cast("long")
    return h.select("bundle_id", F.col("headers").rlike("(?im)^x-frame-options:").alias("framed"), F.col("headers").rlike("(?im)^content-security-policy:").alias("csp"), F.coalesce(age >= 31_536_000, F.lit(False)).alias("hsts"))


_VITALS = "concat('{\"record\":{\"metrics\":{\"lcp\":{\"p75\":', CAST(CAST(floor(value * 40) AS BIGINT) AS VARCHAR(20)), '},\"cls\":{\"p75\":\"0.', CAST(event_id % 50 AS VARCHAR(20)), '\"}}}}')"


@query("""WITH v AS (SELECT event_id, CAST(floor(value * 40) AS BIGINT) AS lcp, CAST('0.' || (event_id % 50) AS DOUBLE) AS cls FROM events WHERE event_type = 'view' AND value IS NOT NULL)
SELECT event_id, lcp, CASE WHEN lcp <= 2500 THEN 'good' WHEN lcp <= 4000 THEN 'fair' ELSE 'poor' END AS lcp_rating, CASE WHEN cls <= 0.1 THEN 'good' WHEN cls <= 0.25 THEN 'fair' ELSE 'poor' END AS cls_rating FROM v""")
def web_vitals(spark, sf):
    """Measured values out of nested JSON, rated; a value may be a number or a string."""
    v = F.try_parse_json("doc")
    rate = lambda c, a, b: F.when(c <= a, "good").when(c <= b, "fair").otherwise("poor")
    doc = table(spark, sf, "events").where("event_type = 'view' and value is not null").select("event_id", F.expr(_VITALS).alias("doc"))
    d = doc.select("event_id", F.try_variant_get(v, "$.record.metrics.lcp.p75", "long").alias("lcp"), F.try_variant_get(v, "$.record.metrics.cls.p75", "double").alias("cls"))
    return d.select("event_id", "lcp", rate(F.col("lcp"), 2500, 4000).alias("lcp_rating"), rate(F.col("cls"), 0.1, 0.25).alias("cls_rating"))


_COOKIE = "CASE event_type WHEN 'view' THEN concat('_ga_', CAST(event_id % 9 AS VARCHAR(9))) WHEN 'click' THEN 'sessionid' WHEN 'signup' THEN 'csrftoken' WHEN 'purchase' THEN 'cart' ELSE 'zz' END"
_COOKIE_HOST = "CASE event_id % 3 WHEN 0 THEN 'ads.tracker.test' WHEN 1 THEN 'tracker.test' ELSE 'shop.example' END"


@query(f"""WITH c AS (SELECT {_COOKIE} AS name, {_COOKIE_HOST} AS host FROM events)
SELECT name, host, CASE WHEN name IN ('sessionid', 'csrftoken') THEN 'essential' WHEN starts_with(name, '_ga') THEN 'tracker' WHEN host = 'tracker.test' OR ends_with(host, '.tracker.test') THEN 'tracker' ELSE 'unknown' END AS class, count(*) AS seen FROM c GROUP BY ALL""")
def cookie_classes(spark, sf):
    """Cookies by name, essential names first, and by the host that set them where the name says nothing."""
    c = table(spark, sf, "events").select(F.expr(_COOKIE).alias("name"), F.expr(_COOKIE_HOST).alias("host")).groupBy("name", "host").agg(F.count("*").alias("seen"))
    tracked = match.host_suffix(c, "host", spark.createDataFrame([("tracker.test",)], "suffix string"), "suffix").select("host").distinct().withColumn("_t", F.lit(True))
    kind = F.when(F.col("name").isin("sessionid", "csrftoken"), "essential").when(F.startswith("name", F.lit("_ga")) | F.coalesce("_t", F.lit(False)), "tracker").otherwise("unknown")
    return c.join(match.small(tracked), "host", "left").select("name", "host", kind.alias("class"), "seen")


_CATEGORIES = (("money", "fee|deposit|price|loan|equity"), ("health", "dental|orthodontic|vaccination|allergy|hearing|root canal"), ("property", "lease|lets|tenant|purchase|rent"), ("law", "claim|probate|dispute|contract|will writing"))


@query("SELECT row_id, CASE " + " ".join(f"WHEN regexp_matches(lower(summary), '{p}') THEN '{c}'" for c, p in _CATEGORIES) + " ELSE 'other' END AS category FROM enforcement_actions")
def fingerprint_category(spark, sf):
    """The first class of keywords that a finding's text falls into."""
    out = F.lit("other")
    for c, p in reversed(_CATEGORIES):
        out = F.when(F.lower("summary").rlike(p), c).otherwise(out)
    return table(spark, sf, "enforcement_actions").select("row_id", out.alias("category"))


@query("""WITH h AS (SELECT doc_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM documents WHERE url IS NOT NULL)
SELECT host, count(*) AS documents FROM h WHERE NOT regexp_matches(host, '(^|[.])(ostervale-[a-z]+|quenby-forum)[.]example$') GROUP BY host""")
def aggregator_filter(spark, sf):
    """Hosts that are no aggregators: an anti-join on the host's own suffixes."""
    d = table(spark, sf, "documents").where("url is not null").select("doc_id", U.host("url").alias("host"))
    known = spark.createDataFrame([(f"ostervale-{x}.example",) for x in ("blogs", "forum", "advice", "crawl", "bulletins", "letters")] + [("quenby-forum.example",)], "suffix string")
    bad = match.host_suffix(d.select("host").distinct(), "host", known, "suffix").select("host").distinct()
    return d.join(match.small(bad), "host", "left_anti").groupBy("host").agg(F.count("*").alias("documents"))
