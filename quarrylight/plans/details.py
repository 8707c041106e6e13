"""Finer variants of joins, rollups and scalar functions, each with its own query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import url as U
from quarrylight.operators import gates, match, order, rollup
from quarrylight.plans.pages import _URL
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table


@query("SELECT domain, count(*) AS pages FROM site_pages WHERE text IS NOT NULL AND trim(regexp_replace(text, '[ \\t\\n\\r\\f ]+', ' ', 'g')) <> '' GROUP BY domain")
def nonempty_pages(spark, sf):
    return table(spark, sf, "site_pages").where(F.col("text").isNotNull() & ~T.is_blank("text")).groupBy("domain").agg(F.count("*").alias("pages"))


@query("""WITH failed AS (SELECT register FROM register_notes WHERE domain IN (SELECT domain FROM site_bundles) GROUP BY register HAVING count(*) FILTER (WHERE kind = 'degraded') * 6 > count(*))
SELECT note_id, register, kind FROM register_notes WHERE register NOT IN (SELECT register FROM failed) OR kind <> 'matched'
UNION ALL SELECT note_id, register, 'degraded' FROM register_notes WHERE register IN (SELECT register FROM failed) AND kind = 'matched'""")
def canary_notes(spark, sf):
    """Rows of a register whose probe fails too often are dropped, and a note of the failure stands for each."""
    n = table(spark, sf, "register_notes").select("note_id", "domain", "register", "kind")
    known = n.join(table(spark, sf, "site_bundles").select("domain").distinct(), "domain", "left_semi")
    failed = known.groupBy("register").agg(F.count_if(F.col("kind") == "degraded").alias("d"), F.count("*").alias("n")).where("d * 6 > n").select("register", F.lit(True).alias("_f"))
    j = n.join(match.small(failed), "register", "left")
    return j.select("note_id", "register", F.when(F.coalesce("_f", F.lit(False)) & (F.col("kind") == "matched"), "degraded").otherwise(F.col("kind")).alias("kind"))


@query("""WITH c AS (SELECT jurisdiction, count(*) AS decisions FROM enforcement_actions GROUP BY jurisdiction), s AS (SELECT law_id, jurisdiction, unnest(sector) AS sector FROM law_rules)
SELECT s.law_id, s.sector, coalesce(c.decisions, 0) AS decisions, CASE WHEN c.decisions IS NULL THEN 'unknown' WHEN c.decisions >= 200 THEN 'covered' ELSE 'thin' END AS coverage FROM s LEFT JOIN c USING (jurisdiction)""")
def spec_coverage(spark, sf):
    """Specs with the coverage of where they apply; no row of coverage is unknown, not zero."""
    c = table(spark, sf, "enforcement_actions").groupBy("jurisdiction").agg(F.count("*").alias("decisions"))
    s = table(spark, sf, "law_rules").select("law_id", "jurisdiction", F.explode("sector").alias("sector")).join(c, "jurisdiction", "left")
    return s.select("law_id", "sector", F.coalesce("decisions", F.lit(0)).alias("decisions"), F.when(F.col("decisions").isNull(), "unknown").when(F.col("decisions") >= 200, "covered").otherwise("thin").alias("coverage"))


_NODES = "SELECT page_id AS k, domain, page_idx, coalesce(title, '') AS content FROM site_pages"


@query(f"""WITH n AS ({_NODES}), c AS (SELECT k, domain, page_idx, CASE WHEN k % 4 = 0 THEN content || '!' ELSE content END AS content, CASE WHEN k % 11 = 0 THEN -1 ELSE page_idx END AS at FROM n),
g AS (SELECT c.k, count(n.k) AS places, bool_or(n.content = c.content) AS same FROM c LEFT JOIN n ON n.domain = c.domain AND n.page_idx = c.at GROUP BY c.k)
SELECT k AS page_id, CASE WHEN places = 0 THEN 'no such node' WHEN same THEN 'exact' ELSE 'same place, other content' END AS diagnosis FROM g""")
def dom_two_tier(spark, sf):
    """Cited nodes of a page: at their place with their content, at their place with another, or nowhere."""
    n = table(spark, sf, "site_pages").select("page_id", "domain", "page_idx", F.coalesce("title", F.lit("")).alias("content"))
    c = n.select("page_id", "domain", F.when(F.col("page_id") % 11 == 0, -1).otherwise(F.col("page_idx")).alias("page_idx"), F.when(F.col("page_id") % 4 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("cited"))
    # Contents of one place are compared once each, however many rows repeat them.
    stored = n.select("domain", "page_idx", "content").distinct()
    g = c.join(stored, ["domain", "page_idx"], "left").groupBy("page_id").agg(F.count("content").alias("places"), F.bool_or(F.col("content") == F.col("cited")).alias("same"))
    return g.select("page_id", F.when(F.col("places") == 0, "no such node").when(F.col("same"), "exact").otherwise("same place, other content").alias("diagnosis"))


@query("""WITH r AS (SELECT DISTINCT register, string_split(register, '-')[1] AS token FROM register_notes), w AS (SELECT law_id, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS name_tokens, sector, list_filter(string_split(lower(law_id), '_'), lambda x: x <> '') AS id_tokens FROM law_rules),
t AS (SELECT w.law_id, r.register, CASE WHEN list_contains(w.name_tokens, r.token) THEN 1 WHEN list_contains(w.sector, r.token) THEN 2 WHEN list_contains(w.id_tokens, r.token) THEN 3 END AS tier FROM w CROSS JOIN r)
SELECT law_id, min_by(register, (tier, register)) AS register, min(tier) AS tier FROM t WHERE tier IS NOT NULL GROUP BY law_id""")
def obligation_register(spark, sf):
    """The register of a rule: by a word of its name, else by its sector, else by its id; three joins on words, the best tier first."""
    r = match.small(table(spark, sf, "register_notes").select("register", F.split("register", "-")[0].alias("token")).distinct())
    rules = table(spark, sf, "law_rules")
    tokens = lambda c, n: rules.select("law_id", F.explode(F.array_distinct(c)).alias("token"), F.lit(n).alias("tier"))
    t = tokens(T.words("name"), 1).unionByName(tokens(F.col("sector"), 2)).unionByName(tokens(F.split(F.lower("law_id"), "_"), 3)).join(r, "token")
    return t.groupBy("law_id").agg(F.min_by("register", F.struct("tier", "register")).alias("register"), F.min("tier").alias("tier"))


@query("""SELECT domain, register, CASE WHEN bool_or(kind = 'matched') THEN 'compliant' WHEN bool_or(kind = 'no_match') THEN 'weak' ELSE 'suppressed' END AS candidate FROM register_notes GROUP BY ALL""")
def register_candidates(spark, sf):
    """What a register says of a firm: a match clears it, a note of no match is weak evidence, anything else none."""
    k = F.col("kind")
    return table(spark, sf, "register_notes").groupBy("domain", "register").agg(F.when(F.bool_or(k == "matched"), "compliant").when(F.bool_or(k == "no_match"), "weak").otherwise("suppressed").alias("candidate"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS host, ts < DATE '2024-01-15' AS early FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, host, count(*) FILTER (WHERE early) AS before, count(*) FILTER (WHERE NOT early) AS after, min(event_id) FILTER (WHERE early) AS first_before FROM e GROUP BY ALL""")
def consent_hosts(spark, sf):
    """What each host received before and after consent, and the first of it before."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long") % 7
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).select("user_id", "event_id", k.alias("host"), early.alias("early"))
    return e.groupBy("user_id", "host").agg(F.count_if("early").alias("before"), F.count_if(~F.col("early")).alias("after"), F.min(F.when(F.col("early"), F.col("event_id"))).alias("first_before"))


@query("""WITH n AS (SELECT source, row_id, floor((row_number() OVER (PARTITION BY source ORDER BY row_id) - 1) / 10)::BIGINT AS batch FROM enforcement_actions), v AS (SELECT row_id, CASE WHEN penalty_amount IS NULL THEN 'pass' ELSE 'violation' END AS verdict FROM enforcement_actions WHERE offending_quote IS NOT NULL)
SELECT source, batch, count(*) AS asked, count(v.row_id) AS answered, count(*) FILTER (WHERE v.verdict = 'violation') AS violations, count(*) FILTER (WHERE v.verdict IS NULL) AS abstained FROM n LEFT JOIN v USING (row_id) GROUP BY ALL""")
def batched_adjudication(spark, sf):
    """Findings in batches of ten with the verdicts that came back; what has none abstains."""
    a = order.numbered(table(spark, sf, "enforcement_actions").select("source", "row_id"), ["source"], "row_id", 100_000).withColumn("batch", F.floor((F.col("n") - 1) / 10).cast("long"))
    v = table(spark, sf, "enforcement_actions").where("offending_quote is not null").select("row_id", F.when(F.col("penalty_amount").isNull(), "pass").otherwise("violation").alias("verdict"))
    j = a.join(v, "row_id", "left")
    return j.groupBy("source", "batch").agg(F.count("*").alias("asked"), F.count("verdict").alias("answered"), F.count_if(F.col("verdict") == "violation").alias("violations"), F.count_if(F.col("verdict").isNull()).alias("abstained"))


@query("""WITH g AS (SELECT source, batch_no, bool_and(offending_quote IS NOT NULL) AS complete, bool_and(currency IN ('GBP', 'EUR', 'USD') OR currency IS NULL) AS closed, bool_and(contains(summary, entity_name)) AS anchored FROM enforcement_actions GROUP BY ALL)
SELECT source, batch_no, 3 * complete::INT + 3 * closed::INT + 4 * anchored::INT AS score, 3 * complete::INT + 3 * closed::INT + 4 * anchored::INT >= 7 AS passes FROM g""")
def rubric_groups(spark, sf):
    """A batch's rubric: each part holds only if it holds for all of it."""
    i = lambda c: F.bool_and(c).cast("int")
    score = 3 * i(F.col("offending_quote").isNotNull()) + 3 * i(F.col("currency").isin("GBP", "EUR", "USD") | F.col("currency").isNull()) + 4 * i(F.col("summary").contains(F.col("entity_name")))
    return table(spark, sf, "enforcement_actions").groupBy("source", "batch_no").agg(score.alias("score"), (score >= 7).alias("passes"))


_CUES = (("dental", "health"), ("orthodontic", "health"), ("vaccination", "health"), ("allergy", "health"), ("lease", "property"), ("tenant", "property"), ("rent", "property"), ("purchase", "property"), ("probate", "law"), ("claims", "law"), ("dispute", "law"), ("contract", "law"), ("equity", "finance"), ("pension", "finance"))


@query(f"""WITH cue(cue, family) AS (VALUES {', '.join(str(c) for c in _CUES)}), d AS (SELECT DISTINCT domain, cue, family FROM site_pages JOIN cue ON contains(lower(coalesce(title, '')), cue)),
s AS (SELECT domain, family, count(*) AS cues FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY cues DESC, family) AS n FROM s),
t AS (SELECT domain, max(family) FILTER (WHERE n = 1) AS family, max(cues) FILTER (WHERE n = 1) AS cues, coalesce(max(cues) FILTER (WHERE n = 2), 0) AS rival, count(*) FILTER (WHERE cues >= 2) AS at_floor FROM r GROUP BY domain)
SELECT domain, CASE WHEN cues < 2 THEN 'too few cues' WHEN at_floor >= 3 AND NOT (cues >= 7 AND cues >= 1.5 * rival) THEN 'conflict' WHEN cues <= rival THEN 'tie' ELSE family END AS sector, cues, rival FROM t""")
def sector_conflict(spark, sf):
    """A site's sector by distinct cues: two at least, more than any rival, and none if several rivals have enough."""
    title = F.lower(F.coalesce("title", F.lit("")))
    found = F.array_compact(F.array(*(F.when(F.contains(title, F.lit(c)), F.struct(F.lit(c).alias("cue"), F.lit(f).alias("family"))) for c, f in _CUES)))
    s = table(spark, sf, "site_pages").select("domain", F.explode(found).alias("x")).select("domain", "x.*").distinct().groupBy("domain", "family").agg(F.count("*").alias("cues"))
    r = s.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("cues"), "family")))
    first = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    t = r.groupBy("domain").agg(first(1, "family").alias("family"), first(1, "cues").alias("best"), F.coalesce(first(2, "cues"), F.lit(0)).alias("rival"), F.count_if(F.col("cues") >= 2).alias("at_floor"))
    sector = F.when(F.col("best") < 2, "too few cues").when((F.col("at_floor") >= 3) & ~((F.col("best") >= 7) & (F.col("best") >= 1.5 * F.col("rival"))), "conflict").when(F.col("best") <= F.col("rival"), "tie").otherwise(F.col("family"))
    return t.select("domain", sector.alias("sector"), F.col("best").alias("cues"), "rival")


@query("""WITH f AS (SELECT l_suppkey % 40 AS path, 'T' || (l_linenumber % 3) AS tool, l_partkey % 500 AS line, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS severity FROM lineitem),
d AS (SELECT path, tool, line, max(severity) AS severity FROM f GROUP BY ALL), m AS (SELECT *, CASE WHEN line - 1 > max(line) OVER (PARTITION BY path ORDER BY line, tool ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY path ORDER BY line, tool) = 1 THEN 1 ELSE 0 END AS new FROM d),
c AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line, tool ROWS UNBOUNDED PRECEDING) AS cluster FROM m)
SELECT path, cluster::BIGINT AS cluster, count(*) AS findings, count(DISTINCT tool) AS tools, max(severity) AS severity, count(DISTINCT tool) >= 2 AS act FROM c GROUP BY ALL""")
def tool_clusters(spark, sf):
    """Findings of several tools: once for each fingerprint, clustered by neighbouring lines, acted on if two tools agree."""
    severity = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    d = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("path"), F.concat(F.lit("T"), (F.col("l_linenumber") % 3).cast("string")).alias("tool"), (F.col("l_partkey") % 500).alias("line")).agg(F.max(severity).alias("severity"))
    c = order.islands(d.withColumn("stop", F.col("line")), ["path"], "line", "stop", 1)
    return c.groupBy("path", "cluster").agg(F.count("*").alias("findings"), F.count_distinct("tool").alias("tools"), F.max("severity").alias("severity"), (F.count_distinct("tool") >= 2).alias("act"))


@query("""WITH t AS (SELECT domain, bool_or(og_site_name IS NOT NULL) AS named, count(json_ld) * 2 > count(*) AS marked FROM site_pages GROUP BY domain), n AS (SELECT domain, count(*) FILTER (WHERE kind = 'matched') AS matched, count(*) FILTER (WHERE kind = 'no_match') AS refused FROM register_notes GROUP BY domain),
j AS (SELECT t.domain, named, marked, coalesce(matched, 0) AS matched, coalesce(refused, 0) AS refused FROM t LEFT JOIN n USING (domain))
SELECT CASE WHEN marked THEN 'marked' ELSE 'plain' END AS kind, count(*) AS sites, round(count(*) FILTER (WHERE named AND matched > 0) / nullif(count(*) FILTER (WHERE named), 0), 6) AS bind_recall, round(count(*) FILTER (WHERE NOT named AND matched > 0) / nullif(count(*) FILTER (WHERE NOT named), 0), 6) AS blind_recall,
  count(*) FILTER (WHERE refused > 0 AND matched = 0 AND named) AS false_accusations, count(*) FILTER (WHERE matched > 1) AS wrong_attach FROM j GROUP BY ALL""")
def recall_family(spark, sf):
    """Rates that are null without a denominator, and counts of the two mistakes that must not happen."""
    t = table(spark, sf, "site_pages").groupBy("domain").agg(F.bool_or(F.col("og_site_name").isNotNull()).alias("named"), (F.count("json_ld") * 2 > F.count("*")).alias("marked"))
    n = table(spark, sf, "register_notes").groupBy("domain").agg(F.count_if(F.col("kind") == "matched").alias("matched"), F.count_if(F.col("kind") == "no_match").alias("refused"))
    j = t.join(n, "domain", "left").na.fill(0, ["matched", "refused"])
    some, named = F.col("matched") > 0, F.col("named")
    share = lambda a, b: F.round(rollup.rate(F.count_if(a), F.count_if(b)), 6)
    return j.groupBy(F.when(F.col("marked"), "marked").otherwise("plain").alias("kind")).agg(
        F.count("*").alias("sites"), share(named & some, named).alias("bind_recall"), share(~named & some, ~named).alias("blind_recall"),
        F.count_if((F.col("refused") > 0) & ~some & named).alias("false_accusations"), F.count_if(F.col("matched") > 1).alias("wrong_attach"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error'), c(user_id, n, hash) AS (SELECT user_id, n, sha256('' || '|' || event_id) FROM e WHERE n = 1 UNION ALL SELECT c.user_id, e.n, sha256(c.hash || '|' || e.event_id) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT user_id, count(*) AS links, max_by(hash, n) AS head FROM c GROUP BY user_id""")
def hash_chain_build(spark, sf):
    """The chain of hashes over a run's entries in order: each hash takes in the one before; a chain is one run's and is built in one fold."""
    e = table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    head = F.aggregate("ids", F.lit(""), lambda acc, x: F.sha2(F.concat(acc, F.lit("|"), x.cast("string")), 256))
    return e.select("user_id", F.size("ids").alias("links"), head.alias("head"))


@query(f"""WITH {_URL} SELECT domain, page_id, n FROM (SELECT domain, page_id, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN url IS NULL THEN 999 WHEN host = '' THEN 998 ELSE length(path) END, page_id) AS n FROM r) WHERE n <= 6""")
def path_length_order(spark, sf):
    """Pages by the length of their path, unreadable addresses after all others and missing ones last."""
    rank = F.when(F.col("url").isNull(), 999).when(U.host("url") == "", 998).otherwise(F.length(U.path("url")))
    return rollup.top(table(spark, sf, "site_pages").select("domain", "page_id", rank.alias("k")), ["domain"], [F.col("k"), F.col("page_id")], 6).select("domain", "page_id", F.col("rank").alias("n"))


@query("""WITH b AS (SELECT page_id, replace(json_ld, '", "', '",' || chr(9) || chr(10) || '"') || chr(1) AS raw FROM site_pages WHERE json_ld IS NOT NULL), c AS (SELECT page_id, trim(regexp_replace(raw, '[\\x00-\\x1f]+', ' ', 'g')) AS fixed FROM b)
SELECT page_id, json_valid(fixed) AS readable, CASE WHEN json_valid(fixed) THEN json_extract_string(fixed, '$[0].name') END AS name FROM c""")
def json_repair(spark, sf):
    """Structured data with control characters in it, read once these are blanks."""
    raw = F.concat(F.replace("json_ld", F.lit('", "'), F.lit('",\t\n"')), F.lit("\x01"))
    fixed = F.trim(F.regexp_replace(raw, r"[\x00-\x1f]+", " "))
    b = table(spark, sf, "site_pages").where("json_ld is not null").select("page_id", fixed.alias("fixed"))
    v = F.try_parse_json("fixed")
    return b.select("page_id", v.isNotNull().alias("readable"), F.try_variant_get(v, "$[0].name", "string").alias("name"))


@query("""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> '')) AS by_marks, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS by_lines, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t]+([A-Z])', '\\1' || chr(10) || '\\2', 'g'), '\\n+'), lambda x: trim(x) <> '')) AS by_capitals FROM d""")
def sentence_definitions(spark, sf):
    """Three ways to part a text: at every mark, at line ends, and after a mark before a capital."""
    n = lambda c: F.size(F.filter(c, lambda x: F.trim(x) != ""))
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", n(F.split("text", "[.!?]+")).alias("by_marks"), n(F.split("text", "\n")).alias("by_lines"), n(F.split(F.regexp_replace("text", r"([.!?])[ \t]+([A-Z])", "$1\n$2"), "\n+")).alias("by_capitals"))


@query(f"""WITH {_URL} SELECT page_id, registered = regexp_replace(domain, '^www[.]', '') OR ends_with(host, '.' || regexp_replace(domain, '^www[.]', '')) OR host = domain AS same_site, CASE string_split(host, '.')[-1] WHEN 'uk' THEN 'UK' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'EU' WHEN 'test' THEN 'none' ELSE 'generic' END AS place FROM r""")
def same_site(spark, sf):
    """Whether an address belongs to its site, and what its last label says of a place."""
    h, bare = U.host("url"), F.regexp_replace("domain", "^www[.]", "")
    last = F.substring_index(h, ".", -1)
    place = F.when(last == "uk", "UK").when(last == "fr", "FR").when(last == "de", "EU").when(last == "test", "none").otherwise("generic")
    return table(spark, sf, "site_pages").select("page_id", ((U.registrable(h) == bare) | F.endswith(h, F.concat(F.lit("."), bare)) | (h == F.col("domain"))).alias("same_site"), place.alias("place"))


_PREFIXES = (("44", "UK"), ("33", "FR"), ("1", "US"), ("49", "EU"), ("447", "UK mobile"))


@query(f"""WITH p(prefix, place) AS (VALUES {', '.join(str(x) for x in _PREFIXES)}), d AS (SELECT bundle_id, regexp_replace(regexp_extract(footer_text, '(?:\\+|00)([0-9][0-9 ().-]{{6,20}})', 1), '[^0-9]', '', 'g') AS digits FROM site_bundles WHERE footer_text IS NOT NULL)
SELECT bundle_id, nullif(digits, '') AS digits, (SELECT max_by(place, length(prefix)) FROM p WHERE digits <> '' AND starts_with(digits, prefix)) AS place FROM d""")
def phone_places(spark, sf):
    """The place of an international number by its longest known prefix."""
    digits = F.regexp_replace(F.regexp_extract("footer_text", r"(?:\+|00)([0-9][0-9 ().-]{6,20})", 1), "[^0-9]", "")
    d = table(spark, sf, "site_bundles").where("footer_text is not null").select("bundle_id", F.nullif(digits, F.lit("")).alias("digits"))
    return match.longest_prefix(d, "digits", spark.createDataFrame(list(_PREFIXES), "prefix string, place string"), "prefix", "place", 3).select("bundle_id", "digits", "place")


@query("""SELECT law_id, CAST(DATE '2026-01-01' - verified_date AS BIGINT) AS age_days, CASE WHEN verified_date IS NULL THEN 'unknown' WHEN verified_date > DATE '2026-01-01' THEN 'future' WHEN DATE '2026-01-01' - verified_date > 180 THEN 'expired' ELSE 'fresh' END AS state FROM law_rules""")
def expiry_states(spark, sf):
    """The age of what was checked; without a date it is unknown, not expired."""
    day, now = F.col("verified_date"), F.lit("2026-01-01").cast("date")
    age = F.datediff(now, day)
    return table(spark, sf, "law_rules").select("law_id", age.cast("long").alias("age_days"), F.when(day.isNull(), "unknown").when(day > now, "future").when(age > 180, "expired").otherwise("fresh").alias("state"))


@query("""WITH s AS (SELECT domain, bool_or(json_ld IS NOT NULL) AS marked, bool_or(og_site_name IS NOT NULL) AS named, avg(CASE WHEN title IS NULL THEN 0.0 ELSE 1.0 END) AS titled, count(*) AS pages FROM site_pages GROUP BY domain)
SELECT domain, round(40 * marked::INT + 30 * named::INT + 20 * titled + least(pages, 10), 4) AS score FROM s""")
def weighted_score(spark, sf):
    """A readiness score: flags and shares with weights, a count with a ceiling."""
    s = table(spark, sf, "site_pages").groupBy("domain").agg(F.bool_or(F.col("json_ld").isNotNull()).cast("int").alias("m"), F.bool_or(F.col("og_site_name").isNotNull()).cast("int").alias("n"), F.avg(F.col("title").isNotNull().cast("double")).alias("t"), F.count("*").alias("p"))
    return s.select("domain", F.round(40 * F.col("m") + 30 * F.col("n") + 20 * F.col("t") + F.least("p", F.lit(10)), 4).alias("score"))


@query("""WITH f AS (SELECT DISTINCT jurisdiction, law_id FROM (SELECT jurisdiction, unnest(law_ids) AS law_id, penalty_amount FROM enforcement_actions WHERE penalty_amount IS NOT NULL)), x AS (SELECT a.jurisdiction, l.law_id, min(a.penalty_amount) AS low, max(a.penalty_amount) AS high FROM enforcement_actions a, unnest(a.law_ids) l(law_id) WHERE a.penalty_amount IS NOT NULL GROUP BY ALL),
b AS (SELECT x.jurisdiction, x.law_id, low, least(high, coalesce(r.statutory_max, high)) AS high, r.statutory_max AS cap, r.currency FROM x JOIN law_rules r USING (law_id))
SELECT jurisdiction, currency, round(sum((low + high) / 2), 2) AS typical, max(cap) AS ceiling, count(*) AS rules FROM b GROUP BY ALL""")
def exposure_bands(spark, sf):
    """Bands of penalties by rule, capped by what the rule allows, their middles summed by place and currency, and the highest cap."""
    a = table(spark, sf, "enforcement_actions").where("penalty_amount is not null").select("jurisdiction", "penalty_amount", F.explode("law_ids").alias("law_id"))
    x = a.groupBy("jurisdiction", "law_id").agg(F.min("penalty_amount").alias("low"), F.max("penalty_amount").alias("high"))
    b = x.join(match.small(table(spark, sf, "law_rules").select("law_id", F.col("statutory_max").alias("cap"), "currency")), "law_id").withColumn("high", F.least("high", F.coalesce("cap", "high")))
    return b.groupBy("jurisdiction", "currency").agg(F.round(F.sum((F.col("low") + F.col("high")) / 2), 2).alias("typical"), F.max("cap").alias("ceiling"), F.count("*").alias("rules"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS s, text FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, text, s[1] AS first, s[len(s)] AS last FROM s WHERE len(s) > 0)
SELECT doc_id, strlen(substring(text, 1, position(first IN text) - 1)) AS first_byte, strlen(text) - strlen(last) - strlen(regexp_extract(text, '[ \t\n]*$')) AS last_byte, sha256(last) AS last_sha256 FROM f""")
def source_boundaries(spark, sf):
    """Where a text's first and last sentence begin in its own bytes."""
    s = T.sentences("text")
    f = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.get(s, F.lit(0)).alias("first"), F.try_element_at(s, F.lit(-1)).alias("last")).where("first is not null")
    tail = F.regexp_extract("text", "[ \\t\\n]*$", 0)
    return f.select(
        "doc_id", F.octet_length(F.expr("substring(text, 1, instr(text, first) - 1)")).alias("first_byte"), (F.octet_length("text") - F.octet_length("last") - F.octet_length(tail)).alias("last_byte"), F.sha2("last", 256).alias("last_sha256"))


@query("""WITH n AS (SELECT domain, register, kind, noted_at, note_id, row_number() OVER (PARTITION BY domain, register ORDER BY noted_at DESC, note_id DESC) AS n FROM register_notes)
SELECT domain, count(*) AS lanes, count(*) FILTER (WHERE kind = 'degraded' OR kind = 'not_applicable') AS not_run, string_agg(CASE WHEN kind = 'degraded' OR kind = 'not_applicable' THEN register END, ', ' ORDER BY register) AS caveat FROM n WHERE n = 1 GROUP BY domain""")
def lane_caveats(spark, sf):
    """The lanes of a site that did not run, by the latest note of each."""
    latest = order.latest(table(spark, sf, "register_notes"), ["domain", "register"], F.struct("noted_at", "note_id"), "kind")
    off = F.col("kind").isin("degraded", "not_applicable")
    names = F.array_join(F.array_sort(F.collect_set(F.when(off, F.col("register")))), ", ")
    return latest.groupBy("domain").agg(F.count("*").alias("lanes"), F.count_if(off).alias("not_run"), F.nullif(names, F.lit("")).alias("caveat"))
