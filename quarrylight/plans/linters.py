"""Constraint queries over rules, findings and facts, and the gates that refuse a report."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import values as V
from quarrylight.operators import gates, match, quality
from quarrylight.plans.applicability import RULE_SUBS, SUB_SECTORS
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table


def _rules(spark, sf):
    return table(spark, sf, "law_rules")


@query("""SELECT law_id, 'prohibition typed as absence' AS problem FROM law_rules WHERE regexp_matches(lower(name), '(^| )(ban|cookie|cookies|prospection)( |$)') AND evidence_type = 'absence'
UNION ALL SELECT law_id, 'disclosure typed as presence' FROM law_rules WHERE regexp_matches(lower(name), '(^| )(display|notice|fees|endorsements)( |$)') AND evidence_type = 'presence'""")
def polarity_lint(spark, sf):
    """Duties to show something need proof of absence, bans proof of presence; the wording says which it is."""
    name, kind = F.lower("name"), F.col("evidence_type")
    return quality.violations(
        _rules(spark, sf), F.col("law_id"), ("prohibition typed as absence", ~(name.rlike("(^| )(ban|cookie|cookies|prospection)( |$)") & (kind == "absence"))),
        ("disclosure typed as presence", ~(name.rlike("(^| )(display|notice|fees|endorsements)( |$)") & (kind == "presence")))).select(F.col("key").alias("law_id"), F.col("rule").alias("problem"))


#: Patterns of detection rules with an example each must match.
EXAMPLES = ((1, "(^|[^a-z])fees?([^a-z]|$)", "our fees are"), (2, "guaranteed? results", "guaranteed results"), (3, "cookies", None), (4, "deposit of £[0-9]+", "a deposit was paid"), (5, "^by appointment", "By appointment"), (6, "registered (office|in) [A-Z]", "registered in England"))


@query(f"""WITH p(id, pattern, example) AS (VALUES {', '.join('(' + str(i) + ", '" + x + "', " + ('NULL' if e is None else "'" + e + "'") + ')' for i, x, e in EXAMPLES)})
SELECT id, CASE WHEN length(pattern) > 2000 THEN 'too long' WHEN example IS NULL THEN 'no example' WHEN NOT regexp_matches(example, pattern) THEN 'example not matched' END AS problem FROM p""")
def regex_health(spark, sf):
    p = spark.createDataFrame(list(EXAMPLES), "id int, pattern string, example string")
    why = gates.first_failure((F.length("pattern") <= 2000, "too long"), (F.col("example").isNotNull(), "no example"), (F.regexp_like(F.col("example"), F.col("pattern")), "example not matched"))
    return p.select("id", why.alias("problem"))


@query("""SELECT law_id, 'no currency' AS problem FROM law_rules WHERE statutory_max IS NOT NULL AND currency IS NULL UNION ALL SELECT law_id, 'no penalty band' FROM law_rules WHERE statutory_max IS NULL
UNION ALL SELECT law_id, 'threshold without exclusion' FROM law_rules WHERE statutory_max >= 17500000 AND NOT list_contains(sector, 'universal') AND sub_jurisdiction IS NULL""")
def threshold_guard(spark, sf):
    """A rule with a threshold needs the clause that says whom it spares."""
    top = F.coalesce(F.col("statutory_max") >= 17_500_000, F.lit(False))
    rules = (("no currency", F.col("statutory_max").isNull() | F.col("currency").isNotNull()), ("no penalty band", F.col("statutory_max").isNotNull()), ("threshold without exclusion", ~top | F.array_contains("sector", "universal") | F.col("sub_jurisdiction").isNotNull()))
    return quality.violations(_rules(spark, sf), F.col("law_id"), *rules).select(F.col("key").alias("law_id"), F.col("rule").alias("problem"))


_V = lambda name, rows: f"{name} AS (VALUES {', '.join(str(r) for r in rows)})"
_MORE = (*RULE_SUBS, ("UK_AD_CODE", "braces"), ("UK_LETTING_FEES", "advice"))


@query(f"""WITH {_V('b(law_id, sub)', _MORE)}, {_V('v(word, sub, parent)', SUB_SECTORS)}
SELECT b.law_id, b.sub, CASE WHEN v.sub IS NULL THEN 'unknown sub-sector' WHEN NOT (list_contains(r.sector, v.parent) OR list_contains(r.sector, 'universal')) THEN 'parent not bound' END AS problem FROM b JOIN law_rules r USING (law_id) LEFT JOIN v ON v.sub = b.sub""")
def sub_sector_reach(spark, sf):
    """A sub-sector that a rule names must exist, and the rule must bind the sector above it."""
    b = spark.createDataFrame(list(_MORE), "law_id string, sub string").join(match.small(_rules(spark, sf).select("law_id", F.col("sector").alias("sectors"))), "law_id")
    j = b.join(F.broadcast(spark.createDataFrame(list(SUB_SECTORS), "word string, sub string, parent string")), "sub", "left")
    why = gates.first_failure((F.col("parent").isNotNull(), "unknown sub-sector"), (F.array_contains("sectors", F.col("parent")) | F.array_contains("sectors", "universal"), "parent not bound"))
    return j.select("law_id", "sub", why.alias("problem"))


_CANON = "concat_ws('|', law_id, name, jurisdiction, coalesce(sub_jurisdiction, '~'), array_to_string(list_sort(sector), ','), evidence_type, coalesce(CAST(CAST(statutory_max AS BIGINT) AS VARCHAR), '~'), coalesce(currency, '~'), CAST(verified_date AS VARCHAR), status)"


@query(f"""WITH c AS (SELECT law_id, status, sha256({_CANON}) AS content FROM law_rules), s AS (SELECT law_id, CASE WHEN status = 'draft' THEN sha256(content) ELSE content END AS approved FROM c WHERE law_id NOT LIKE 'FR%')
SELECT c.law_id, CASE WHEN s.law_id IS NULL THEN 'not approved' WHEN approved <> content THEN 'changed since approval' ELSE 'approved' END AS state FROM c LEFT JOIN s USING (law_id)""")
def approval_hash(spark, sf):
    """Rules against the hash under which they were approved: the canonical form names its fields in one order and its nulls."""
    c = _rules(spark, sf).select("law_id", "status", F.sha2(V.canonical("law_id", "name", "jurisdiction", "sub_jurisdiction", F.array_join(F.array_sort("sector"), ","), "evidence_type", F.col("statutory_max").cast("long").cast("string"), "currency", F.col("verified_date").cast("string"), "status"), 256).alias("content"))
    s = c.where("law_id not like 'FR%'").select("law_id", F.when(F.col("status") == "draft", F.sha2("content", 256)).otherwise(F.col("content")).alias("approved"))
    return c.join(s, "law_id", "left").select("law_id", F.when(F.col("approved").isNull(), "not approved").when(F.col("approved") != F.col("content"), "changed since approval").otherwise("approved").alias("state"))


@query("""WITH p AS (SELECT bundle_id, og_site_name AS name, regexp_extract(text, 'Company number ([0-9]{8})', 1) AS number, text, title FROM site_pages WHERE og_site_name IS NOT NULL AND text IS NOT NULL)
SELECT bundle_id, name, number, bool_or(contains(lower(text), lower(trim(name)))) AS name_grounded, bool_or(contains(lower(coalesce(title, '')), lower(trim(name)))) AS in_title FROM p GROUP BY ALL""")
def grounded_proposals(spark, sf):
    """Proposed names and numbers of firms, and whether the text they were read from holds them word for word."""
    p = table(spark, sf, "site_pages").where("og_site_name is not null and text is not null").select("bundle_id", F.col("og_site_name").alias("name"), F.regexp_extract("text", "Company number ([0-9]{8})", 1).alias("number"), "text", F.coalesce("title", F.lit("")).alias("title"))
    holds = lambda c: F.bool_or(F.contains(F.lower(c), F.lower(F.trim("name"))))
    return p.groupBy("bundle_id", "name", "number").agg(holds("text").alias("name_grounded"), holds("title").alias("in_title"))


@query("""SELECT doc_id, 'language' AS problem FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es') UNION ALL SELECT doc_id, 'length' FROM documents WHERE n_chars IS DISTINCT FROM length(text)
UNION ALL SELECT doc_id, 'type' FROM documents WHERE doc_type IS NULL UNION ALL SELECT doc_id, 'blank' FROM documents WHERE text IS NULL OR trim(text) = ''""")
def label_lint(spark, sf):
    """Labels of a corpus that contradict their rows, all rules in one pass."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "doc_type", "text")
    rules = (("language", F.col("lang").isin("en", "de", "fr", "es")), ("length", F.col("n_chars").eqNullSafe(F.length("text").cast("long"))), ("type", F.col("doc_type").isNotNull()), ("blank", F.col("text").isNotNull() & (F.trim("text") != "")))
    return quality.violations(d, F.col("doc_id"), *rules).select(F.col("key").alias("doc_id"), F.col("rule").alias("problem"))


@query("""WITH p AS (SELECT bundle_id, count(*) AS pages FROM site_pages GROUP BY bundle_id)
SELECT bundle_id, CASE WHEN unreachable AND (pages IS NOT NULL OR footer_text IS NOT NULL) THEN 'facts of an unreachable site' WHEN NOT unreachable AND pages IS NULL THEN 'nothing read' WHEN unreachable THEN 'abstains' ELSE 'facts' END AS state FROM site_bundles LEFT JOIN p USING (bundle_id)""")
def facts_abstain(spark, sf):
    """What could not be reached must claim nothing."""
    p = table(spark, sf, "site_pages").groupBy("bundle_id").agg(F.count("*").alias("pages"))
    b = table(spark, sf, "site_bundles").select("bundle_id", "unreachable", "footer_text").join(p, "bundle_id", "left")
    none = F.col("pages").isNull()
    state = F.when(F.col("unreachable") & (~none | F.col("footer_text").isNotNull()), "facts of an unreachable site").when(~F.col("unreachable") & none, "nothing read").when(F.col("unreachable"), "abstains").otherwise("facts")
    return b.select("bundle_id", state.alias("state"))


@query("""SELECT row_id, 'no quote' AS problem FROM enforcement_actions WHERE offending_quote IS NULL UNION ALL SELECT row_id, 'no checksum' FROM enforcement_actions WHERE sha256 IS NULL OR NOT regexp_matches(sha256, '^[0-9a-f]{64}$')
UNION ALL SELECT row_id, 'no law' FROM enforcement_actions WHERE law_ids IS NULL OR len(law_ids) = 0 UNION ALL SELECT row_id, 'penalty without currency' FROM enforcement_actions WHERE penalty_amount IS NOT NULL AND currency IS NULL
UNION ALL SELECT row_id, 'address not secure' FROM enforcement_actions WHERE NOT starts_with(lower(url), 'https://')""")
def finding_well_formed(spark, sf):
    a = table(spark, sf, "enforcement_actions")
    rules = (
        ("no quote", F.col("offending_quote").isNotNull()), ("no checksum", F.col("sha256").rlike("^[0-9a-f]{64}$")), ("no law", F.size("law_ids") > 0),
        ("penalty without currency", F.col("penalty_amount").isNull() | F.col("currency").isNotNull()), ("address not secure", F.startswith(F.lower("url"), F.lit("https://"))),
    )
    return quality.violations(a, F.col("row_id"), *rules).select(F.col("key").alias("row_id"), F.col("rule").alias("problem"))


@query("""WITH b AS (SELECT source, batch_no, count(*) AS n, count(*) - count(DISTINCT id) AS twice, count(*) FILTER (WHERE sha256 IS NULL) AS unsigned, count(*) FILTER (WHERE len(law_ids) = 0) AS lawless, count(*) FILTER (WHERE offending_quote IS NULL) AS unquoted FROM enforcement_actions GROUP BY ALL)
SELECT source, batch_no, CASE WHEN n > 2000 THEN 'too many findings' WHEN twice > 0 THEN 'duplicates' WHEN unsigned > 0 THEN 'unsigned' WHEN lawless > 0 THEN 'catalogue' WHEN unquoted * 5 > n THEN 'quotes' ELSE 'accepted' END AS code FROM b""")
def report_gate(spark, sf):
    """Each batch of a source with the first refusal in a fixed order."""
    b = table(spark, sf, "enforcement_actions").groupBy("source", "batch_no").agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("id")).alias("twice"), F.count_if(F.col("sha256").isNull()).alias("unsigned"), F.count_if(F.size("law_ids") == 0).alias("lawless"), F.count_if(F.col("offending_quote").isNull()).alias("unquoted"))
    why = gates.first_failure((F.col("n") <= 2000, "too many findings"), (F.col("twice") == 0, "duplicates"), (F.col("unsigned") == 0, "unsigned"), (F.col("lawless") == 0, "catalogue"), (F.col("unquoted") * 5 <= F.col("n"), "quotes"))
    return b.select("source", "batch_no", F.coalesce(why, F.lit("accepted")).alias("code"))


@query("""WITH q AS (SELECT a.source, a.row_id, bool_or(r.law_id IS NULL) AS unresolved, bool_or(a.offending_quote IS NULL) AS unquoted FROM (SELECT source, row_id, offending_quote, unnest(law_ids) AS law_id FROM enforcement_actions) a LEFT JOIN law_rules r USING (law_id) GROUP BY ALL)
SELECT source, count(*) AS rows_checked, count(*) FILTER (WHERE unresolved) AS unresolved, count(*) FILTER (WHERE unquoted) AS unquoted, count(*) FILTER (WHERE unresolved OR unquoted) = 0 AS passes FROM q GROUP BY source""")
def pre_persist_gate(spark, sf):
    """Nothing is stored whose references do not resolve or whose quotes are missing."""
    a = table(spark, sf, "enforcement_actions").select("source", "row_id", "offending_quote", F.explode("law_ids").alias("law_id"))
    j = a.join(match.small(_rules(spark, sf).select("law_id").withColumn("_r", F.lit(True))), "law_id", "left").groupBy("source", "row_id").agg(F.bool_or(F.col("_r").isNull()).alias("u"), F.bool_or(F.col("offending_quote").isNull()).alias("q"))
    return j.groupBy("source").agg(F.count("*").alias("rows_checked"), F.count_if("u").alias("unresolved"), F.count_if("q").alias("unquoted"), (F.count_if(F.col("u") | F.col("q")) == 0).alias("passes"))


@query("""SELECT law_id, name IS NOT NULL AND trim(name) <> '' AND length(jurisdiction) = 2 AND len(sector) > 0 AND evidence_type IN ('presence', 'absence', 'register', 'behavioural') AS shaped, CASE WHEN sub_jurisdiction IS NULL THEN 'no sub-jurisdiction' WHEN sub_jurisdiction = 'multi' THEN 'several' ELSE 'one' END AS reach FROM law_rules""")
def shape_rejects(spark, sf):
    """Whether a rule has the shape that the gates can read; what has not is set aside before them."""
    ok = F.col("name").isNotNull() & (F.trim("name") != "") & (F.length("jurisdiction") == 2) & (F.size("sector") > 0) & F.col("evidence_type").isin("presence", "absence", "register", "behavioural")
    sub = F.col("sub_jurisdiction")
    return _rules(spark, sf).select("law_id", ok.alias("shaped"), F.when(sub.isNull(), "no sub-jurisdiction").when(sub == "multi", "several").otherwise("one").alias("reach"))


@query("""WITH p AS (SELECT bundle_id, count(*) AS pages FROM site_pages WHERE text IS NOT NULL GROUP BY bundle_id), b AS (SELECT bundle_id, domain, fetched_at, unreachable, coalesce(pages, 0) AS pages, footer_text FROM site_bundles LEFT JOIN p USING (bundle_id))
SELECT bundle_id, 'done without a page' AS alarm FROM b WHERE NOT unreachable AND pages = 0 UNION ALL SELECT bundle_id, 'no footer' FROM b WHERE NOT unreachable AND footer_text IS NULL
UNION ALL SELECT bundle_id, 'stale' FROM b WHERE fetched_at < TIMESTAMP '2026-03-01 00:00:00' UNION ALL SELECT bundle_id, 'from the future' FROM b WHERE fetched_at > TIMESTAMP '2026-09-01 00:00:00'""")
def reconcile_alarms(spark, sf):
    """What a table of jobs says against what is stored: every alarm of every crawl."""
    p = table(spark, sf, "site_pages").where("text is not null").groupBy("bundle_id").agg(F.count("*").alias("pages"))
    b = table(spark, sf, "site_bundles").select("bundle_id", "fetched_at", "unreachable", "footer_text").join(p, "bundle_id", "left")
    at = lambda s: F.lit(s).cast("timestamp")
    rules = (("done without a page", F.col("unreachable") | (F.coalesce("pages", F.lit(0)) > 0)), ("no footer", F.col("unreachable") | F.col("footer_text").isNotNull()), ("stale", F.col("fetched_at").isNull() | (F.col("fetched_at") >= at("2026-03-01 00:00:00"))), ("from the future", F.col("fetched_at").isNull() | (F.col("fetched_at") <= at("2026-09-01 00:00:00"))))
    return quality.violations(b, F.col("bundle_id"), *rules).select(F.col("key").alias("bundle_id"), F.col("rule").alias("alarm"))


@query("""WITH p AS (SELECT bundle_id, count(*) AS pages FROM site_pages WHERE text IS NOT NULL GROUP BY bundle_id)
SELECT b.bundle_id, CASE WHEN b.unreachable THEN 'failed' WHEN coalesce(p.pages, 0) = 0 THEN 'empty' WHEN b.footer_text IS NULL OR coalesce(b.truncated, false) THEN 'partial' ELSE 'complete' END AS state FROM site_bundles b LEFT JOIN p USING (bundle_id)""")
def completion_states(spark, sf):
    """The state that a crawl's checks amount to, the worst first."""
    p = table(spark, sf, "site_pages").where("text is not null").groupBy("bundle_id").agg(F.count("*").alias("pages"))
    b = table(spark, sf, "site_bundles").join(p, "bundle_id", "left")
    part = F.col("footer_text").isNull() | F.coalesce("truncated", F.lit(False))
    return b.select("bundle_id", F.when(F.col("unreachable"), "failed").when(F.coalesce("pages", F.lit(0)) == 0, "empty").when(part, "partial").otherwise("complete").alias("state"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS job FROM events)
SELECT user_id, coalesce(job, 0)::BIGINT AS job, count(*) FILTER (WHERE event_type = 'error') AS attempts, bool_or(event_type = 'purchase') AS done, least(power(2, least(count(*) FILTER (WHERE event_type = 'error'), 10)), 600)::BIGINT AS wait_s, count(*) FILTER (WHERE event_type = 'error') >= 5 AND NOT bool_or(event_type = 'purchase') AS dead FROM e GROUP BY ALL""")
def queue_attempts(spark, sf):
    """Jobs of a queue from its log: attempts that failed, whether the job was done, how long to wait, and whether it is given up."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf, "events").select("user_id", "event_type", F.coalesce(F.sum((F.col("event_type") == "purchase").cast("long")).over(w), F.lit(0)).alias("job"))
    failed, done = F.count_if(F.col("event_type") == "error"), F.bool_or(F.col("event_type") == "purchase")
    return e.groupBy("user_id", "job").agg(failed.alias("attempts"), done.alias("done"), F.least(F.pow(F.lit(2), F.least(failed, F.lit(10))), F.lit(600.0)).cast("long").alias("wait_s"), ((failed >= 5) & ~done).alias("dead"))
