"""Queries from evidence to judgement: gates, proofs, votes, graded facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import gates, order, rollup
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table

#: Sector words of names and the sector that they speak for.
SECTORS = (("dental", "dental"), ("estate", "estate-agency"), ("property", "estate-agency"), ("care", "care"), ("medical", "care"), ("solicitors", "legal"), ("wealth", "finance"), ("retail", "retail"), ("pharmacy", "retail"))
_SECTORS = "sec(word, sector) AS (VALUES " + ", ".join(str(x) for x in SECTORS) + ")"


def _firms(spark, sf):
    """A firm for each name: where decisions bind it, its sector, and what is known of its activities."""
    cases = F.array_distinct(F.filter(F.array(*(F.when(T.holds_word("entity_name", w), s) for w, s in SECTORS)), lambda x: x.isNotNull()))
    a = table(spark, sf, "enforcement_actions").groupBy("entity_name").agg(F.array_sort(F.collect_set("jurisdiction")).alias("bound"), F.bool_or(F.col("penalty_amount").isNotNull()).alias("fined"), F.bool_or(F.col("offending_quote").isNotNull()).alias("quoted"))
    return a.withColumn("sectors", cases).withColumn("facts", F.create_map(F.lit("presence"), F.col("quoted"), F.lit("register"), F.col("fined"), F.lit("absence"), F.lit(None).cast("boolean")))


_HAS = "regexp_matches(lower(entity_name), '(^|[^a-z0-9_])(' || word || ')([^a-z0-9_]|$)')"
_FIRMS = f"""{_SECTORS}, a AS (SELECT entity_name, list_sort(list(DISTINCT jurisdiction)) AS bound, bool_or(penalty_amount IS NOT NULL) AS fined, bool_or(offending_quote IS NOT NULL) AS quoted FROM enforcement_actions GROUP BY entity_name),
firms AS (SELECT *, coalesce((SELECT list(DISTINCT sector) FROM sec WHERE {_HAS}), []) AS sectors FROM a)"""
_GATED = f"""{_FIRMS}, g AS (SELECT f.entity_name, r.law_id, r.name, CASE
  WHEN NOT (r.sub_jurisdiction IS NULL OR r.sub_jurisdiction = 'multi') THEN 'sub-jurisdiction'
  WHEN r.jurisdiction = 'EU' AND list_contains(f.bound, 'FR') THEN 'displaced'
  WHEN NOT (list_contains(r.sector, 'universal') OR len(list_intersect(r.sector, f.sectors)) > 0) THEN 'sector'
  WHEN r.evidence_type = 'presence' AND f.quoted = false OR r.evidence_type = 'register' AND f.fined = false THEN 'activity'
  END AS reason FROM firms f JOIN law_rules r ON list_contains(f.bound, r.jurisdiction))"""


def _gated(spark, sf):
    rules = table(spark, sf, "law_rules").select("law_id", "name", "jurisdiction", "sub_jurisdiction", F.col("sector").alias("rule_sectors"), "evidence_type")
    # The first gate is an equi-join: a rule meets the firms that its jurisdiction binds, no others.
    from quarrylight.operators.match import small

    pairs = _firms(spark, sf).withColumn("jurisdiction", F.explode("bound")).join(small(rules), "jurisdiction")
    reason = gates.first_failure(
        (F.col("sub_jurisdiction").isNull() | (F.col("sub_jurisdiction") == "multi"), "sub-jurisdiction"),
        (~((F.col("jurisdiction") == "EU") & F.array_contains("bound", "FR")), "displaced"),
        (F.array_contains("rule_sectors", "universal") | F.arrays_overlap("rule_sectors", "sectors"), "sector"),
        (~gates.all_false(F.array("evidence_type"), F.col("facts")), "activity"),
    )
    return pairs.select("entity_name", "law_id", "name", reason.alias("reason"))


@query(f"WITH {_GATED} SELECT entity_name, law_id, reason, reason IS NULL AS applicable FROM g")
def applicability_gated(spark, sf):
    return _gated(spark, sf).select("entity_name", "law_id", "reason", F.col("reason").isNull().alias("applicable"))


@query(f"""WITH {_GATED}, x AS (SELECT entity_name, reason, regexp_replace(lower(name), ' (act|code|rule)$', '') AS family FROM g)
SELECT entity_name, count(DISTINCT family) AS families_met, count(DISTINCT family) FILTER (WHERE reason IS NULL) AS families_binding, count(*) FILTER (WHERE reason IS NULL) AS rules_binding FROM x GROUP BY entity_name""")
def applicability_counts(spark, sf):
    x = _gated(spark, sf).withColumn("family", F.regexp_replace(F.lower("name"), " (act|code|rule)$", ""))
    return x.groupBy("entity_name").agg(
        F.count_distinct("family").alias("families_met"),
        F.count_distinct(F.when(F.col("reason").isNull(), F.col("family"))).alias("families_binding"), F.count_if(F.col("reason").isNull()).alias("rules_binding"))


@query(f"WITH {_GATED} SELECT reason, count(*) AS pairs FROM g GROUP BY reason")
def applicability_reasons(spark, sf):
    return _gated(spark, sf).groupBy("reason").agg(F.count("*").alias("pairs"))


CELLS = (("dental", "UK", "served"), ("*", "UK", "planned"), ("care", "US", "served"), ("legal", "EU", "planned"))


@query(f"""WITH {_FIRMS}, cell(sector, jurisdiction, state) AS (VALUES {', '.join(str(x) for x in CELLS)}),
m AS (SELECT entity_name, bool_or(state = 'served') AS served, bool_or(state = 'planned') AS planned FROM firms JOIN cell ON list_contains(bound, cell.jurisdiction) AND (cell.sector = '*' OR list_contains(sectors, cell.sector)) GROUP BY entity_name)
SELECT f.entity_name, CASE WHEN served THEN 'served' WHEN planned THEN 'planned' ELSE 'unknown' END AS cell FROM firms f LEFT JOIN m USING (entity_name)""")
def served_cell_gate(spark, sf):
    firms = _firms(spark, sf).select("entity_name", F.explode("bound").alias("jurisdiction"), "sectors")
    cells = F.broadcast(spark.createDataFrame(list(CELLS), "sector string, jurisdiction string, state string"))
    hit = firms.join(cells, "jurisdiction", "left").withColumn("_ok", (F.col("sector") == "*") | F.array_contains("sectors", F.col("sector")))
    state = lambda s: F.coalesce(F.bool_or(F.col("_ok") & (F.col("state") == s)), F.lit(False))
    return hit.groupBy("entity_name").agg(F.when(state("served"), "served").when(state("planned"), "planned").otherwise("unknown").alias("cell"))


@query(f"""WITH {_SECTORS}, n AS (SELECT DISTINCT domain, og_site_name AS entity_name FROM site_pages WHERE og_site_name IS NOT NULL),
s AS (SELECT domain, sector, count(DISTINCT word) * 2 + count(DISTINCT n.entity_name) AS score FROM n JOIN sec ON {_HAS} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, sector) AS k FROM s),
t AS (SELECT domain, max(CASE WHEN k = 1 THEN sector END) AS sector, max(CASE WHEN k = 1 THEN score END) AS score, max(CASE WHEN k = 2 THEN score END) AS rival FROM r WHERE k <= 2 GROUP BY domain)
SELECT domain, CASE WHEN score >= 3 AND (rival IS NULL OR score >= 1.5 * rival) THEN sector END AS sector, score, rival FROM t""")
def sector_score_winner(spark, sf):
    names = table(spark, sf, "site_pages").where("og_site_name is not null").select("domain", F.col("og_site_name").alias("entity_name")).distinct()
    known = F.array(*(F.when(T.holds_word("entity_name", w), F.struct(F.lit(w).alias("word"), F.lit(s).alias("sector"))) for w, s in SECTORS))
    hits = names.select("domain", "entity_name", F.explode(F.array_compact(known)).alias("h")).select("domain", "entity_name", "h.*")
    scores = hits.groupBy("domain", "sector").agg((F.count_distinct("word") * 2 + F.count_distinct("entity_name")).alias("score"))
    return rollup.winner(scores, ["domain"], "sector", "score", 3, 1.5)


_TIERS = "CASE event_type WHEN 'purchase' THEN 'A' WHEN 'signup' THEN 'B' WHEN 'click' THEN 'B' ELSE 'C' END"


@query(f"""WITH e AS (SELECT user_id, event_type AS kind, {_TIERS} AS tier, event_id FROM events),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, tier ORDER BY event_id) AS n FROM e) WHERE n <= CASE tier WHEN 'A' THEN 4 WHEN 'B' THEN 4 ELSE 5 END)
SELECT user_id, count(*) FILTER (WHERE tier = 'A') AS a, count(DISTINCT kind) FILTER (WHERE tier = 'B') AS b_kinds, 5 * count(*) FILTER (WHERE tier = 'A') + 3 * count(DISTINCT kind) FILTER (WHERE tier = 'B') + least(count(*) FILTER (WHERE tier = 'C'), 3) AS score,
  count(*) FILTER (WHERE tier = 'A') >= 1 OR count(DISTINCT kind) FILTER (WHERE tier = 'B') >= 2 AS bound FROM c GROUP BY user_id""")
def tier_score_bound(spark, sf):
    tier = F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type").isin("signup", "click"), "B").otherwise("C")
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("kind"), tier.alias("tier"), "event_id")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id", "tier").orderBy("event_id"))
    kept = e.withColumn("_n", n).where(F.col("_n") <= F.when(F.col("tier") == "C", 5).otherwise(4))
    a, b, c = F.count_if(F.col("tier") == "A"), F.count_distinct(F.when(F.col("tier") == "B", F.col("kind"))), F.count_if(F.col("tier") == "C")
    return kept.groupBy("user_id").agg(a.alias("a"), b.alias("b_kinds"), (5 * a + 3 * b + F.least(c, F.lit(3))).alias("score"), ((a >= 1) | (b >= 2)).alias("bound"))


@query("""SELECT r_name AS bloc, bool_or(s_acctbal > 9000) AS bound, max(s_acctbal) AS score, count(DISTINCT n_name) FILTER (WHERE s_acctbal > 9000) AS members FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def bloc_membership_derived(spark, sf):
    from quarrylight.operators.match import small

    s = table(spark, sf, "supplier").join(small(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(small(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rich = F.col("s_acctbal") > 9000
    return s.groupBy(F.col("r_name").alias("bloc")).agg(F.bool_or(rich).alias("bound"), F.max("s_acctbal").alias("score"), F.count_distinct(F.when(rich, F.col("n_name"))).alias("members"))


@query("""WITH s AS (SELECT domain, count(DISTINCT (register, kind)) AS n FROM register_notes WHERE kind IN ('matched', 'degraded') GROUP BY domain)
SELECT d.domain, CASE WHEN n IS NULL THEN 'abstain' WHEN n = 1 THEN 'weak' ELSE 'corroborated' END AS grade FROM (SELECT DISTINCT domain FROM register_notes) d LEFT JOIN s USING (domain)""")
def capability_grade(spark, sf):
    n = F.count_distinct(F.when(F.col("kind").isin("matched", "degraded"), F.struct("register", "kind")))
    return table(spark, sf, "register_notes").groupBy("domain").agg(n.alias("n")).select("domain", F.when(F.col("n") == 0, "abstain").when(F.col("n") == 1, "weak").otherwise("corroborated").alias("grade"))


@query("""WITH r AS (SELECT domain, og_site_name AS name, CASE WHEN json_ld IS NOT NULL THEN 1 WHEN og_site_name = title THEN 2 ELSE 3 END AS rung FROM site_pages WHERE og_site_name IS NOT NULL),
g AS (SELECT domain, name, min(rung) AS rung, count(DISTINCT rung) AS rungs, count(*) AS pages FROM r GROUP BY ALL)
SELECT domain, name, rung, CASE WHEN rungs >= 2 THEN 'high' WHEN pages >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rung, pages DESC, name) AS k FROM g) WHERE k = 1""")
def identity_rung_winner(spark, sf):
    rung = F.when(F.col("json_ld").isNotNull(), 1).when(F.col("og_site_name") == F.col("title"), 2).otherwise(3)
    g = table(spark, sf, "site_pages").where("og_site_name is not null").select("domain", F.col("og_site_name").alias("name"), rung.alias("rung")).groupBy("domain", "name").agg(F.min("rung").alias("rung"), F.count_distinct("rung").alias("rungs"), F.count("*").alias("pages"))
    best = order.keep_first(g, ["domain"], [F.col("rung"), F.desc("pages"), F.col("name")])
    return best.select("domain", "name", "rung", F.when(F.col("rungs") >= 2, "high").when(F.col("pages") >= 2, "medium").otherwise("low").alias("confidence"))


@query("""WITH p AS (SELECT bundle_id, count(*) AS pages, count(*) FILTER (WHERE length(text) > 50) AS long_pages FROM site_pages GROUP BY bundle_id)
SELECT b.bundle_id, CASE WHEN b.unreachable THEN 'not covered' WHEN coalesce(b.spa_shell, false) THEN 'raw surface' WHEN b.footer_text IS NULL THEN 'no footer' WHEN coalesce(p.pages, 0) < 3 THEN 'few pages' WHEN p.long_pages < 1 THEN 'no text'
  WHEN b.truncated IS DISTINCT FROM false THEN 'truncation not excluded' END AS suppressed FROM site_bundles b LEFT JOIN p USING (bundle_id)""")
def absence_interlock(spark, sf):
    p = table(spark, sf, "site_pages").groupBy("bundle_id").agg(F.count("*").alias("pages"), F.count_if(F.length("text") > 50).alias("long_pages"))
    b = table(spark, sf, "site_bundles").join(p, "bundle_id", "left")
    why = gates.first_failure((~F.col("unreachable"), "not covered"), (~F.coalesce("spa_shell", F.lit(False)), "raw surface"), (F.col("footer_text").isNotNull(), "no footer"), (F.coalesce("pages", F.lit(0)) >= 3, "few pages"), (F.col("long_pages") >= 1, "no text"), (~F.col("truncated"), "truncation not excluded"))
    return b.select("bundle_id", why.alias("suppressed"))


@query("""SELECT domain, CASE WHEN bool_or(contains(lower(text), 'complaints procedure')) THEN 'present' WHEN bool_or(contains(lower(url), 'complaint')) THEN 'partial' ELSE 'absent' END AS state FROM site_pages GROUP BY domain""")
def required_presence_state(spark, sf):
    hit, part = F.bool_or(F.lower("text").contains("complaints procedure")), F.bool_or(F.lower("url").contains("complaint"))
    return table(spark, sf, "site_pages").groupBy("domain").agg(F.when(hit, "present").when(part, "partial").otherwise("absent").alias("state"))


@query("""SELECT DISTINCT a.domain, a.register FROM (SELECT d.domain, r.register FROM (SELECT DISTINCT domain FROM site_bundles) d CROSS JOIN (SELECT DISTINCT register FROM register_notes) r) a
WHERE NOT EXISTS (SELECT 1 FROM register_notes n WHERE n.domain = a.domain AND n.register = a.register AND n.kind = 'matched') AND EXISTS (SELECT 1 FROM register_notes n WHERE n.domain = a.domain AND n.register = a.register AND n.kind = 'no_match')""")
def register_absence_proved(spark, sf):
    notes = table(spark, sf, "register_notes").select("domain", "register", "kind")
    asked = table(spark, sf, "site_bundles").select("domain").distinct().join(notes.select("domain", "register").distinct(), "domain")
    return gates.proved_absent(asked, notes.where("kind = 'matched'"), notes.where("kind = 'no_match'"), ["domain", "register"])


@query("""SELECT domain, register, kind FROM register_notes WHERE register NOT IN (SELECT register FROM register_notes WHERE kind = 'degraded' GROUP BY register HAVING count(*) > 8)""")
def canary_gate(spark, sf):
    notes = table(spark, sf, "register_notes")
    failed = notes.where("kind = 'degraded'").groupBy("register").agg(F.count("*").alias("n")).where("n > 8").select("register")
    return notes.select("domain", "register", "kind").join(F.broadcast(failed) if failed.limit(1001).count() <= 1000 else failed, "register", "left_anti").select("domain", "register", "kind")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click') AND ts < DATE '2024-01-15') AS before_consent, count(*) FILTER (WHERE event_type IN ('view', 'click') AND ts >= DATE '2024-01-15') AS after_consent,
  min(event_id) FILTER (WHERE event_type = 'click' AND ts < DATE '2024-01-15') AS first_event FROM events GROUP BY user_id""")
def preconsent_diff(spark, sf):
    seen, early = F.col("event_type").isin("view", "click"), F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(seen & early).alias("before_consent"), F.count_if(seen & ~early).alias("after_consent"), F.min(F.when((F.col("event_type") == "click") & early, F.col("event_id"))).alias("first_event"))


@query("""SELECT row_id, CASE WHEN offending_quote IS NULL THEN 'missing' WHEN length(trim(offending_quote)) < 25 THEN 'too short' WHEN sha256 IS NULL THEN 'no checksum' WHEN NOT regexp_matches(sha256, '^[0-9a-f]{64}$') THEN 'malformed checksum' ELSE 'ok' END AS code FROM enforcement_actions""")
def artifact_verify(spark, sf):
    why = gates.first_failure((F.col("offending_quote").isNotNull(), "missing"), (F.length(F.trim("offending_quote")) >= 25, "too short"), (F.col("sha256").isNotNull(), "no checksum"), (F.col("sha256").rlike("^[0-9a-f]{64}$"), "malformed checksum"))
    return table(spark, sf, "enforcement_actions").select("row_id", F.coalesce(why, F.lit("ok")).alias("code"))


@query("""SELECT o_custkey AS task, count(DISTINCT o_orderpriority) AS families, count(DISTINCT o_orderpriority) >= 3 AND bool_or(o_orderpriority = '1-URGENT') AND bool_and(o_orderstatus <> 'P') AS agreed FROM orders GROUP BY o_custkey""")
def jury_quorum(spark, sf):
    votes = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("family"), (F.col("o_orderpriority") == "1-URGENT").alias("anchor"), F.when(F.col("o_orderstatus") == "P", "veto").otherwise("breach").alias("vote"))
    return gates.quorum(votes, ["task"], "family", "anchor", "vote", "breach", 3)


@query("""SELECT row_id, a.law_id, r.name, coalesce(r.status, 'unknown') AS status FROM (SELECT row_id, unnest(law_ids) AS law_id FROM enforcement_actions) a LEFT JOIN law_rules r USING (law_id)""")
def enrich_join(spark, sf):
    from quarrylight.operators.match import small

    a = table(spark, sf, "enforcement_actions").select("row_id", F.explode("law_ids").alias("law_id"))
    return a.join(small(table(spark, sf, "law_rules").select("law_id", "name", "status")), "law_id", "left").select("row_id", "law_id", "name", F.coalesce("status", F.lit("unknown")).alias("status"))


@query("""SELECT source, row_id, CAST(floor((n - 1) / 10) AS BIGINT) AS batch, 'F-' || lpad(CAST(n AS VARCHAR), 6, '0') AS finding_id FROM (SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY row_id) AS n FROM enforcement_actions)""")
def batch_numbers(spark, sf):
    a = order.numbered(table(spark, sf, "enforcement_actions").select("source", "row_id"), ["source"], "row_id", 100_000)
    return a.select("source", "row_id", F.floor((F.col("n") - 1) / 10).cast("long").alias("batch"), F.concat(F.lit("F-"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("finding_id"))


@query("""SELECT row_id, 3 * CAST(offending_quote IS NOT NULL AND summary IS NOT NULL AS INTEGER) + 3 * CAST(currency IN ('GBP', 'EUR', 'USD') OR currency IS NULL AS INTEGER) + 4 * CAST(contains(summary, entity_name) AS INTEGER) AS score FROM enforcement_actions""")
def rubric_score(spark, sf):
    i = lambda c: c.cast("int")
    return table(spark, sf, "enforcement_actions").select("row_id", (3 * i(F.col("offending_quote").isNotNull() & F.col("summary").isNotNull()) + 3 * i(F.col("currency").isin("GBP", "EUR", "USD") | F.col("currency").isNull()) + 4 * i(F.col("summary").contains(F.col("entity_name")))).alias("score"))
