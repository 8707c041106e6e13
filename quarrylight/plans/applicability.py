"""The gated semi-join in full: which rule applies to which firm, and the first gate that says no.

A rule meets the firms that its jurisdiction binds by an equi-join; what the
shape and jurisdiction gates exclude is counted, not paired.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import gates
from quarrylight.operators.match import small
from quarrylight.plans.evidence import _FIRMS, _firms
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table

#: Rules that step back where another rule binds, and that other rule.
DISPLACED = (("US_FAIR_ADS", "US_NY_RULE_7"), ("EU_GDPR_ART_6", "FR_DATA_LAW"), ("EU_COOKIE_RULE", "FR_COOKIES"), ("UK_PRIVACY_REGS", "UK_DATA_ACT"))
#: Sub-sectors by word of a name, with the sector above each.
SUB_SECTORS = (("letting", "lettings", "estate-agency"), ("dental", "dental-practice", "dental"), ("pharmacy", "pharmacy", "retail"), ("wealth", "advice", "finance"), ("homes", "care-home", "care"))
#: Rules for some sub-sectors only.
RULE_SUBS = (("UK_LETTING_FEES", "lettings"), ("US_HIPAA_164", "pharmacy"), ("US_HIPAA_164", "care-home"), ("EU_AIR_CLAIMS", "dental-practice"))
#: Activities that must be known to be carried on, and the ties to a place of which one must hold.
REQUIRED = (("UK_CARE_STANDARDS", "register"), ("US_COPPA_312", "presence"))
NEXUS = (("UK_FEES_DISPLAY", "established_in"), ("FR_PROSPECTION", "serves"), ("FR_PROSPECTION", "established_in"), ("US_ENDORSEMENTS", "serves"), ("EU_GDPR_ART_32", "orbits"))

_V = lambda name, rows: f"{name} AS (VALUES {', '.join(str(r) for r in rows)})"
_PARTS = f"""{_FIRMS}, {_V('disp(law_id, displacer)', DISPLACED)}, {_V('subw(word, sub, parent)', SUB_SECTORS)}, {_V('rsub(law_id, sub)', RULE_SUBS)}, {_V('req(law_id, tag)', REQUIRED)}, {_V('nex(law_id, nexus)', NEXUS)},
ties AS (SELECT entity_name, jurisdiction, count(*) FILTER (WHERE penalty_amount IS NOT NULL) >= 1 AS established, list(DISTINCT CASE WHEN jurisdiction = 'UK' AND currency = 'GBP' THEN 'ENG' WHEN jurisdiction = 'US' AND penalty_amount > 100000 THEN 'NY' END) AS subs FROM enforcement_actions GROUP BY ALL),
bind AS (SELECT t.entity_name, r.law_id FROM ties t JOIN law_rules r ON r.jurisdiction = t.jurisdiction WHERE r.status = 'active'),
fsub AS (SELECT entity_name, coalesce((SELECT list(DISTINCT sub) FROM subw WHERE regexp_matches(lower(entity_name), '(^|[^a-z0-9_])(' || word || ')([^a-z0-9_]|$)')), []) AS firm_subs FROM firms),
p AS (SELECT f.entity_name, r.law_id, r.name, r.jurisdiction, len(r.sector) + 1 AS obligations, t.established,
  r.sub_jurisdiction IS NULL OR r.sub_jurisdiction = 'multi' OR coalesce(list_contains(t.subs, r.sub_jurisdiction), false) AS g_sub,
  NOT EXISTS (SELECT 1 FROM disp d JOIN bind b ON b.law_id = d.displacer WHERE d.law_id = r.law_id AND b.entity_name = f.entity_name) AS g_displaced,
  list_contains(r.sector, 'universal') OR len(list_intersect(r.sector, f.sectors)) > 0 AS g_sector,
  NOT EXISTS (SELECT 1 FROM rsub WHERE rsub.law_id = r.law_id) OR EXISTS (SELECT 1 FROM rsub WHERE rsub.law_id = r.law_id AND list_contains(s.firm_subs, rsub.sub)) AS g_sub_sector,
  NOT (r.evidence_type = 'presence' AND f.quoted = false OR r.evidence_type = 'register' AND f.fined = false) AS g_activity,
  NOT EXISTS (SELECT 1 FROM req WHERE req.law_id = r.law_id AND NOT coalesce(CASE tag WHEN 'presence' THEN f.quoted WHEN 'register' THEN f.fined END, false)) AS g_required,
  NOT EXISTS (SELECT 1 FROM nex WHERE nex.law_id = r.law_id) OR EXISTS (SELECT 1 FROM nex WHERE nex.law_id = r.law_id AND (nexus = 'serves' OR nexus = 'established_in' AND t.established)) AS g_nexus
  FROM firms f JOIN ties t USING (entity_name) JOIN fsub s USING (entity_name) JOIN law_rules r ON r.jurisdiction = t.jurisdiction),
g AS (SELECT *, CASE WHEN NOT g_sub THEN 'sub-jurisdiction' WHEN NOT g_displaced THEN 'displaced' WHEN NOT g_sector THEN 'sector' WHEN NOT g_sub_sector THEN 'sub-sector' WHEN NOT g_activity THEN 'activity' WHEN NOT g_required THEN 'required activity' WHEN NOT g_nexus THEN 'nexus' END AS reason FROM p)"""


def _table(spark, rows, schema):
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def _ties(spark, sf):
    """What ties each firm to each place that binds it."""
    sub = F.when((F.col("jurisdiction") == "UK") & (F.col("currency") == "GBP"), "ENG").when((F.col("jurisdiction") == "US") & (F.col("penalty_amount") > 100_000), "NY")
    a = table(spark, sf, "enforcement_actions").select("entity_name", "jurisdiction", "currency", "penalty_amount")
    return a.groupBy("entity_name", "jurisdiction").agg((F.count("penalty_amount") >= 1).alias("established"), F.collect_set(sub).alias("subs"))


def displaced(rules_of_firms, bound_rules, pairs, rule: str, displacer: str, firm: str):
    """The anti-join of displacement: pairs of firm and rule whose displacer is bound to the firm, to be taken away."""
    return rules_of_firms.join(pairs, rule).join(bound_rules.select(firm, F.col(rule).alias(displacer)), [firm, displacer], "left_semi").select(firm, rule).distinct()


def _gates(spark, sf):
    rules = small(table(spark, sf, "law_rules").select("law_id", "name", "jurisdiction", "sub_jurisdiction", F.col("sector").alias("rule_sectors"), "evidence_type", "status"))
    subs = F.array_compact(F.array(*(F.when(T.holds_word("entity_name", w), s) for w, s, _ in SUB_SECTORS)))
    ties = _ties(spark, sf)
    pairs = _firms(spark, sf).withColumn("firm_subs", subs).join(ties, "entity_name").join(rules, "jurisdiction")
    gone = displaced(pairs.select("entity_name", "law_id"), pairs.where("status = 'active'").select("entity_name", "law_id"), _table(spark, DISPLACED, "law_id string, displacer string"), "law_id", "displacer", "entity_name")
    lists = lambda rows, name: spark.createDataFrame(list(rows), "law_id string, x string").groupBy("law_id").agg(F.collect_set("x").alias(name))
    for rows, name in ((RULE_SUBS, "rule_subs"), (REQUIRED, "required"), (NEXUS, "nexus")):
        pairs = pairs.join(F.broadcast(lists(rows, name)), "law_id", "left")
    pairs = pairs.join(gone.withColumn("_gone", F.lit(True)), ["entity_name", "law_id"], "left")
    none = F.array().cast("array<string>")
    tied = lambda n: (n == "serves") | ((n == "established_in") & F.col("established"))
    flags = (
        ("g_sub", F.col("sub_jurisdiction").isNull() | (F.col("sub_jurisdiction") == "multi") | F.array_contains("subs", F.col("sub_jurisdiction"))), ("g_displaced", F.col("_gone").isNull()),
        ("g_sector", F.array_contains("rule_sectors", "universal") | F.arrays_overlap("rule_sectors", "sectors")), ("g_sub_sector", F.col("rule_subs").isNull() | F.arrays_overlap("rule_subs", "firm_subs")),
        ("g_activity", ~gates.all_false(F.array("evidence_type"), F.col("facts"))), ("g_required", gates.all_true(F.coalesce("required", none), F.col("facts"))), ("g_nexus", F.col("nexus").isNull() | F.exists("nexus", tied)),
    )
    pairs = pairs.select("*", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags))
    names = dict(zip((n for n, _ in flags), ("sub-jurisdiction", "displaced", "sector", "sub-sector", "activity", "required activity", "nexus")))
    return pairs.withColumn("obligations", F.size("rule_sectors") + 1).withColumn("reason", gates.first_failure(*((F.col(n), why) for n, why in names.items())))


@query(f"WITH {_PARTS} SELECT entity_name, law_id, reason FROM g")
def applicability_full(spark, sf):
    return _gates(spark, sf).select("entity_name", "law_id", "reason")


@query(f"WITH {_PARTS} SELECT entity_name, law_id, g_sub, g_displaced, g_sector, g_sub_sector, g_activity, g_required, g_nexus FROM g")
def applicability_gates(spark, sf):
    return _gates(spark, sf).select("entity_name", "law_id", "g_sub", "g_displaced", "g_sector", "g_sub_sector", "g_activity", "g_required", "g_nexus")


@query(f"WITH {_PARTS} SELECT entity_name, law_id FROM g WHERE NOT g_displaced")
def displacement_anti(spark, sf):
    return _gates(spark, sf).where("not g_displaced").select("entity_name", "law_id")


@query(f"""WITH {_PARTS}, n AS (SELECT count(*) AS rules, count(*) FILTER (WHERE status = 'draft' AND sub_jurisdiction IS NULL) AS unshaped FROM law_rules),
m AS (SELECT entity_name, count(*) AS met FROM p GROUP BY entity_name)
SELECT entity_name, reason, count(*) AS rules FROM g WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT entity_name, 'jurisdiction', rules - met FROM m, n WHERE rules > met""")
def applicability_excluded(spark, sf):
    """How many rules each gate excludes for each firm; those of other jurisdictions are what is left of all rules."""
    g = _gates(spark, sf)
    every = table(spark, sf, "law_rules").agg(F.count("*").alias("_all"))
    by_gate = g.where("reason is not null").groupBy("entity_name", "reason").agg(F.count("*").alias("rules"))
    other = g.groupBy("entity_name").agg(F.count("*").alias("_met")).join(F.broadcast(every), F.lit(True)).select("entity_name", F.lit("jurisdiction").alias("reason"), (F.col("_all") - F.col("_met")).alias("rules")).where("rules > 0")
    return by_gate.unionByName(other)


@query(f"""WITH {_PARTS} SELECT entity_name, count(DISTINCT regexp_replace(lower(name), ' (act|code|rule)$', '')) AS families_met,
  count(DISTINCT regexp_replace(lower(name), ' (act|code|rule)$', '')) FILTER (WHERE reason IS NULL) AS families_binding, coalesce(sum(obligations) FILTER (WHERE reason IS NULL), 0)::BIGINT AS obligations FROM g GROUP BY entity_name""")
def applicability_obligations(spark, sf):
    g = _gates(spark, sf).withColumn("family", F.regexp_replace(F.lower("name"), " (act|code|rule)$", ""))
    binds = F.col("reason").isNull()
    return g.groupBy("entity_name").agg(F.count_distinct("family").alias("families_met"), F.count_distinct(F.when(binds, F.col("family"))).alias("families_binding"), F.coalesce(F.sum(F.when(binds, F.col("obligations"))), F.lit(0)).cast("long").alias("obligations"))


_EDGES = (("lettings", "estate-agency"), ("sales", "estate-agency"), ("care-home", "care"), ("pharmacy", "retail"), ("retail", "commerce"), ("care", "health"), ("dental", "health"), ("dental-practice", "dental"), ("health", "services"), ("advice", "finance"), ("finance", "services"))


@query(f"""WITH RECURSIVE {_V('e(child, parent)', _EDGES)}, c(child, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT c.child, e.parent, depth + 1 FROM c JOIN e ON e.child = c.ancestor)
SELECT w.word, c.ancestor, c.depth FROM (VALUES {', '.join(f"('{w}', '{s}')" for w, s, _ in SUB_SECTORS)}) w(word, sub) JOIN c ON c.child = w.sub""")
def synonym_closure(spark, sf):
    """Every sector above a sub-sector: the closure of a small vocabulary, joined until nothing is added."""
    edges = spark.createDataFrame(list(_EDGES), "child string, parent string")
    return gates.closure(edges, "child", "parent").join(F.broadcast(spark.createDataFrame([(s, w) for w, s, _ in SUB_SECTORS], "child string, word string")), "child").select("word", "ancestor", "depth")


@query("""WITH b AS (SELECT entity_name, jurisdiction, max(CASE WHEN penalty_amount > 100000 THEN 2 WHEN penalty_amount IS NOT NULL THEN 1 ELSE 0 END) AS rank FROM enforcement_actions GROUP BY ALL)
SELECT entity_name, jurisdiction, CASE rank WHEN 2 THEN 'bound' WHEN 1 THEN 'advisory' ELSE 'unknown' END AS status FROM b""")
def sub_jurisdiction_status(spark, sf):
    """The strongest status of each place: bound beats advisory."""
    rank = F.when(F.col("penalty_amount") > 100_000, 2).when(F.col("penalty_amount").isNotNull(), 1).otherwise(0)
    b = table(spark, sf, "enforcement_actions").groupBy("entity_name", "jurisdiction").agg(F.max(rank).alias("_r"))
    return b.select("entity_name", "jurisdiction", F.when(F.col("_r") == 2, "bound").when(F.col("_r") == 1, "advisory").otherwise("unknown").alias("status"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS serves FROM events WHERE event_type NOT IN ('purchase') GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'view') >= 1""")
def service_reach(spark, sf):
    """What a firm reaches without being bound by it: kinds of weak evidence, with at least one view."""
    e = table(spark, sf, "events").where("event_type <> 'purchase'")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("serves"), F.count_if(F.col("event_type") == "view").alias("_v")).where("_v >= 1").drop("_v")
