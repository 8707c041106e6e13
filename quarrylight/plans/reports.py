"""Queries that sum up: precedents, exposure, severities, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import values as V
from quarrylight.operators import rollup
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table


@query("""SELECT law_id, currency, count(*) AS n, min(penalty_amount) AS low, median(penalty_amount) AS middle, max(penalty_amount) AS high, CAST(min(decision_date) AS VARCHAR) AS first_date, CAST(max(decision_date) AS VARCHAR) AS last_date,
  list_sort(list(DISTINCT source)) AS sources, count(*) < 3 AS low_confidence FROM (SELECT unnest(law_ids) AS law_id, * FROM enforcement_actions) WHERE penalty_amount IS NOT NULL GROUP BY law_id, currency""")
def precedent_ranges(spark, sf):
    a = table(spark, sf, "enforcement_actions").where("penalty_amount is not null").select(F.explode("law_ids").alias("law_id"), "currency", "penalty_amount", "decision_date", "source")
    return a.groupBy("law_id", "currency").agg(
        F.count("*").alias("n"), F.min("penalty_amount").alias("low"), F.median("penalty_amount").alias("middle"), F.max("penalty_amount").alias("high"),
        F.min("decision_date").cast("string").alias("first_date"), F.max("decision_date").cast("string").alias("last_date"), F.array_sort(F.collect_set("source")).alias("sources"), (F.count("*") < 3).alias("low_confidence"))


@query("""WITH p AS (SELECT DISTINCT law_id, lower(trim(offending_quote)) AS phrase, decision_date FROM (SELECT unnest(law_ids) AS law_id, * FROM enforcement_actions) WHERE offending_quote IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY decision_date DESC, phrase) AS k FROM p) SELECT law_id, phrase, k FROM r WHERE k <= 20""")
def lexicon_proposals(spark, sf):
    p = table(spark, sf, "enforcement_actions").where("offending_quote is not null").select(F.explode("law_ids").alias("law_id"), F.lower(F.trim("offending_quote")).alias("phrase"), "decision_date").distinct()
    return rollup.top(p, ["law_id"], [F.desc("decision_date"), F.col("phrase")], 20).select("law_id", "phrase", F.col("rank").alias("k"))


@query("""WITH f AS (SELECT entity_name, family, currency, max(penalty_amount) AS high, min(penalty_amount) AS low FROM (SELECT entity_name, currency, penalty_amount, regexp_replace(unnest(law_ids), '_[^_]*$', '') AS family FROM enforcement_actions) WHERE penalty_amount IS NOT NULL GROUP BY ALL),
c AS (SELECT entity_name, currency, sum((low + high) / 2) AS total, max(high) AS ceiling FROM f GROUP BY ALL)
SELECT entity_name, currency, round(total, 2) AS total, ceiling FROM (SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY total DESC, currency) AS k FROM c) WHERE k = 1""")
def exposure_rollup(spark, sf):
    a = table(spark, sf, "enforcement_actions").where("penalty_amount is not null").select("entity_name", "currency", "penalty_amount", F.explode("law_ids").alias("law_id")).withColumn("family", F.regexp_replace("law_id", "_[^_]*$", ""))
    f = a.groupBy("entity_name", "family", "currency").agg(F.max("penalty_amount").alias("high"), F.min("penalty_amount").alias("low"))
    c = f.groupBy("entity_name", "currency").agg(F.sum((F.col("low") + F.col("high")) / 2).alias("total"), F.max("high").alias("ceiling"))
    return rollup.top(c, ["entity_name"], [F.desc("total"), F.col("currency")], 1).select("entity_name", "currency", F.round("total", 2).alias("total"), "ceiling")


_SEVERITY = "CASE WHEN l_discount >= 0.08 THEN 'critical' WHEN l_discount >= 0.06 THEN 'high' WHEN l_discount >= 0.03 THEN 'medium' ELSE 'low' END"


@query(f"SELECT l_suppkey, {_SEVERITY} AS severity, count(*) AS n FROM lineitem GROUP BY ALL")
def severity_counts(spark, sf):
    d = F.col("l_discount")
    s = F.when(d >= 0.08, "critical").when(d >= 0.06, "high").when(d >= 0.03, "medium").otherwise("low")
    return table(spark, sf, "lineitem").groupBy("l_suppkey", s.alias("severity")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) WHEN 1 THEN 'pass' WHEN 2 THEN 'needs_review' ELSE 'violation' END AS worst FROM orders GROUP BY o_custkey""")
def worst_state(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "P", "needs_review").otherwise("violation")
    return rollup.worst(table(spark, sf, "orders").select("o_custkey", state.alias("state")), ["o_custkey"], "state", ["pass", "needs_review", "violation"])


@query("""SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'absent' WHEN p_size <= 10 THEN 'top' WHEN p_size <= 19 THEN 'near' WHEN p_size <= 40 THEN 'far' ELSE 'out' END AS band FROM part""")
def position_bands(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.banded(F.col("p_size"), [(10, "top"), (19, "near"), (40, "far")], "out", "absent").alias("band"))


@query("""WITH p AS (SELECT user_id, event_type AS provider, avg(CASE WHEN value > 10 THEN 100.0 ELSE 0.0 END) AS rate FROM events GROUP BY ALL) SELECT user_id, round(least(100, greatest(0, median(rate))), 4) AS share FROM p GROUP BY user_id""")
def share_of_voice_median(spark, sf):
    p = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("provider")).agg(F.avg(F.when(F.col("value") > 10, 100.0).otherwise(0.0)).alias("rate"))
    return p.groupBy("user_id").agg(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.median("rate"))), 4).alias("share"))


@query("""SELECT l_partkey AS rival, count(DISTINCT l_orderkey) AS runs FROM lineitem GROUP BY l_partkey ORDER BY runs DESC, rival LIMIT 25""")
def competitor_frequency(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("rival")).agg(F.count_distinct("l_orderkey").alias("runs"))
    return rollup.top(c, [], [F.desc("runs"), F.col("rival")], 25)


@query("""SELECT source, count(*) FILTER (WHERE penalty_amount IS NOT NULL AND offending_quote IS NOT NULL) AS tp, count(*) FILTER (WHERE penalty_amount IS NULL AND offending_quote IS NOT NULL) AS fp, count(*) FILTER (WHERE penalty_amount IS NOT NULL AND offending_quote IS NULL) AS fn,
  round(coalesce(count(*) FILTER (WHERE penalty_amount IS NOT NULL AND offending_quote IS NOT NULL) / nullif(count(*) FILTER (WHERE offending_quote IS NOT NULL), 0), 1), 6) AS precision, round(count(*) FILTER (WHERE offending_quote IS NULL) / count(*), 6) AS abstain_rate FROM enforcement_actions GROUP BY source""")
def precision_abstain(spark, sf):
    q, p = F.col("offending_quote").isNotNull(), F.col("penalty_amount").isNotNull()
    return table(spark, sf, "enforcement_actions").groupBy("source").agg(
        F.count_if(p & q).alias("tp"), F.count_if(~p & q).alias("fp"), F.count_if(p & ~q).alias("fn"),
        F.round(F.coalesce(rollup.rate(F.count_if(p & q), F.count_if(q)), F.lit(1.0)), 6).alias("precision"), F.round(F.count_if(~q) / F.count("*"), 6).alias("abstain_rate"))


_RECALL = """WITH l AS (SELECT DISTINCT jurisdiction, law_id FROM (SELECT jurisdiction, unnest(law_ids) AS law_id FROM enforcement_actions)), r AS (SELECT jurisdiction, law_id FROM law_rules WHERE status = 'active'),
j AS (SELECT r.jurisdiction, count(*) AS labelled, count(l.law_id) AS found FROM r LEFT JOIN l USING (jurisdiction, law_id) GROUP BY r.jurisdiction)"""


@query(f"{_RECALL} SELECT d.jurisdiction, coalesce(labelled, 0) AS labelled, coalesce(found, 0) AS found, round(found / nullif(labelled, 0), 6) AS recall FROM (SELECT DISTINCT jurisdiction FROM enforcement_actions) d LEFT JOIN j USING (jurisdiction)")
def recall_metrics(spark, sf):
    return _recall(spark, sf).withColumn("recall", F.round("recall", 6))


def _recall(spark, sf):
    a = table(spark, sf, "enforcement_actions")
    found = a.select("jurisdiction", F.explode("law_ids").alias("law_id")).distinct().withColumn("_hit", F.lit(1))
    r = table(spark, sf, "law_rules").where("status = 'active'").select("jurisdiction", "law_id").join(found, ["jurisdiction", "law_id"], "left")
    j = r.groupBy("jurisdiction").agg(F.count("*").alias("labelled"), F.count("_hit").alias("found"))
    return a.select("jurisdiction").distinct().join(j, "jurisdiction", "left").na.fill(0, ["labelled", "found"]).withColumn("recall", rollup.rate(F.col("found"), F.col("labelled")))


@query(f"{_RECALL} SELECT round(avg(found / nullif(labelled, 0)), 6) AS macro, round(sum(found) / sum(labelled), 6) AS micro, count(*) AS groups FROM j")
def recall_scorecard(spark, sf):
    r = _recall(spark, sf).where("labelled > 0")
    return r.agg(F.round(F.avg("recall"), 6).alias("macro"), F.round(F.sum("found") / F.sum("labelled"), 6).alias("micro"), F.count("*").alias("groups"))


@query("""WITH s AS (SELECT count(*) AS pages, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank, count(*) FILTER (WHERE og_site_name IS NOT NULL) AS named FROM site_pages)
SELECT 'blank' AS budget, round(blank / pages, 6) AS value, blank / pages <= 0.05 AS ok FROM s UNION ALL SELECT 'named', round(named / pages, 6), named / pages >= 0.4 FROM s UNION ALL SELECT 'vacuous', CAST(pages AS DOUBLE), pages > 0 FROM s""")
def budget_gate(spark, sf):
    s = table(spark, sf, "site_pages").agg(F.count("*").alias("pages"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"), F.count_if(F.col("og_site_name").isNotNull()).alias("named"))
    rows = F.array(
        F.struct(F.lit("blank").alias("budget"), F.round(F.col("blank") / F.col("pages"), 6).alias("value"), (F.col("blank") / F.col("pages") <= 0.05).alias("ok")),
        F.struct(F.lit("named").alias("budget"), F.round(F.col("named") / F.col("pages"), 6).alias("value"), (F.col("named") / F.col("pages") >= 0.4).alias("ok")),
        F.struct(F.lit("vacuous").alias("budget"), F.col("pages").cast("double").alias("value"), (F.col("pages") > 0).alias("ok")))
    return s.select(F.inline(rows))


@query("""SELECT o_orderpriority, l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def join_rollup(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority", "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))
