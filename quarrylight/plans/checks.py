"""Queries that look for bad data, and compare what should agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import values as V
from quarrylight.operators import quality
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table


@query("""SELECT CAST(row_id AS VARCHAR) AS key, unnest(list_filter([CASE WHEN coalesce(NOT regexp_matches(id, '^[A-Z]+-[0-9a-f]{12}$'), true) THEN 'id shape' END, CASE WHEN penalty_amount IS NOT NULL AND currency IS NULL THEN 'currency missing' END,
  CASE WHEN NOT starts_with(url, 'https://') THEN 'url scheme' END, CASE WHEN offending_quote IS NULL THEN 'quote missing' END], lambda x: x IS NOT NULL)) AS rule FROM enforcement_actions""")
def constraint_violations(spark, sf):
    a = table(spark, sf, "enforcement_actions")
    return quality.violations(a, F.col("row_id").cast("string"), ("id shape", F.col("id").rlike("^[A-Z]+-[0-9a-f]{12}$")), ("currency missing", F.col("penalty_amount").isNull() | F.col("currency").isNotNull()), ("url scheme", F.col("url").startswith("https://")), ("quote missing", F.col("offending_quote").isNotNull()))


@query("SELECT id, count(*) AS copies FROM enforcement_actions GROUP BY id HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "enforcement_actions"), ["id"])


@query("SELECT page_id, bundle_id FROM site_pages WHERE bundle_id IS NOT NULL AND bundle_id NOT IN (SELECT bundle_id FROM site_bundles WHERE NOT coalesce(truncated, false))")
def orphan_citations(spark, sf):
    b = table(spark, sf, "site_bundles").where("not coalesce(truncated, false)")
    return quality.orphans(table(spark, sf, "site_pages").select("page_id", "bundle_id"), "bundle_id", b, "bundle_id").select("page_id", "bundle_id")


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '£([0-9][0-9,]*)', 1)) AS amount FROM documents WHERE text IS NOT NULL), k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '£([0-9][0-9,]*)', 1)) AS amount FROM site_pages WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, amount FROM m WHERE amount NOT IN (SELECT amount FROM k)""")
def money_provenance_anti(spark, sf):
    a = lambda t, *k: table(spark, sf, t).where("text is not null").select(*k, F.explode(F.regexp_extract_all("text", F.lit("£([0-9][0-9,]*)"), F.lit(1))).alias("amount")).distinct()
    return a("documents", "doc_id").join(a("site_pages"), "amount", "left_anti").select("doc_id", "amount")


_SETS = "a AS (SELECT DISTINCT domain FROM site_bundles), b AS (SELECT DISTINCT domain FROM register_notes WHERE kind = 'matched')"


def _sets(spark, sf):
    return table(spark, sf, "site_bundles").select("domain"), table(spark, sf, "register_notes").where("kind = 'matched'").select("domain")


@query(f"WITH {_SETS} SELECT domain FROM a UNION SELECT domain FROM b")
def set_union(spark, sf):
    a, b = _sets(spark, sf)
    return a.union(b).distinct()


@query(f"WITH {_SETS} SELECT domain FROM a INTERSECT SELECT domain FROM b")
def set_intersect(spark, sf):
    a, b = _sets(spark, sf)
    return a.intersect(b)


@query(f"WITH {_SETS} SELECT domain FROM a EXCEPT SELECT domain FROM b")
def set_except(spark, sf):
    a, b = _sets(spark, sf)
    return a.distinct().join(b, "domain", "left_anti")


@query("SELECT 'pages' AS part, bundle_id, url FROM site_pages UNION ALL SELECT 'footer', bundle_id, domain || '#footer' FROM site_bundles WHERE footer_text IS NOT NULL")
def set_union_all(spark, sf):
    pages = table(spark, sf, "site_pages").select(F.lit("pages").alias("part"), "bundle_id", "url")
    footers = table(spark, sf, "site_bundles").where("footer_text is not null").select(F.lit("footer").alias("part"), "bundle_id", F.concat("domain", F.lit("#footer")).alias("url"))
    return pages.unionByName(footers)


@query("""WITH p AS (SELECT DISTINCT register AS item FROM register_notes UNION SELECT 'tax-index'), h AS (SELECT item, count(*) AS times FROM (SELECT DISTINCT register AS item, 'run' AS part FROM register_notes WHERE kind = 'matched' UNION ALL SELECT 'care-index', 'skipped' UNION ALL SELECT 'ship-index', 'skipped') GROUP BY item)
SELECT item, problem FROM (SELECT coalesce(p.item, h.item) AS item, CASE WHEN p.item IS NULL THEN 'unplanned' WHEN h.item IS NULL THEN 'missing' WHEN times > 1 THEN 'twice' END AS problem FROM p FULL JOIN h ON p.item = h.item) WHERE problem IS NOT NULL""")
def partition_cover(spark, sf):
    notes = table(spark, sf, "register_notes")
    planned = notes.select(F.col("register").alias("item")).distinct().union(spark.createDataFrame([("tax-index",)], "item string"))
    run = notes.where("kind = 'matched'").select(F.col("register").alias("item")).distinct()
    return quality.covers(planned, ("run", run), ("skipped", spark.createDataFrame([("care-index",), ("ship-index",)], "item string")))


@query("""WITH a AS (SELECT law_id, status AS v FROM law_rules), b AS (SELECT law_id, CASE WHEN statutory_max IS NULL THEN 'draft' ELSE status END AS v FROM law_rules WHERE jurisdiction <> 'FR' UNION ALL SELECT 'XX_NEW', 'draft')
SELECT coalesce(a.law_id, b.law_id) AS law_id, a.v AS left_value, b.v AS right_value, CASE WHEN a.law_id IS NULL THEN 'added' WHEN b.law_id IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.law_id = b.law_id WHERE a.v IS DISTINCT FROM b.v OR a.law_id IS NULL OR b.law_id IS NULL""")
def golden_full_outer_diff(spark, sf):
    r = table(spark, sf, "law_rules")
    fresh = r.where("jurisdiction <> 'FR'").select("law_id", F.when(F.col("statutory_max").isNull(), "draft").otherwise(F.col("status")).alias("v")).union(spark.createDataFrame([("XX_NEW", "draft")], "law_id string, v string"))
    return quality.difference(r.select("law_id", F.col("status").alias("v")), fresh, ["law_id"], "v")


@query("""SELECT law_id, CASE WHEN verified_date > DATE '2026-01-02' THEN 'in the future' WHEN verified_date < DATE '2025-04-01' THEN 'stale' END AS alarm FROM law_rules WHERE verified_date > DATE '2026-01-02' OR verified_date < DATE '2025-04-01'""")
def freshness_window(spark, sf):
    d = F.col("verified_date").cast("date")
    alarm = F.when(d > F.lit("2026-01-02").cast("date"), "in the future").when(d < F.lit("2025-04-01").cast("date"), "stale")
    return table(spark, sf, "law_rules").select("law_id", alarm.alias("alarm")).where("alarm is not null")


@query("""SELECT row_id, substring(summary, 1, 0) || contains(' ' || regexp_replace(summary, '[^0-9]+', ' ', 'g') || ' ', ' ' || CAST(length(id) AS VARCHAR) || ' ') AS holds FROM enforcement_actions""")
def count_token_presence(spark, sf):
    return table(spark, sf, "enforcement_actions").select("row_id", T.holds_number("summary", F.length("id")).cast("string").alias("holds"))


@query("""SELECT row_id, try_strptime(d, '%Y-%m-%d') IS NOT NULL AND strftime(try_strptime(d, '%Y-%m-%d'), '%Y-%m-%d') = d AS real_date FROM (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN '2024-02-3' || CAST(row_id % 2 AS VARCHAR) ELSE CAST(decision_date AS VARCHAR) END AS d FROM enforcement_actions)""")
def valid_dates(spark, sf):
    d = F.when(F.col("row_id") % 5 == 0, F.concat(F.lit("2024-02-3"), (F.col("row_id") % 2).cast("string"))).otherwise(F.col("decision_date").cast("date").cast("string"))
    return table(spark, sf, "enforcement_actions").select("row_id", d.alias("d")).select("row_id", V.real_date("d").alias("real_date"))


@query("""WITH h AS (SELECT p_partkey, lpad(printf('%x', (p_partkey * 7919) % 16777216), 6, '0') AS a, lpad(printf('%x', (p_partkey * 104729) % 16777216), 6, '0') AS b FROM part),
c AS (SELECT p_partkey, list_transform([a[1:2], a[3:4], a[5:6], b[1:2], b[3:4], b[5:6]], lambda x: CAST('0x' || x AS INTEGER) / 255) AS v FROM h),
l AS (SELECT p_partkey, list_transform(v, lambda x: CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) AS v FROM c),
y AS (SELECT p_partkey, 0.2126 * v[1] + 0.7152 * v[2] + 0.0722 * v[3] AS a, 0.2126 * v[4] + 0.7152 * v[5] + 0.0722 * v[6] AS b FROM l)
SELECT p_partkey, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 3) AS contrast, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 3) >= 4.5 AS readable FROM y""")
def contrast_ratio(spark, sf):
    h = lambda n: F.lpad(F.lower(F.hex((F.col("p_partkey") * n) % 16777216)), 6, "0")
    c = F.round(V.contrast(h(7919), h(104729)), 3)
    return table(spark, sf, "part").select("p_partkey", c.alias("contrast"), (c >= 4.5).alias("readable"))


@query("""WITH l AS (SELECT bundle_id, generate_subscripts(x, 1) AS i, trim(unnest(x)) AS line FROM (SELECT bundle_id, string_split(footer_text, chr(10)) AS x FROM site_bundles WHERE footer_text IS NOT NULL)), b AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY bundle_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM l)
SELECT bundle_id, block, count(*) FILTER (WHERE line <> '') AS lines, min(i) AS first_line FROM b GROUP BY ALL""")
def line_groups(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("bundle_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = table(spark, sf, "site_bundles").where("footer_text is not null").select("bundle_id", F.posexplode(F.split("footer_text", "\n", -1)).alias("_p", "line")).select("bundle_id", (F.col("_p") + 1).alias("i"), F.trim("line").alias("line"))
    b = lines.withColumn("block", F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(w))
    return b.groupBy("bundle_id", "block").agg(F.count_if(F.col("line") != "").alias("lines"), F.min("i").alias("first_line"))


@query("""SELECT o_orderkey, format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS shown FROM orders""")
def group_thousands(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.format_number(F.round("o_totalprice").cast("long"), 0).alias("shown"))


@query("""WITH a AS (SELECT law_id, unnest([struct_pack(path := 'name', value := name), struct_pack(path := 'status', value := status), struct_pack(path := 'sub', value := sub_jurisdiction)]) AS x FROM law_rules)
SELECT law_id, x.path AS path, x.value AS value FROM a""")
def flattened_paths(spark, sf):
    r = table(spark, sf, "law_rules").select("law_id", "name", "status", F.col("sub_jurisdiction").alias("sub"))
    return r.unpivot(["law_id"], ["name", "status", "sub"], "path", "value")


@query("""SELECT domain, 3 * CAST(bool_or(register = 'company-index' AND kind = 'matched') AS INTEGER) + 2 * CAST(bool_or(register = 'care-index' AND kind = 'matched') AS INTEGER) + CAST(bool_or(reason IS NOT NULL) AS INTEGER) AS score FROM register_notes GROUP BY domain""")
def corroboration_score(spark, sf):
    hit = lambda r: F.bool_or((F.col("register") == r) & (F.col("kind") == "matched")).cast("int")
    return table(spark, sf, "register_notes").groupBy("domain").agg((3 * hit("company-index") + 2 * hit("care-index") + F.bool_or(F.col("reason").isNotNull()).cast("int")).alias("score"))


@query("""WITH f AS (SELECT DISTINCT register, kind FROM register_notes) SELECT register, count(*) FILTER (WHERE kind = 'matched') > 0 AS ran, string_agg(kind, ',' ORDER BY kind) AS kinds FROM f GROUP BY register""")
def lane_status(spark, sf):
    return table(spark, sf, "register_notes").groupBy("register").agg(F.bool_or(F.col("kind") == "matched").alias("ran"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("""WITH m AS (SELECT law_id, map_from_entries([('status', status), ('type', evidence_type)]) AS m FROM law_rules) SELECT law_id, m['type'] AS type, coalesce(m['none'], 'absent') AS none FROM m""")
def map_lookup(spark, sf):
    m = F.create_map(F.lit("status"), F.col("status"), F.lit("type"), F.col("evidence_type"))
    return table(spark, sf, "law_rules").select("law_id", F.element_at(m, "type").alias("type"), F.coalesce(F.try_element_at(m, F.lit("none")), F.lit("absent")).alias("none"))
