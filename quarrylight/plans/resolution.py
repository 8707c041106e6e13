"""Who a site belongs to: names refused or looked up, and the verdict on a firm's identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import url as U
from quarrylight.operators import gates, match, order
from quarrylight.plans.pages import _URL
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table

GENERIC = "home|homepage|welcome|index|blog|news|contact|about us|untitled"


@query(f"""WITH {_URL}, c AS (SELECT page_id, trim(coalesce(og_site_name, '')) AS n, string_split(registered, '.')[1] AS stem FROM r JOIN site_pages USING (page_id))
SELECT page_id, CASE WHEN n = '' THEN 'empty' WHEN length(n) < 3 THEN 'too short' WHEN length(n) > 80 THEN 'too long' WHEN regexp_matches(lower(n), '^({GENERIC})$') THEN 'generic' WHEN regexp_matches(lower(n), 'https?://|www[.]') THEN 'address' WHEN regexp_matches(n, '[.!?]$') AND len(string_split(n, ' ')) > 6 THEN 'sentence' WHEN regexp_matches(n, '^[0-9 ]+$') THEN 'number' END AS reason FROM c""")
def identity_rejects(spark, sf):
    """Why a typed site name cannot be a firm's, the first of seven reasons; null if it can."""
    n = F.trim(F.coalesce("og_site_name", F.lit("")))
    why = gates.first_failure(
        (n != "", "empty"), (F.length(n) >= 3, "too short"), (F.length(n) <= 80, "too long"), (~F.lower(n).rlike(f"^({GENERIC})$"), "generic"), (~F.lower(n).rlike("https?://|www[.]"), "address"),
        (~(n.rlike("[.!?]$") & (F.size(F.split(n, " ")) > 6)), "sentence"), (~n.rlike("^[0-9 ]+$"), "number"))
    return table(spark, sf, "site_pages").select("page_id", why.alias("reason"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array({0}, ' +'), lambda x: x <> ''))"
_NORMAL = "trim(array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({0}), '&', ' and ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +'), lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{x}'" for x in T.LEGAL_FORMS) + ")), ' '))"
_REGISTER = f"""reg AS (SELECT DISTINCT {_NORMAL.format('entity_name')} AS name FROM enforcement_actions), regw AS (SELECT name, {_WORDS.format('name')} AS w FROM reg WHERE name <> ''),
ask AS (SELECT DISTINCT {_NORMAL.format('og_site_name')} AS asked FROM site_pages WHERE og_site_name IS NOT NULL), askw AS (SELECT asked, {_WORDS.format('asked')} AS w FROM ask WHERE asked <> ''),
best AS (SELECT a.asked, r.name, len(list_intersect(a.w, r.w)) / (len(a.w) + len(r.w) - len(list_intersect(a.w, r.w))) AS score FROM askw a JOIN regw r ON len(list_intersect(a.w, r.w)) > 0),
top AS (SELECT asked, min_by(name, (-score, name)) AS name, max(score) AS score FROM best GROUP BY asked)"""


def _lookup(spark, sf, least: float):
    reg = table(spark, sf, "enforcement_actions").select(T.normal_name("entity_name").alias("name")).where("name <> ''").distinct().withColumn("tokens", F.array_distinct(F.split("name", " ")))
    ask = table(spark, sf, "site_pages").where("og_site_name is not null").select(T.normal_name("og_site_name").alias("asked")).where("asked <> ''").distinct().withColumn("tokens", F.array_distinct(F.split("asked", " ")))
    return ask, match.best_name(ask, "asked", reg, "name", "tokens", least)


@query(f"""WITH {_REGISTER} SELECT a.asked, CASE WHEN t.name = a.asked THEN 'exact' WHEN t.score >= 0.75 THEN 'close' WHEN t.score >= 0.5 THEN 'weak' ELSE 'none' END AS tier, CASE WHEN t.score >= 0.5 THEN t.name END AS name FROM askw a LEFT JOIN top t USING (asked)""")
def register_lookup_tiers(spark, sf):
    """Names looked up in a register: the same name, then one that shares three quarters of its words, then half."""
    ask, best = _lookup(spark, sf, 0.5)
    tier = F.when(F.col("name") == F.col("asked"), "exact").when(F.col("score") >= 0.75, "close").when(F.col("score") >= 0.5, "weak").otherwise("none")
    return ask.select("asked").join(best, "asked", "left").select("asked", tier.alias("tier"), "name")


@query(f"""WITH {_REGISTER}, n AS (SELECT domain, {_NORMAL.format('og_site_name')} AS asked, count(*) AS pages FROM site_pages WHERE og_site_name IS NOT NULL GROUP BY ALL),
f AS (SELECT domain, min_by(asked, (-pages, asked)) AS asked FROM n WHERE asked <> '' GROUP BY domain),
i AS (SELECT domain, max(nullif(regexp_extract(footer_text, 'Company number ([0-9]{{8}})', 1), '')) AS number, count(DISTINCT nullif(regexp_extract(footer_text, 'Company number ([0-9]{{8}})', 1), '')) AS numbers, max(nullif(regexp_extract(footer_text, '([A-Z]{{2}}[0-9]{{1,2}}) ?[0-9][A-Z]{{2}}', 1), '')) AS district FROM site_bundles GROUP BY domain),
k AS (SELECT domain, count(DISTINCT register) FILTER (WHERE kind = 'matched') AS matched FROM register_notes GROUP BY domain),
s AS (SELECT i.domain, f.asked, number, numbers, coalesce(t.score, 0) AS score, 3 * (number IS NOT NULL)::INT + 2 * (district IS NOT NULL)::INT + least(coalesce(matched, 0), 2) AS points FROM i LEFT JOIN f USING (domain) LEFT JOIN top t ON t.asked = f.asked LEFT JOIN k USING (domain))
SELECT domain, CASE WHEN numbers > 1 THEN 'CONFLICT' WHEN number IS NOT NULL AND asked IS NOT NULL AND score < 0.35 THEN 'CONFLICT' WHEN number IS NOT NULL AND score >= 0.6 AND points >= 3 THEN 'CONFIRMED' WHEN number IS NULL AND score >= 0.75 AND points >= 4 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END AS verdict, points FROM s""")
def entity_resolution(spark, sf):
    """The firm behind a site: by its number if it shows one, by name only otherwise, and then with more corroboration."""
    pages = table(spark, sf, "site_pages").where("og_site_name is not null").groupBy("domain", T.normal_name("og_site_name").alias("asked")).agg(F.count("*").alias("pages")).where("asked <> ''")
    named = order.keep_first(pages, ["domain"], [F.desc("pages"), F.col("asked")]).select("domain", "asked")
    found = lambda p: F.nullif(F.regexp_extract("footer_text", p, 1), F.lit(""))
    number = found("Company number ([0-9]{8})")
    ids = table(spark, sf, "site_bundles").groupBy("domain").agg(F.max(number).alias("number"), F.count_distinct(number).alias("numbers"), F.max(found("([A-Z]{2}[0-9]{1,2}) ?[0-9][A-Z]{2}")).alias("district"))
    notes = table(spark, sf, "register_notes").groupBy("domain").agg(F.count_distinct(F.when(F.col("kind") == "matched", F.col("register"))).alias("matched"))
    # A score below the least of all, or no name that shares a rare word, is a conflict.
    _, best = _lookup(spark, sf, 0.35)
    s = ids.join(named, "domain", "left").join(best, "asked", "left").join(notes, "domain", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    some = lambda c: F.col(c).isNotNull().cast("int")
    s = s.withColumn("points", (3 * some("number") + 2 * some("district") + F.least(F.coalesce("matched", F.lit(0)), F.lit(2))).cast("long"))
    has = F.col("number").isNotNull()
    verdict = F.when(F.col("numbers") > 1, "CONFLICT").when(has & F.col("asked").isNotNull() & (F.col("score") < 0.35), "CONFLICT").when(has & (F.col("score") >= 0.6) & (F.col("points") >= 3), "CONFIRMED").when(~has & (F.col("score") >= 0.75) & (F.col("points") >= 4), "CONFIRMED").otherwise("UNRESOLVED")
    return s.select("domain", verdict.alias("verdict"), "points")


_PAGES_LD = """j AS (SELECT page_id, json_ld FROM site_pages WHERE json_ld IS NOT NULL AND json_valid(json_ld)), a AS (SELECT page_id, unnest(CASE WHEN json_type(json_ld) = 'ARRAY' THEN CAST(json_ld AS JSON[]) ELSE [CAST(json_ld AS JSON)] END) AS node FROM j)"""


@query(f"""WITH {_PAGES_LD} SELECT json_extract_string(node, '$."@type"') AS type, count(*) AS nodes, count(DISTINCT json_extract_string(node, '$.name')) AS names FROM a GROUP BY ALL""")
def json_ld_walk(spark, sf):
    """Every node of the structured data of every page, whether it stands alone or in a list."""
    v = F.try_parse_json("json_ld")
    nodes = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    n = table(spark, sf, "site_pages").where(v.isNotNull()).select(F.explode(nodes).alias("node"))
    get = lambda p: F.try_variant_get("node", p, "string")
    return n.groupBy(get('$["@type"]').alias("type")).agg(F.count("*").alias("nodes"), F.count_distinct(get("$.name")).alias("names"))


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","k":' || coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), 'null') || ',"user_id":' || user_id || '}') AS canonical FROM events""")
def canonical_hash(spark, sf):
    """A hash of fields in one order, nulls written out."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    doc = F.to_json(F.struct("event_type", k.alias("k"), "user_id"), {"ignoreNullFields": "false"})
    return table(spark, sf, "events").select("event_id", F.sha2(doc, 256).alias("canonical"))


@query(r"""WITH u AS (SELECT doc_id, text, strlen(text) AS bytes, position('£' IN text) AS pl FROM documents WHERE text IS NOT NULL)
SELECT doc_id, bytes, CASE WHEN pl > 0 THEN strlen(substring(text, 1, pl - 1)) END AS byte_at, sha256(CASE WHEN pl > 0 THEN substring(text, pl, 12) ELSE text END) AS span_sha256 FROM u""")
def byte_spans(spark, sf):
    """Places counted in bytes, and the hash of the bytes of a span, for texts in any script."""
    at = F.instr("text", "£")
    u = table(spark, sf, "documents").where("text is not null").withColumn("at", at)
    span = F.when(F.col("at") > 0, F.expr("substring(text, at, 12)")).otherwise(F.col("text"))
    return u.select("doc_id", F.octet_length("text").alias("bytes"), F.when(F.col("at") > 0, F.octet_length(F.expr("substring(text, 1, at - 1)"))).alias("byte_at"), F.sha2(span, 256).alias("span_sha256"))


@query("""WITH t AS (SELECT domain, og_site_name AS name FROM site_pages WHERE og_site_name IS NOT NULL), v(word, code, family) AS (VALUES ('dental', 'dental', 'health'), ('pharmacy', 'pharmacy', 'retail'), ('estate', 'estate-agency', 'property'), ('property', 'estate-agency', 'property'), ('solicitors', 'legal', 'professional'), ('wealth', 'finance', 'professional'), ('clinic', 'clinic', 'health'))
SELECT domain, v.code, v.family, count(*) AS names FROM t JOIN v ON contains(' ' || regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || v.word || ' ') GROUP BY ALL""")
def vocabulary_lookup(spark, sf):
    """Words of names to codes and families of a small vocabulary: an equi-join on words."""
    v = F.broadcast(spark.createDataFrame([("dental", "dental", "health"), ("pharmacy", "pharmacy", "retail"), ("estate", "estate-agency", "property"), ("property", "estate-agency", "property"), ("solicitors", "legal", "professional"), ("wealth", "finance", "professional"), ("clinic", "clinic", "health")], "word string, code string, family string"))
    t = table(spark, sf, "site_pages").where("og_site_name is not null").select("domain", F.explode(F.array_distinct(T.words("og_site_name"))).alias("word"))
    return t.join(v, "word").groupBy("domain", "code", "family").agg(F.count("*").alias("names"))


_TESTIMONIAL = "would recommend|highly recommend|thank you|told us that|helped me|five stars"


@query(f"""WITH p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM site_pages WHERE text IS NOT NULL)
SELECT page_id, len(list_filter(s, lambda x: regexp_matches(lower(x), '{_TESTIMONIAL}'))) AS testimonials, len(s) AS sentences FROM p""")
def testimonials(spark, sf):
    """Sentences that repeat what others said; they are no claims of the site."""
    s = T.sentences("text")
    return table(spark, sf, "site_pages").where("text is not null").select("page_id", F.size(F.filter(s, lambda x: F.lower(x).rlike(_TESTIMONIAL))).alias("testimonials"), F.size(s).alias("sentences"))
