"""From patterns to verdicts: what is proposed from texts, verified against stored pages, and judged."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import gates, match
from quarrylight.plans.registry import query
from quarrylight.plans.texts import _SENTENCES, _STOP, _TOKENS, _has, _sentences
from quarrylight.sources.tables import table

PROHIBITED = ("deposit", "fee", "fees")
_CLAUSES = "list_filter(list_transform(regexp_split_to_array(sentence, '[,;:]'), lambda x: trim(x)), lambda x: x <> '')"
_HIT = _has("x", PROHIBITED)


@query(f"""WITH {_SENTENCES}, s AS (SELECT doc_id, sent_idx, sentence, list_filter({_CLAUSES}, lambda x: {_HIT})[1] AS clause, list_filter(regexp_split_to_array(sentence, '[ \\t\\n\\r\\f ]+'), lambda x: x <> '') AS w FROM sentences WHERE {_has('sentence', PROHIBITED)})
SELECT doc_id, sent_idx, CASE WHEN {_has('clause', T.NEGATIONS)} THEN 'guarded' WHEN {_has('sentence', T.NEGATIONS)} THEN 'needs_human'
  WHEN NOT (length(sentence) >= 25 AND len(w) >= 4 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) * 10 <= len(w) * 7 AND regexp_matches(sentence, '[a-z]')) THEN 'nonprose' ELSE 'hit' END AS verdict FROM s""")
def sentence_verdict(spark, sf):
    """Sentences with a prohibited word: the negation is looked for in the hit's own clause first, then in the sentence."""
    s = _sentences(spark, sf).where(T.holds_word("sentence", *PROHIBITED))
    clause = F.get(F.filter(T.clauses("sentence"), lambda x: T.holds_word(x, *PROHIBITED)), F.lit(0))
    verdict = F.when(T.holds_word(clause, *T.NEGATIONS), "guarded").when(T.holds_word("sentence", *T.NEGATIONS), "needs_human").when(~T.is_prose("sentence"), "nonprose").otherwise("hit")
    return s.select("doc_id", "sent_idx", verdict.alias("verdict"))


_WANTED = ("notice", "file", "families")


def _all(c: str) -> str:
    return " AND ".join(_has(c, [w]) for w in _WANTED)


@query(f"""WITH {_SENTENCES}, w AS (SELECT doc_id, sent_idx, sentence AS a, lead(sentence, 1) OVER o AS b, lead(sentence, 2) OVER o AS c FROM sentences WINDOW o AS (PARTITION BY doc_id ORDER BY sent_idx)),
x AS (SELECT doc_id, sent_idx, a, a || ' ' || b AS ab, a || ' ' || b || ' ' || c AS abc FROM w)
SELECT doc_id, sent_idx, CASE WHEN {_all('a')} THEN 1 WHEN coalesce({_all('ab')}, false) THEN 2 ELSE 3 END AS size FROM x WHERE {_all('a')} OR coalesce({_all('ab')}, false) OR coalesce({_all('abc')}, false)""")
def sentence_windows(spark, sf):
    """The smallest window of one to three sentences from each place that holds all of a set of words."""
    w = Window.partitionBy("doc_id").orderBy("sent_idx")
    s = _sentences(spark, sf).select("doc_id", "sent_idx", F.col("sentence").alias("a"), F.lead("sentence", 1).over(w).alias("b"), F.lead("sentence", 2).over(w).alias("c"))
    holds = lambda c: F.coalesce(T.holds_word(c, _WANTED[0]) & T.holds_word(c, _WANTED[1]) & T.holds_word(c, _WANTED[2]), F.lit(False))
    one, two, three = holds("a"), holds(F.concat("a", F.lit(" "), "b")), holds(F.concat("a", F.lit(" "), "b", F.lit(" "), "c"))
    return s.where(one | two | three).select("doc_id", "sent_idx", F.when(one, 1).when(two, 2).otherwise(3).alias("size"))


_NORM = "lower(trim(regexp_replace({0}, '[ \\t\\n\\r\\f ]+', ' ', 'g')))"
_CLAIMS = "SELECT page_id, url || CASE WHEN page_id % 7 = 0 THEN '#footer' ELSE '' END AS url, CASE page_id % 3 WHEN 0 THEN substring(text, 11, 60) WHEN 1 THEN '  ' || upper(substring(text, 21, 50)) ELSE 'zz ' || substring(text, 11, 60) END AS quote FROM site_pages"


@query(f"""WITH c AS ({_CLAIMS}), p AS (SELECT DISTINCT url, {_NORM.format('text')} AS t FROM site_pages WHERE text IS NOT NULL)
SELECT page_id, CASE WHEN c.quote IS NULL OR length(trim(c.quote)) < 25 THEN 'too short' WHEN count(p.url) = 0 THEN 'page not found' WHEN bool_or(contains(p.t, {_NORM.format('c.quote')})) THEN 'verified' ELSE 'quote not found' END AS code
FROM c LEFT JOIN p USING (url) GROUP BY page_id, c.quote""")
def quote_by_url(spark, sf):
    """Claimed quotes looked up in the stored text of the page they name, white space and case aside."""
    pages = table(spark, sf, "site_pages").select("page_id", "url", "text")
    k = F.col("page_id") % 3
    quote = F.when(k == 0, F.substring("text", 11, 60)).when(k == 1, F.concat(F.lit("  "), F.upper(F.substring("text", 21, 50)))).otherwise(F.concat(F.lit("zz "), F.substring("text", 11, 60)))
    claims = pages.select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("#footer"))).otherwise(F.col("url")).alias("url"), quote.alias("quote"))
    return match.quotes_in_pages(claims, pages.where("text is not null"), "page_id", "url", "quote", "text", 25)


@query("""WITH v AS (SELECT row_id, CASE WHEN penalty_amount IS NOT NULL THEN 'breach' WHEN row_id % 5 = 4 THEN 'unsure' ELSE 'no_breach' END AS label, summary AS evidence, CASE WHEN row_id % 2 = 0 THEN upper(substring(summary, 3, CAST(row_id % 12 AS INTEGER))) ELSE 'never seen' END AS disproof FROM enforcement_actions)
SELECT row_id, CASE WHEN label = 'breach' THEN 'violation' WHEN label = 'no_breach' AND length(trim(disproof)) >= 6 AND contains(lower(evidence), lower(trim(disproof))) THEN 'pass' ELSE 'needs_review' END AS state FROM v""")
def verdict_parse(spark, sf):
    """A breach is a violation; no breach is a pass only with a verbatim disproof of six characters; all else needs a review."""
    a = table(spark, sf, "enforcement_actions").select("row_id", "summary", "penalty_amount")
    label = F.when(F.col("penalty_amount").isNotNull(), "breach").when(F.col("row_id") % 5 == 4, "unsure").otherwise("no_breach")
    disproof = F.when(F.col("row_id") % 2 == 0, F.upper(F.substring(F.col("summary"), F.lit(3), (F.col("row_id") % 12).cast("int")))).otherwise("never seen")
    return a.select("row_id", gates.verdict(label, F.col("summary"), disproof, 6).alias("state"))


@query("""WITH f AS (SELECT a.row_id, r.evidence_type AS declared, CASE WHEN a.sha256 IS NULL THEN 'none' WHEN a.offending_quote IS NULL THEN 'register' WHEN contains(a.url, '/archive/') THEN 'behavioural' ELSE 'presence' END AS actual FROM enforcement_actions a LEFT JOIN law_rules r ON r.law_id = a.law_ids[1])
SELECT row_id, CASE WHEN declared IS NULL OR actual = 'none' THEN 'invalid' WHEN declared <> actual AND declared NOT IN ('absence') THEN 'invalid' WHEN actual IN ('register') THEN 'direct' WHEN actual = 'behavioural' THEN 'review' ELSE 'model' END AS kind FROM f""")
def evidence_kinds(spark, sf):
    """Who may decide: a register row speaks for itself, observations are reviewed, texts go to the model, and false declarations nowhere."""
    rules = match.small(table(spark, sf, "law_rules").select("law_id", F.col("evidence_type").alias("declared")))
    actual = F.when(F.col("sha256").isNull(), "none").when(F.col("offending_quote").isNull(), "register").when(F.col("url").contains("/archive/"), "behavioural").otherwise("presence")
    f = table(spark, sf, "enforcement_actions").select("row_id", F.get("law_ids", F.lit(0)).alias("law_id"), actual.alias("actual")).join(rules, "law_id", "left")
    bad = F.col("declared").isNull() | (F.col("actual") == "none") | ((F.col("declared") != F.col("actual")) & (F.col("declared") != "absence"))
    return f.select("row_id", F.when(bad, "invalid").when(F.col("actual") == "register", "direct").when(F.col("actual") == "behavioural", "review").otherwise("model").alias("kind"))


@query("""WITH o AS (SELECT law_id, unnest(sector) AS sector, evidence_type, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 4) AS words FROM law_rules),
t AS (SELECT law_id, sector, evidence_type, unnest(words) AS token, generate_subscripts(words, 1) AS n FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY law_id, sector ORDER BY length(token) DESC, n) AS k FROM t)
SELECT o.law_id, o.sector, CASE o.evidence_type WHEN 'presence' THEN 'page' WHEN 'absence' THEN 'site' WHEN 'register' THEN 'register' ELSE 'browser' END AS surface,
  (SELECT string_agg(token, ' ' ORDER BY k) FROM r WHERE r.law_id = o.law_id AND r.sector = o.sector AND k <= 2) AS pattern, len(o.words) >= 1 AS valid FROM o""")
def pattern_specs(spark, sf):
    """Obligations compiled to specs: a surface by kind of evidence, and the two longest words, earlier ones first on ties; without a word a spec is rejected."""
    words = F.filter(T.words("name"), lambda x: F.length(x) >= 4)
    surface = F.when(F.col("evidence_type") == "presence", "page").when(F.col("evidence_type") == "absence", "site").when(F.col("evidence_type") == "register", "register").otherwise("browser")
    ranked = F.array_sort(F.transform(F.col("words"), lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("t"))))
    o = table(spark, sf, "law_rules").select("law_id", F.explode("sector").alias("sector"), surface.alias("surface"), words.alias("words"))
    return o.select("law_id", "sector", "surface", F.when(F.size("words") > 0, F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: x["t"]), " ")).alias("pattern"), (F.size("words") >= 1).alias("valid"))


PATTERNS = ((1, "phrase", "guaranteed results"), (2, "phrase", "guaranteed results"), (3, "regex", "^fees?$"), (4, "regex", "fees?"), (5, "regex", "^(a+)+$"), (6, "token", "deposit"), (7, "token", "of"), (8, "path", "/fees/"), (9, "path", "fees"), (10, "regex", "^deposit [0-9]+$"))


@query(f"""WITH p(ord, kind, value) AS (VALUES {', '.join(str(x) for x in PATTERNS)}), d AS (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY ord) AS n FROM p)
SELECT ord, kind, value, CASE WHEN n > 1 THEN 'duplicate' WHEN kind = 'regex' AND NOT (starts_with(value, '^') AND ends_with(value, '$')) THEN 'unanchored' WHEN kind = 'regex' AND regexp_matches(value, '[+*]\\)[+*]') THEN 'catastrophic' WHEN kind = 'token' AND length(value) < 4 THEN 'too short' WHEN kind = 'path' AND NOT starts_with(value, '/') THEN 'no path' END AS problem FROM d""")
def pattern_safety(spark, sf):
    """Patterns once each, first seen first, and what makes one unsafe."""
    p = spark.createDataFrame(list(PATTERNS), "ord int, kind string, value string").withColumn("n", F.row_number().over(Window.partitionBy("kind", "value").orderBy("ord")))
    v, kind = F.col("value"), F.col("kind")
    why = gates.first_failure((F.col("n") == 1, "duplicate"), ((kind != "regex") | (v.startswith("^") & v.endswith("$")), "unanchored"), ((kind != "regex") | ~v.rlike(r"[+*]\)[+*]"), "catastrophic"), ((kind != "token") | (F.length(v) >= 4), "too short"), ((kind != "path") | v.startswith("/"), "no path"))
    return p.select("ord", "kind", "value", why.alias("problem"))


_LANES = ("presence", "absence", "register", "behavioural")
_DENSE = f"""d AS (SELECT bundle_id, sum(len({_TOKENS})) AS n, sum(len(list_filter({_TOKENS}, lambda x: list_contains({_STOP}, x)))) AS stops FROM site_pages WHERE text IS NOT NULL GROUP BY bundle_id),
b AS (SELECT bundle_id, domain, unreachable, coalesce(spa_shell, false) AS shell, footer_text, n >= 60 AND stops * 1000 <= n * 5 AS foreign_text FROM site_bundles LEFT JOIN d USING (bundle_id))"""


def _readable(spark, sf):
    d = table(spark, sf, "site_pages").where("text is not null").groupBy("bundle_id").agg(F.sum(T.count_words("text")).alias("n"), F.sum(T.count_known("text", T.STOPWORDS)).alias("stops"))
    b = table(spark, sf, "site_bundles").select("bundle_id", "domain", "unreachable", F.coalesce("spa_shell", F.lit(False)).alias("shell"), "footer_text")
    return b.join(d, "bundle_id", "left").withColumn("foreign_text", (F.col("n") >= 60) & (F.col("stops") * 1000 <= F.col("n") * 5))


@query(f"WITH {_DENSE} SELECT bundle_id, coalesce(foreign_text, false) AS gated FROM b")
def nonenglish_gate(spark, sf):
    """Crawls whose texts hold hardly any English function word are left out of all text rules at once."""
    return _readable(spark, sf).select("bundle_id", F.coalesce("foreign_text", F.lit(False)).alias("gated"))


@query(f"""WITH {_DENSE}, m AS (SELECT DISTINCT domain FROM register_notes WHERE kind = 'matched'), l(lane) AS (VALUES {', '.join(f"('{x}')" for x in _LANES)})
SELECT b.bundle_id, l.lane, CASE WHEN b.unreachable THEN 'none' WHEN coalesce(b.foreign_text, false) THEN 'suppressed' WHEN l.lane = 'presence' THEN 'propose' WHEN l.lane = 'absence' THEN CASE WHEN b.shell OR b.footer_text IS NULL THEN 'suppressed' ELSE 'propose' END
  WHEN l.lane = 'register' THEN CASE WHEN m.domain IS NOT NULL THEN 'compliant' ELSE 'weak' END ELSE 'not run' END AS outcome FROM b CROSS JOIN l LEFT JOIN m USING (domain)""")
def lane_driver(spark, sf):
    """Each crawl through four lanes, as a union of branches: unreadable gives none, a foreign language suppresses all."""
    b = _readable(spark, sf).join(table(spark, sf, "register_notes").where("kind = 'matched'").select("domain").distinct().withColumn("_m", F.lit(True)), "domain", "left")
    own = {"presence": F.lit("propose"), "absence": F.when(F.col("shell") | F.col("footer_text").isNull(), "suppressed").otherwise("propose"), "register": F.when(F.col("_m"), "compliant").otherwise("weak"), "behavioural": F.lit("not run")}
    before = lambda c: F.when(F.col("unreachable"), "none").when(F.coalesce("foreign_text", F.lit(False)), "suppressed").otherwise(c)
    lanes = F.array(*(F.struct(F.lit(k).alias("lane"), before(c).alias("outcome")) for k, c in own.items()))
    return b.select("bundle_id", F.explode(lanes).alias("x")).select("bundle_id", "x.*")


EXPECTED = ((1, "click", 38, None), (2, "signup", 12, None), (3, "error", 69, "2024-01-15 00:00:00"), (4, "view", 29, None), (5, "download", 1, None))


@query("""WITH x(spec, kind, k, until) AS (VALUES (1, 'click', 38, NULL), (2, 'signup', 12, NULL), (3, 'error', 69, TIMESTAMP '2024-01-15 00:00:00'), (4, 'view', 29, NULL), (5, 'download', 1, NULL)),
e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts FROM events)
SELECT x.spec, count(e.event_id) AS observed, min(e.event_id) AS first_event FROM x LEFT JOIN e ON e.event_type = x.kind AND e.k = x.k AND (x.until IS NULL OR e.ts < x.until) GROUP BY x.spec""")
def observed_event_match(spark, sf):
    """Expected observations by kind and key, and by time where one is given."""
    x = F.broadcast(spark.createDataFrame(list(EXPECTED), "spec int, kind string, k long, until string")).withColumn("until", F.to_timestamp("until"))
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"), "ts")
    hits = e.join(x, ["kind", "k"]).where("until is null or ts < until").groupBy("spec").agg(F.count("*").alias("observed"), F.min("event_id").alias("first_event"))
    return x.select("spec").join(hits, "spec", "left").select("spec", F.coalesce("observed", F.lit(0)).alias("observed"), "first_event")


@query("""WITH a AS (SELECT 'quote' AS type, contains(summary, entity_name) AS ok FROM enforcement_actions UNION ALL SELECT 'register', kind = 'matched' FROM register_notes UNION ALL SELECT 'network', value > 0 FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT 'screenshot', NULL FROM site_bundles)
SELECT type, CASE WHEN type NOT IN ('quote', 'register', 'network') THEN 'unknown type' WHEN coalesce(ok, false) THEN 'verified' ELSE 'rejected' END AS code, count(*) AS artifacts FROM a GROUP BY ALL""")
def artifact_dispatch(spark, sf):
    """Artifacts of several kinds, each by the check of its kind; an unknown kind is never verified."""
    rows = table(spark, sf, "enforcement_actions").select(F.lit("quote").alias("type"), F.col("summary").contains(F.col("entity_name")).alias("ok"))
    rows = rows.unionByName(table(spark, sf, "register_notes").select(F.lit("register").alias("type"), (F.col("kind") == "matched").alias("ok")))
    rows = rows.unionByName(table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).select(F.lit("network").alias("type"), (F.col("value") > 0).alias("ok")))
    rows = rows.unionByName(table(spark, sf, "site_bundles").select(F.lit("screenshot").alias("type"), F.lit(None).cast("boolean").alias("ok")))
    code = F.when(~F.col("type").isin("quote", "register", "network"), "unknown type").when(F.coalesce("ok", F.lit(False)), "verified").otherwise("rejected")
    return rows.groupBy("type", code.alias("code")).agg(F.count("*").alias("artifacts"))


@query("""WITH c AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, min(n) FILTER (WHERE event_type <> 'error') AS first_ok, count(*) AS calls FROM c GROUP BY user_id)
SELECT f.user_id, c.event_type AS provider, coalesce(first_ok - 1, calls) AS failures FROM f LEFT JOIN c ON c.user_id = f.user_id AND c.n = f.first_ok""")
def provider_failover(spark, sf):
    """The first provider that answers, and how many failed before it."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    ok = F.col("event_type") != "error"
    first = e.groupBy("user_id").agg(F.min(F.when(ok, F.col("event_id"))).alias("_ok"), F.min_by("event_type", F.when(ok, F.col("event_id"))).alias("provider"))
    return e.join(first, "user_id").groupBy("user_id", "provider").agg(F.count_if(F.col("_ok").isNull() | (F.col("event_id") < F.col("_ok"))).alias("failures"))


@query("""SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'not JSON' WHEN json_extract(props, '$.k') IS NULL THEN 'field missing' WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 90 THEN 'out of range' ELSE 'ok' END AS code FROM events""")
def response_gate(spark, sf):
    """What a reply must be before anything reads it: JSON, with its field, within range."""
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "long")
    why = gates.first_failure((v.isNotNull(), "not JSON"), (k.isNotNull(), "field missing"), (k <= 90, "out of range"))
    return table(spark, sf, "events").select("event_id", F.coalesce(why, F.lit("ok")).alias("code"))


@query("""SELECT a.row_id, l.law_id, CASE WHEN r.law_id IS NULL THEN 'rule missing' WHEN r.status <> 'active' THEN 'rule not active' WHEN r.jurisdiction <> a.jurisdiction THEN 'other jurisdiction' ELSE 'ok' END AS diagnosis
FROM enforcement_actions a, unnest(a.law_ids) l(law_id) LEFT JOIN law_rules r ON r.law_id = l.law_id""")
def diagnosis_codes(spark, sf):
    """Each citation with the first thing wrong with it."""
    a = table(spark, sf, "enforcement_actions").select("row_id", F.col("jurisdiction").alias("_j"), F.explode("law_ids").alias("law_id"))
    j = a.join(match.small(table(spark, sf, "law_rules").select("law_id", "jurisdiction", "status")), "law_id", "left")
    why = gates.first_failure((F.col("status").isNotNull(), "rule missing"), (F.col("status") == "active", "rule not active"), (F.col("jurisdiction") == F.col("_j"), "other jurisdiction"))
    return j.select("row_id", "law_id", F.coalesce(why, F.lit("ok")).alias("diagnosis"))


@query("""WITH latest AS (SELECT id, max_by(summary, (batch_no, row_id)) AS summary, max(batch_no) AS batch_no FROM enforcement_actions GROUP BY id)
SELECT a.row_id, latest.batch_no AS latest_batch, a.batch_no < latest.batch_no AS superseded, coalesce(r.name, '?') AS rule FROM enforcement_actions a JOIN latest USING (id) LEFT JOIN law_rules r ON r.law_id = a.law_ids[1]""")
def finding_status_join(spark, sf):
    """Each finding with its latest status and its rule: two joins on keys."""
    a = table(spark, sf, "enforcement_actions").select("row_id", "id", "batch_no", F.get("law_ids", F.lit(0)).alias("law_id"))
    latest = a.groupBy("id").agg(F.max("batch_no").alias("latest_batch"))
    rules = match.small(table(spark, sf, "law_rules").select("law_id", "name"))
    return a.join(latest, "id").join(rules, "law_id", "left").select("row_id", "latest_batch", (F.col("batch_no") < F.col("latest_batch")).alias("superseded"), F.coalesce("name", F.lit("?")).alias("rule"))


@query("""WITH c AS (SELECT note_id, domain, register, CASE WHEN note_id % 5 = 0 THEN 'matched' ELSE kind END AS kind, reason FROM register_notes)
SELECT c.note_id, CASE WHEN n.note_id IS NULL THEN 'missing' WHEN (c.domain, c.register, c.kind) IS NOT DISTINCT FROM (n.domain, n.register, n.kind) AND c.reason IS NOT DISTINCT FROM n.reason THEN 'equal' ELSE 'changed' END AS state FROM c LEFT JOIN register_notes n USING (note_id)""")
def register_struct_equal(spark, sf):
    """Cited register rows against the stored ones, compared whole; nulls are equal to nulls."""
    n = table(spark, sf, "register_notes").select("note_id", F.struct("domain", "register", "kind", "reason").alias("stored"))
    kind = F.when(F.col("note_id") % 5 == 0, "matched").otherwise(F.col("kind"))
    c = table(spark, sf, "register_notes").select("note_id", F.struct("domain", "register", kind.alias("kind"), "reason").alias("cited"))
    return c.join(n, "note_id", "left").select("note_id", F.when(F.col("stored").isNull(), "missing").when(F.col("cited").eqNullSafe(F.col("stored")), "equal").otherwise("changed").alias("state"))


@query("""WITH d AS (SELECT row_id, regexp_extract(id, '-([0-9a-f]{12})$', 1) AS short FROM enforcement_actions), s AS (SELECT DISTINCT left(sha256, 12) AS short FROM enforcement_actions WHERE sha256 IS NOT NULL)
SELECT d.row_id, CASE WHEN d.short = '' THEN 'no hash' WHEN s.short IS NULL THEN 'source missing' ELSE 'derived' END AS provenance FROM d LEFT JOIN s USING (short)""")
def provenance_hash_join(spark, sf):
    """Ids that are the start of a checksum, joined with the checksums that are stored."""
    d = table(spark, sf, "enforcement_actions").select("row_id", F.regexp_extract("id", "-([0-9a-f]{12})$", 1).alias("short"))
    s = table(spark, sf, "enforcement_actions").where("sha256 is not null").select(F.substring("sha256", 1, 12).alias("short")).distinct().withColumn("_s", F.lit(True))
    return d.join(s, "short", "left").select("row_id", F.when(F.col("short") == "", "no hash").when(F.col("_s").isNull(), "source missing").otherwise("derived").alias("provenance"))


@query("""WITH m AS (SELECT page_id, regexp_extract_all(text, '[^\\n]{0,40}£[0-9][0-9,]*[^\\n£]{0,40}') AS w FROM site_pages WHERE text IS NOT NULL), u AS (SELECT page_id, generate_subscripts(w, 1) AS place, unnest(w) AS context FROM m)
SELECT page_id, place, context, regexp_matches(lower(context), 'fee|fees|cost') AS about_cost FROM u""")
def context_windows(spark, sf):
    """Every amount of a page with what stands around it, and whether that is about cost."""
    w = F.regexp_extract_all("text", F.lit("[^\\n]{0,40}£[0-9][0-9,]*[^\\n£]{0,40}"), F.lit(0))
    u = table(spark, sf, "site_pages").where("text is not null").select("page_id", F.posexplode(w).alias("_i", "context"))
    return u.select("page_id", (F.col("_i") + 1).alias("place"), "context", F.lower("context").rlike("fee|fees|cost").alias("about_cost"))


@query("""WITH k AS (SELECT law_id, replace(law_id, '_', ' ') AS said FROM law_rules), c AS (SELECT row_id, unnest(law_ids) AS law_id FROM enforcement_actions), m AS (SELECT a.row_id, k.law_id FROM enforcement_actions a JOIN k ON contains(a.summary, k.said))
SELECT row_id, law_id, 'not cited' AS problem FROM (SELECT * FROM m EXCEPT SELECT * FROM c) UNION ALL SELECT row_id, law_id, 'not said' FROM (SELECT * FROM c EXCEPT SELECT * FROM m)""")
def law_provenance(spark, sf):
    """Laws that a summary names without citing, and cites without naming: one pass over each row, no join."""
    # The laws are a fixed table of a few rows, and become one expression.
    laws = [r[0] for r in table(spark, sf, "law_rules").select("law_id").orderBy("law_id").collect()]
    said = F.array_compact(F.array(*(F.when(F.contains("summary", F.lit(x.replace("_", " "))), F.lit(x)) for x in laws)))
    a = table(spark, sf, "enforcement_actions").select("row_id", said.alias("said"), F.array_distinct(F.coalesce("law_ids", F.array().cast("array<string>"))).alias("cited"))
    one = a.select("row_id", F.explode(F.array_except("said", "cited")).alias("law_id"), F.lit("not cited").alias("problem"))
    return one.unionByName(a.select("row_id", F.explode(F.array_except("cited", "said")).alias("law_id"), F.lit("not said").alias("problem")))


@query("""SELECT a.row_id FROM enforcement_actions a WHERE NOT EXISTS (SELECT 1 FROM law_rules r WHERE list_contains(a.law_ids, r.law_id) AND r.status = 'active')""")
def orphan_claims(spark, sf):
    """Claims none of whose citations is a rule in force."""
    a = table(spark, sf, "enforcement_actions").select("row_id", F.explode_outer("law_ids").alias("law_id"))
    active = match.small(table(spark, sf, "law_rules").where("status = 'active'").select("law_id").withColumn("_a", F.lit(True)))
    return a.join(active, "law_id", "left").groupBy("row_id").agg(F.bool_or(F.coalesce("_a", F.lit(False))).alias("_any")).where("not _any").select("row_id")


@query("""SELECT row_id, regexp_extract(lower(summary), '(upheld|settle|ordered|issued a notice)', 1) AS phrase FROM enforcement_actions WHERE regexp_matches(lower(summary), 'upheld|settle|ordered|issued a notice') AND (penalty_amount IS NULL OR sha256 IS NULL)""")
def banned_phrases(spark, sf):
    """Strong words that no confirmed penalty backs."""
    low = F.lower("summary")
    a = table(spark, sf, "enforcement_actions").where(low.rlike("upheld|settle|ordered|issued a notice") & (F.col("penalty_amount").isNull() | F.col("sha256").isNull()))
    return a.select("row_id", F.regexp_extract(low, "(upheld|settle|ordered|issued a notice)", 1).alias("phrase"))


@query("""WITH f AS (SELECT url, min_by(sha256(text), page_id) AS shipped, max_by(sha256(text), page_id) AS stored, max_by(text IS NULL, page_id) AS gone, count(*) AS copies FROM site_pages GROUP BY url)
SELECT url, CASE WHEN shipped IS NULL THEN 'never seen' WHEN gone THEN 'gone' WHEN shipped = stored THEN 'holds' ELSE 'changed' END AS replay, copies FROM f""")
def replay_incidents(spark, sf):
    """What was shipped for each address against what is stored there now, by the hash of its bytes."""
    body = F.struct(F.sha2("text", 256).alias("h"))
    f = table(spark, sf, "site_pages").groupBy("url").agg(F.min_by(F.sha2("text", 256), F.when(F.col("text").isNotNull(), F.col("page_id"))).alias("shipped"), F.max_by(body, "page_id").getField("h").alias("stored"), F.count("*").alias("copies"))
    # A row without text ships nothing; the stored state is the newest row's, text or none.
    return f.select("url", F.when(F.col("shipped").isNull(), "never seen").when(F.col("stored").isNull(), "gone").when(F.col("shipped") == F.col("stored"), "holds").otherwise("changed").alias("replay"), "copies")


@query("""WITH e AS (SELECT register, CASE kind WHEN 'matched' THEN 'match' WHEN 'no_match' THEN 'contradict' ELSE 'abstain' END AS outcome FROM register_notes)
SELECT register, count(*) FILTER (WHERE outcome = 'match') AS matches, count(*) FILTER (WHERE outcome = 'abstain') AS abstains, count(*) FILTER (WHERE outcome = 'contradict') AS contradicts, round(count(*) FILTER (WHERE outcome = 'contradict') / count(*), 6) AS contradiction_rate FROM e GROUP BY register""")
def match_abstain_contradict(spark, sf):
    """Three outcomes of each comparison with what was expected, and the rate of the worst."""
    k = F.col("kind")
    bad = F.count_if(k == "no_match")
    return table(spark, sf, "register_notes").groupBy("register").agg(F.count_if(k == "matched").alias("matches"), F.count_if(~k.isin("matched", "no_match")).alias("abstains"), bad.alias("contradicts"), F.round(bad / F.count("*"), 6).alias("contradiction_rate"))


@query("""SELECT row_id, r.law_id || ' (' || coalesce(r.name, '?') || '): ' || a.entity_name || coalesce(', ' || a.currency || ' ' || CAST(CAST(a.penalty_amount AS BIGINT) AS VARCHAR), '') AS claim FROM (SELECT row_id, entity_name, currency, penalty_amount, unnest(law_ids) AS law_id FROM enforcement_actions) a JOIN law_rules r USING (law_id)""")
def claim_derivation(spark, sf):
    """One claim for each finding and rule, written from their fields."""
    a = table(spark, sf, "enforcement_actions").select("row_id", "entity_name", "currency", "penalty_amount", F.explode("law_ids").alias("law_id"))
    money = F.coalesce(F.concat(F.lit(", "), "currency", F.lit(" "), F.col("penalty_amount").cast("long").cast("string")), F.lit(""))
    return a.join(match.small(table(spark, sf, "law_rules").select("law_id", "name")), "law_id").select("row_id", F.concat("law_id", F.lit(" ("), F.coalesce("name", F.lit("?")), F.lit("): "), "entity_name", money).alias("claim"))
