"""Queries over running text: sentences, words, languages, spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import values as V
from quarrylight.operators import rollup
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table

_SENTENCES = r"""
m AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
sentences AS (SELECT doc_id, generate_subscripts(s, 1) AS sent_idx, unnest(s) AS sentence FROM m)
"""


def _sentences(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(T.sentences("text")).alias("_i", "sentence")).select("doc_id", (F.col("_i") + 1).alias("sent_idx"), "sentence")


@query(f"WITH {_SENTENCES} SELECT * FROM sentences")
def sentence_split(spark, sf):
    return _sentences(spark, sf)


@query(f"""WITH {_SENTENCES}, c AS (SELECT doc_id, sent_idx, list_filter(list_transform(regexp_split_to_array(sentence, '[,;:]'), lambda x: trim(x)), lambda x: x <> '') AS c FROM sentences)
SELECT doc_id, sent_idx, len(c) AS clauses, c[1] AS first_clause FROM c WHERE len(c) > 0""")
def clause_split(spark, sf):
    c = T.clauses("sentence")
    return _sentences(spark, sf).select("doc_id", "sent_idx", F.size(c).alias("clauses"), F.get(c, F.lit(0)).alias("first_clause")).where("clauses > 0")


_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f\u00a0]+'), lambda x: x <> '')"


@query(f"""WITH {_SENTENCES}, w AS (SELECT doc_id, sent_idx, sentence, {_WORDS.format('sentence')} AS w FROM sentences)
SELECT doc_id, sent_idx FROM w WHERE length(sentence) >= 25 AND len(w) >= 4 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) * 10 <= len(w) * 7 AND regexp_matches(sentence, '[a-z]')""")
def prose_gate(spark, sf):
    return _sentences(spark, sf).where(T.is_prose("sentence")).select("doc_id", "sent_idx")


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains({_STOP}, x))) / len(w), 6) END AS density FROM w""")
def stopword_density(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", T.count_words("text").alias("n_words"), T.count_known("text", T.STOPWORDS).alias("_stops"))
    return docs.select("doc_id", "n_words", F.round(F.try_divide("_stops", "n_words"), 6).alias("density"))


@query(f"""WITH w AS (SELECT doc_id, lower(lang) AS tag, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, tag, len(w) AS n, len(list_filter(w, lambda x: list_contains({_STOP}, x))) AS stops FROM w)
SELECT doc_id, CASE WHEN n < 60 THEN 'undecided' WHEN stops * 1000 >= n * 20 THEN 'en' WHEN stops * 1000 <= n * 5 THEN coalesce(nullif(tag, 'en'), 'und') ELSE 'undecided' END AS language FROM d""")
def language_gate(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.lower("lang").alias("tag"), T.count_words("text").alias("n"), T.count_known("text", T.STOPWORDS).alias("stops"))
    language = F.when(F.col("n") < 60, "undecided").when(F.col("stops") * 1000 >= F.col("n") * 20, "en").when(F.col("stops") * 1000 <= F.col("n") * 5, F.coalesce(F.nullif(F.col("tag"), F.lit("en")), F.lit("und"))).otherwise("undecided")
    return d.select("doc_id", language.alias("language"))


@query(f"""WITH w AS (SELECT source, unnest({_TOKENS}) AS term FROM documents WHERE text IS NOT NULL),
c AS (SELECT source, term, count(*) AS uses FROM w WHERE length(term) >= 4 AND NOT list_contains({_STOP}, term) GROUP BY ALL)
SELECT source, term, uses, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY uses DESC, term) AS rank FROM c) WHERE rank <= 8""")
def keyword_topk(spark, sf):
    w = table(spark, sf, "documents").where("text is not null").select("source", T.each_word("text").alias("term")).where(F.length("term") >= 4).where(~F.col("term").isin(*T.STOPWORDS))
    counts = w.groupBy("source", "term").agg(F.count("*").alias("uses"))
    return rollup.top(counts, ["source"], [F.desc("uses"), F.col("term")], 8)


@query("""WITH t AS (SELECT row_id, list_distinct(list_filter(regexp_split_to_array(lower(summary), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS t FROM enforcement_actions),
o AS (SELECT row_id, unnest(t) AS token FROM t)
SELECT row_id, token FROM (SELECT row_id, token, row_number() OVER (PARTITION BY row_id ORDER BY length(token) DESC, token) AS n FROM o) WHERE n <= 2""")
def salient_tokens(spark, sf):
    tokens = F.array_distinct(F.filter(T.words("summary"), lambda x: F.length(x) >= 4))
    exploded = table(spark, sf, "enforcement_actions").select("row_id", F.explode(tokens).alias("token"))
    return rollup.top(exploded, ["row_id"], [F.desc(F.length("token")), F.col("token")], 2).select("row_id", "token")


def _has(column: str, words) -> str:
    return f"regexp_matches(lower({column}), '(^|[^a-z0-9_])({'|'.join(words)})([^a-z0-9_]|$)')"


@query(f"WITH {_SENTENCES} SELECT doc_id, sent_idx FROM sentences WHERE {_has('sentence', T.NEGATIONS)}")
def negated_sentences(spark, sf):
    return _sentences(spark, sf).where(T.holds_word("sentence", *T.NEGATIONS)).select("doc_id", "sent_idx")


@query(f"""WITH {_SENTENCES} SELECT a.doc_id, a.sent_idx, a.sentence AS first, b.sentence AS second FROM sentences a JOIN sentences b ON a.doc_id = b.doc_id AND b.sent_idx = a.sent_idx + 1
WHERE {_has('a.sentence', ['fee'])} AND {_has('b.sentence', ['deposit'])} AND NOT {_has('a.sentence', ['deposit'])}""")
def sentence_window_hit(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("sent_idx")
    s = _sentences(spark, sf).withColumn("second", F.lead("sentence").over(w))
    return s.where(T.holds_word("sentence", "fee") & T.holds_word("second", "deposit") & ~T.holds_word("sentence", "deposit")).select("doc_id", "sent_idx", F.col("sentence").alias("first"), "second")


@query(r"""WITH a AS (SELECT page_id, list_transform(regexp_extract_all(text, '£([0-9][0-9,]*)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS a FROM site_pages WHERE text IS NOT NULL)
SELECT page_id, len(a) AS amounts, list_max(a) AS most FROM a WHERE len(a) > 0""")
def money_parse(spark, sf):
    p = table(spark, sf, "site_pages").where("text is not null").select("page_id", T.amounts("text").alias("a"))
    return p.select("page_id", F.size("a").alias("amounts"), F.array_max("a").alias("most")).where("amounts > 0")


@query("""SELECT doc_id, sha256(substring(text, 11, 40)) AS span_sha256, strlen(substring(text, 11, 40)) AS bytes FROM documents WHERE length(text) >= 60 AND regexp_matches(text, '^[ -~\\n\\r]*$')""")
def span_hash(spark, sf):
    docs = table(spark, sf, "documents").where(F.length("text") >= 60).where(F.col("text").rlike(r"^[ -~\n\r]*$"))
    return docs.select("doc_id", V.span_hash(F.col("text"), F.lit(10), F.lit(50)).alias("span_sha256"), F.octet_length(F.substring("text", 11, 40)).alias("bytes"))


@query("""SELECT row_id, contains(lower(trim(regexp_replace(summary, '[ \\t\\n\\r\\f\u00a0]+', ' ', 'g'))), lower(trim(regexp_replace(entity_name, '[ \\t\\n\\r\\f\u00a0]+', ' ', 'g')))) AS contained FROM enforcement_actions""")
def quote_containment(spark, sf):
    from quarrylight.operators.match import contains_quote

    return contains_quote(table(spark, sf, "enforcement_actions").select("row_id", "summary", "entity_name"), "summary", "entity_name").select("row_id", "contained")


@query(f"""WITH w AS (SELECT row_id, list_distinct({_TOKENS.replace('text', 'summary')}) AS p, list_distinct({_TOKENS.replace('text', "coalesce(offending_quote, '')")}) AS h FROM enforcement_actions)
SELECT row_id, CASE WHEN len(h) = 0 THEN 'no claim' WHEN len(list_intersect(h, p)) / len(h) > 0.6 THEN 'entailed' WHEN len(list_intersect(h, p)) / len(h) < 0.15 THEN 'unsupported' ELSE 'neutral' END AS label FROM w""")
def entailment_overlap(spark, sf):
    w = table(spark, sf, "enforcement_actions").select("row_id", F.array_distinct(T.words("summary")).alias("p"), F.array_distinct(T.words(F.coalesce("offending_quote", F.lit("")))).alias("h"))
    share = F.try_divide(F.size(F.array_intersect("h", "p")), F.size("h"))
    return w.select("row_id", F.when(F.size("h") == 0, "no claim").when(share > 0.6, "entailed").when(share < 0.15, "unsupported").otherwise("neutral").alias("label"))


@query(r"""WITH p AS (SELECT bundle_id, regexp_extract(footer_text, 'Company number ([0-9]{8})', 1) AS company_number, regexp_extract(footer_text, '([A-Z]{2}[0-9]{1,2}) ?[0-9][A-Z]{2}', 1) AS district FROM site_bundles WHERE footer_text IS NOT NULL)
SELECT bundle_id, nullif(company_number, '') AS company_number, nullif(district, '') AS district FROM p""")
def footer_identifiers(spark, sf):
    b = table(spark, sf, "site_bundles").where("footer_text is not null")
    x = lambda p: F.nullif(F.regexp_extract("footer_text", p, 1), F.lit(""))
    return b.select("bundle_id", x("Company number ([0-9]{8})").alias("company_number"), x("([A-Z]{2}[0-9]{1,2}) ?[0-9][A-Z]{2}").alias("district"))


@query(f"""WITH {_SENTENCES} SELECT doc_id, sent_idx, sum(strlen(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY sent_idx) - strlen(sentence) - 1 AS byte_start, sum(strlen(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS byte_end, sha256(sentence) AS span_sha256 FROM sentences""")
def byte_boundary_map(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, 0)
    s = _sentences(spark, sf).withColumn("_size", F.octet_length("sentence")).withColumn("_upto", F.sum(F.col("_size") + 1).over(w))
    return s.select("doc_id", "sent_idx", (F.col("_upto") - F.col("_size") - 1).alias("byte_start"), (F.col("_upto") - 1).alias("byte_end"), F.sha2("sentence", 256).alias("span_sha256"))


@query(r"""SELECT page_id, len(regexp_extract_all(lower(text), '(^|[^a-z0-9_])(fee|fees)([^a-z0-9_]|$)')) AS fees, regexp_matches(lower(text), '(fee|fees).{0,60}£') AS priced FROM site_pages WHERE text IS NOT NULL""")
def near_word(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "site_pages").where("text is not null").select("page_id", F.regexp_count(low, F.lit("(^|[^a-z0-9_])(fee|fees)([^a-z0-9_]|$)")).alias("fees"), low.rlike("(fee|fees).{0,60}£").alias("priced"))
