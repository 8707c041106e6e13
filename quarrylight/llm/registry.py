"""The queries of this subpackage: name -> callable, and name -> SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import boilerplate, history, leakage, mixing, names, personal, repeated_lines, residue, stuffing, truncation
from quarrylight.runtime import exists, place
from quarrylight.sources.tables import table


def _names(spark: SparkSession, sf: str) -> DataFrame:
    actions = table(spark, sf, "enforcement_actions").select(F.col("entity_name").alias("name"))
    return actions.unionByName(table(spark, sf, "site_pages").select(F.col("og_site_name").alias("name")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different spellings of one firm or person."""
    return names.pairs(_names(spark, sf))


def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored name with its entity."""
    return names.entities(_names(spark, sf))


def p1_members(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored name with the spelling that stands for its entity."""
    return names.members(_names(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose text was cut off."""
    return truncation.truncated(table(spark, sf, "site_pages")).where("truncated").select("page_id")


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each snapshot source truncates."""
    return truncation.rates(table(spark, sf, "site_pages"), table(spark, sf, "site_bundles"))


#: Where the labellers of this session's tables were saved.
_SAVED: dict[str, str] = {}


def _labeller(spark: SparkSession, sf: str) -> tuple[DataFrame, boilerplate.Labeller]:
    """The pages and a labeller that is fitted on them once in a session and saved in the shared folder."""
    pages = table(spark, sf, "site_pages")
    at = _SAVED.get(f"{spark.sparkContext.applicationId} {sf}")
    if at is None or not exists(spark, f"{at}/_SUCCESS"):
        at = _SAVED[f"{spark.sparkContext.applicationId} {sf}"] = place(spark, "labeller")
        boilerplate.save(spark, boilerplate.train(pages), at)
    return pages, boilerplate.load(spark, at)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of pages that are site furniture."""
    return boilerplate.label(*_labeller(spark, sf)).select("page_id", F.explode("furniture").alias("line_no"))


def p3_body(spark: SparkSession, sf: str) -> DataFrame:
    """The body of each page."""
    return boilerplate.label(*_labeller(spark, sf)).select("page_id", F.col("body").alias("text"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that report a decision again, with the first row that did."""
    return history.repeats(table(spark, sf, "enforcement_actions"))


def p4_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that report a new decision."""
    return history.accepted(table(spark, sf, "enforcement_actions")).select("batch_no", "row_id", "id", "entity_name")


def p4_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the graph index against exhaustive search."""
    return history.measured_recall(table(spark, sf, "enforcement_actions"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "site_pages").select(F.lit("site_pages").alias("origin"), F.col("page_id").alias("row_key"), "text")
    footers = table(spark, sf, "site_bundles").select(F.lit("site_bundles").alias("origin"), F.col("bundle_id").alias("row_key"), F.col("footer_text").alias("text"))
    return pages.unionByName(footers)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of personal data in pages and footers."""
    return personal.find(_texts(spark, sf)).select("origin", "row_key", "kind", "start_at")


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and footers with typed placeholders in place of personal data."""
    return personal.redacted(_texts(spark, sf)).select("origin", "row_key", "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that recur on ten or more addresses of their domain."""
    return repeated_lines.repeated_lines(table(spark, sf, "site_pages"))


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The pages without the lines that recur in their domain."""
    pages = table(spark, sf, "site_pages").select("page_id", "domain", "url", "text")
    return repeated_lines.without_lines(pages, repeated_lines.repeated_lines(pages)).select("page_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that hold template residue or only a notice."""
    return residue.evidence(table(spark, sf, "site_pages")).select("page_id")


def p7_usable(spark: SparkSession, sf: str) -> DataFrame:
    """The pages that are neither residue nor a notice."""
    return residue.usable(table(spark, sf, "site_pages")).select("page_id", "domain", "url")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold passages of evaluation items, with the items."""
    found = leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    # A passage counts by its words; items re-told with other names and numbers are in p8_items.
    return found.where("kind <> 'template'").select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it, by kind of match."""
    found = leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.groupBy("item_id", "kind").agg(F.countDistinct("doc_id").alias("documents"), F.max("run").alias("longest_run"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The records of the mix, with their sizes and uses."""
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share that each source really reached."""
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"))[1]


def p9_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the largest mix in which no source that has text falls short."""
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"), size="exact")[1]


def p9_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same for a mix as large as all records of its sources, in which some fall short."""
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"), size="whole")[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are keyword-stuffed or lists of links, tags or labels."""
    return stuffing.scores(table(spark, sf, "documents")).where("spam").select("doc_id")


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every judged document with its perplexity and shares."""
    return stuffing.scores(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_entities, p1_members, p2_found, p2_rates, p3_found, p3_body, p4_found, p4_accepted, p4_recall, p5_found, p5_redacted, p6_found, p6_clean, p7_found, p7_usable, p8_found, p8_items, p9_mix, p9_shares, p9_exact, p9_whole, p10_found, p10_scores)}

_P6_LINES = r"""
lines AS (
  SELECT page_id, domain, url, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line
  FROM (SELECT page_id, domain, url, string_split(text, chr(10)) AS parts FROM site_pages WHERE text IS NOT NULL)),
keyed AS (
  SELECT page_id, domain, url, line_no, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) AS n FROM lines),
often AS (
  SELECT domain, n FROM keyed WHERE n <> '' GROUP BY domain, n HAVING count(DISTINCT url) >= 10)
"""

_OMITTED = r"[\s\x{00a0}]*(?:\.\.\.|…|\[\s*(?:\.\.\.|…|cut|truncated|more)?\s*\]?|\((?:\.\.\.|…|cut|truncated|more)\)?)[\s\x{00a0}]*$"
_FORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(cl, ' *\(\d+\)$', ''), '(^| )[^ ]+@[^ ]+', '\1E', 'g'), '[\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*', '9', 'g'), '([^\p{L}\p{N}_])\p{Lu}[\p{L}''’]*', '\1C', 'g')"
_STRIP = "'.,;:!?)”\"»›…''’'"
_CLOSERS = "('.', '!', '?', '»', '”', '\"', '›', ')', '|', '…')"
_CLEAN = "trim(replace({0}, chr(160), ' '))"

_P2_CUT = rf"""
texts AS (SELECT page_id AS k, string_split(rtrim(text, ' ' || chr(10) || chr(9) || chr(13) || chr(160)), chr(10)) AS l FROM site_pages WHERE text IS NOT NULL),
lasts AS (SELECT k, {_CLEAN.format('l[len(l)]')} AS cl FROM texts WHERE array_to_string(l, '') <> ''),
marks AS (SELECT k, cl, regexp_matches(cl, '{_OMITTED}') AS marked FROM lasts),
finals AS (SELECT k, cl, marked, string_split(replace(trim(CASE WHEN marked THEN regexp_replace(cl, '{_OMITTED}', '') ELSE cl END), '  ', ' '), ' ') AS w FROM marks),
ends_ AS (SELECT k, cl, marked, len(w) AS m, CASE WHEN len(w) >= 3 THEN lower(w[len(w) - 2]) ELSE '<s>' END AS c1, CASE WHEN len(w) >= 2 THEN lower(w[len(w) - 1]) ELSE '<s>' END AS c2, coalesce(w[len(w)], '') AS word FROM finals),
open_ AS (SELECT k, cl, marked, m, c1, c2, lower(rtrim(word, {_STRIP})) AS x, right(word, 1) IN {_CLOSERS} AND NOT (marked AND right(word, 1) = ')') AS closed, regexp_matches(cl, '[.!?] \p{{Lu}}') AS prose FROM ends_),
asked AS (SELECT DISTINCT c1, c2, x FROM open_ WHERE NOT closed AND x <> ''),
every AS (SELECT unnest(l) AS line, generate_subscripts(l, 1) = len(l) AS final FROM texts),
worded AS (SELECT final, string_split(replace(lower({_CLEAN.format('line')}), '  ', ' '), ' ') AS w FROM every WHERE line <> ''),
placed AS (SELECT final, w, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM worded),
trigrams AS (SELECT CASE WHEN j >= 3 THEN w[j - 2] ELSE '<s>' END AS c1, CASE WHEN j >= 2 THEN w[j - 1] ELSE '<s>' END AS c2, word, w[j + 1] AS nxt FROM placed WHERE NOT (final AND w[j + 1] IS NULL)),
counted AS (SELECT c1, c2, rtrim(word, {_STRIP}) AS x, nxt IS NULL AND right(word, 1) = '…' AS trails, right(word, 1) IN {_CLOSERS} OR nxt IS NULL OR nxt = '' OR left(nxt, 1) IN ('|', '•', '·', '–', '-', '>', '(') AS stops FROM trigrams SEMI JOIN (SELECT DISTINCT c1, c2 FROM asked) USING (c1, c2)),
counts AS (SELECT c1, c2, x, count(*) FILTER (WHERE NOT stops) AS inner_, count(*) FILTER (WHERE stops) AS outer_, count(*) FILTER (WHERE trails) AS trails FROM counted WHERE x <> '' GROUP BY ALL),
known AS (SELECT a.c1, a.c2, a.x, coalesce(sum(inner_) FILTER (WHERE c.x = a.x), 0) AS inner_, coalesce(sum(outer_) FILTER (WHERE c.x = a.x), 0) AS outer_, coalesce(sum(trails) FILTER (WHERE c.x = a.x), 0) AS trails, coalesce(sum(inner_ + outer_) FILTER (WHERE c.x <> a.x), 0) AS longer_
  FROM asked a JOIN counts c ON a.c1 = c.c1 AND a.c2 = c.c2 AND starts_with(c.x, a.x) GROUP BY ALL),
asks AS (SELECT *, {_FORM} AS f FROM open_ WHERE NOT (closed OR prose AND m >= {2 * truncation.PROSE_WORDS})),
insides AS (SELECT {_FORM} AS f FROM (SELECT {_CLEAN.format('line')} AS cl FROM every WHERE line <> '' AND NOT final)),
forms AS (SELECT f, sum(inside) AS inside, count(*) AS lines FROM (SELECT f, 1 AS inside FROM insides UNION ALL SELECT f, 0 FROM asks) GROUP BY f),
judged AS (SELECT o.k, o.closed, o.marked, o.m, o.prose, a.f, coalesce(n.inner_, 0) AS i, coalesce(n.outer_, 0) AS o, coalesce(n.longer_, 0) AS l, coalesce(n.trails, 0) AS t FROM open_ o LEFT JOIN asks a ON a.k = o.k LEFT JOIN known n ON n.c1 = o.c1 AND n.c2 = o.c2 AND n.x = o.x),
cut_ AS (SELECT j.k, CASE WHEN closed THEN false WHEN i + o = 0 AND l >= {truncation.MIN_SEEN} THEN true WHEN o = 0 AND i + l >= {truncation.SURE_SEEN} THEN true WHEN inside > 0 AND NOT marked OR lines >= {truncation.LABEL_LINES} AND m <= {truncation.LABEL_WORDS} THEN false
  WHEN marked THEN t < {truncation.MIN_SEEN} WHEN m >= {truncation.PROSE_WORDS} AND prose THEN true WHEN i + l + o >= {truncation.MIN_SEEN} THEN o <= {truncation.MAX_TERMINAL} * (i + l + o) ELSE m >= {truncation.PROSE_WORDS} END AS truncated FROM judged j LEFT JOIN forms USING (f))
"""

ORACLE = {
    "p2_found": f"WITH {_P2_CUT} SELECT k AS page_id FROM cut_ WHERE truncated",
    "p2_rates": f"""WITH {_P2_CUT} SELECT b.snapshot_source, count(*) AS pages, count(*) FILTER (WHERE t.truncated) AS truncated_pages, count(*) FILTER (WHERE t.truncated) / count(*) AS rate,
  count(*) FILTER (WHERE t.truncated AND b.truncated) AS declared_too, count(*) FILTER (WHERE t.truncated AND b.truncated IS NULL) AS undeclared
FROM site_pages p JOIN site_bundles b USING (bundle_id) JOIN cut_ t ON t.k = p.page_id GROUP BY b.snapshot_source""",
    "p6_found": f"WITH {_P6_LINES} SELECT page_id, line_no FROM keyed JOIN often USING (domain, n)",
    "p6_clean": f"""WITH {_P6_LINES},
kept AS (
  SELECT l.page_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text
  FROM lines l JOIN keyed k USING (page_id, line_no)
  LEFT JOIN often o ON o.domain = k.domain AND o.n = k.n
  WHERE o.n IS NULL GROUP BY l.page_id)
SELECT p.page_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM site_pages p LEFT JOIN kept k USING (page_id)""",
}
