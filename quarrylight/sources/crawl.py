"""Readers for what a crawl saves: sitemaps, robots files, listings of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sitemap_locations(xml: Column | str) -> Column:
    """The addresses of a sitemap, entities read, white space gone."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def robots_lines(df: DataFrame, key: str, robots: str) -> DataFrame:
    """``(key, group, field, value)`` of a robots file; agents named in a row share the rules after them."""
    lines = df.select(key, F.posexplode(F.split(robots, "\n")).alias("_n", "_line"))
    lines = lines.select(key, "_n", F.regexp_replace("_line", "#.*$", "").alias("_line")).select(key, "_n", F.lower(F.trim(F.substring_index("_line", ":", 1))).alias("field"), F.trim(F.regexp_replace("_line", "^[^:]*:", "")).alias("value"))
    lines = lines.where(F.col("field").isin("user-agent", "disallow", "allow"))
    w = Window.partitionBy(key).orderBy("_n")
    agent, before = F.col("field") == "user-agent", F.coalesce(F.lag("field").over(w), F.lit(""))
    lines = lines.withColumn("_new", (agent & (before != "user-agent")).cast("int"))
    return lines.withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(key, "group", "field", "value")


def blocked_bots(df: DataFrame, key: str, robots: str, bots: tuple[str, ...]) -> DataFrame:
    """``(key, bot, blocked)``: whether the group that names the bot, or else the one for all, shuts out everything."""
    lines = robots_lines(df, key, robots)
    shut = F.max((F.col("field") == "disallow") & (F.col("value") == "/")) & ~F.coalesce(F.max((F.col("field") == "allow") & (F.col("value") == "/")), F.lit(False))
    groups = lines.groupBy(key, "group").agg(F.collect_set(F.when(F.col("field") == "user-agent", F.lower("value"))).alias("agents"), shut.alias("shut"))
    own = lambda name: F.max(F.when(F.array_contains("agents", name), F.col("shut")))
    found = groups.groupBy(key).agg(*(F.coalesce(own(b), own("*"), F.lit(False)).alias(f"_{b}") for b in bots))
    rows = F.array(*(F.struct(F.lit(b).alias("bot"), F.coalesce(F.col(f"_{b}"), F.lit(False)).alias("blocked")) for b in bots))
    # A site without a robots file shuts nobody out.
    return df.select(key).join(found, key, "left").select(key, F.explode(rows).alias("x")).select(key, "x.*")


def listing_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, entity_name, decision_date, penalty)`` of saved table rows; what is missing is null."""
    name = F.replace(F.replace(F.regexp_extract(html, r'(?is)<td class="n">\s*(?:<b>)?(.*?)(?:</b>)?\s*</td>', 1), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    written = F.regexp_extract(html, r"([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})", 1)
    pounds = F.replace(F.regexp_extract(html, "£([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("long")
    return df.select(key, name.alias("entity_name"), F.to_date(F.try_to_timestamp(written, F.lit("d MMMM yyyy"))).alias("decision_date"), pounds.alias("penalty"))
