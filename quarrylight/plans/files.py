"""Queries that go through files: written in one form, read in another."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.plans.registry import query
from quarrylight.runtime import place
from quarrylight.sources import files
from quarrylight.sources.tables import table


@query("SELECT row_id, id, penalty_amount FROM enforcement_actions WHERE offending_quote IS NOT NULL")
def ndjson_roundtrip(spark, sf):
    path = place(spark, "files")
    files.append_ndjson(table(spark, sf, "enforcement_actions").select("row_id", "id", "penalty_amount", "offending_quote"), path)
    return files.ndjson(spark, path, "row_id long, id string, penalty_amount double, offending_quote string", "id", "offending_quote")[0].select("row_id", "id", "penalty_amount")


@query("""SELECT problem, count(*) AS rejected FROM (SELECT CASE WHEN offending_quote IS NULL AND sha256 IS NULL THEN 'missing: offending_quote, sha256' WHEN offending_quote IS NULL THEN 'missing: offending_quote' ELSE 'missing: sha256' END AS problem FROM enforcement_actions WHERE offending_quote IS NULL OR sha256 IS NULL)
GROUP BY problem UNION ALL SELECT 'not JSON', 2""")
def ndjson_rejects(spark, sf):
    """Lines of a store that are broken or lack a field, counted by what is wrong."""
    path = place(spark, "files")
    files.append_ndjson(table(spark, sf, "enforcement_actions").select("row_id", "id", "offending_quote", "sha256"), path)
    spark.createDataFrame([("{broken",), ("no line of JSON",)], "value string").write.mode("append").text(path)
    bad = files.ndjson(spark, path, "row_id long, id string, offending_quote string, sha256 string", "id", "offending_quote", "sha256")[1]
    return bad.groupBy("problem").agg(F.count("*").alias("rejected"))


@query("SELECT DISTINCT domain AS url FROM site_bundles")
def url_list_scan(spark, sf):
    path = place(spark, "files")
    hosts = table(spark, sf, "site_bundles").select("domain").distinct()
    hosts.select(F.concat(F.lit("  "), "domain").alias("value")).unionByName(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return files.url_list(spark, path)


@query("""SELECT law_id, status FROM (SELECT law_id, CASE WHEN jurisdiction = 'US' THEN 'retired' ELSE status END AS status FROM law_rules)""")
def relational_upsert(spark, sf):
    r = table(spark, sf, "law_rules").select("law_id", "jurisdiction", "status")
    old = r.select("law_id", "status", F.lit(1).alias("version"))
    new = r.where("jurisdiction = 'US'").select("law_id", F.lit("retired").alias("status"), F.lit(2).alias("version"))
    return files.upserted(old, new, ["law_id"], F.col("version")).select("law_id", "status")


@query("SELECT count(DISTINCT (entity_name, summary)) AS objects, count(*) AS row_count FROM enforcement_actions")
def sealed_objects(spark, sf):
    a = files.sealed(table(spark, sf, "enforcement_actions"), "source", "entity_name", "summary")
    return a.agg(F.count_distinct("object_key").alias("objects"), F.count("*").alias("row_count"))


@query("SELECT jurisdiction, string_agg(law_id || ': ' || status, chr(10) ORDER BY law_id) AS text FROM law_rules GROUP BY jurisdiction")
def report_text(spark, sf):
    return files.report_lines(table(spark, sf, "law_rules"), "jurisdiction", "law_id", F.concat("law_id", F.lit(": "), "status"))
