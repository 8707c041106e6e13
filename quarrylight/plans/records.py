"""Queries through stored records: run logs, catalogues, fan-in of findings, objects and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import values as V
from quarrylight.plans.registry import query
from quarrylight.runtime import place
from quarrylight.sources import files
from quarrylight.sources.tables import table


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup'")
def run_log_stage(spark, sf):
    """A run log that is only appended to, in a folder for each stage; a reader of one stage opens that folder alone."""
    path = place(spark, "runlog")
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("stage"))
    files.append_log(e.where("event_id % 2 = 0"), path, "stage")
    files.append_log(e.where("event_id % 2 = 1"), path, "stage")
    return files.log_of_stage(spark, path, "event_id long, user_id long, stage string", "stage", "signup").select("event_id", "user_id")


@query("""SELECT law_id AS id, name, CASE WHEN jurisdiction IN ('UK', 'US') THEN 'list' ELSE 'wrapped' END AS shape, CAST(NULL AS VARCHAR) AS problem FROM law_rules UNION ALL SELECT NULL, NULL, 'broken', 'not JSON'""")
def record_loader(spark, sf):
    """Catalogues as a bare list or wrapped in an object, and a broken one that comes out as an error row."""
    path = place(spark, "catalogue")
    docs = table(spark, sf, "law_rules").groupBy("jurisdiction").agg(F.to_json(F.collect_list(F.struct(F.col("law_id").alias("id"), "name"))).alias("list"))
    value = F.when(F.col("jurisdiction").isin("UK", "US"), F.col("list")).otherwise(F.concat(F.lit('{"records": '), "list", F.lit("}")))
    docs.select(value.alias("value")).unionByName(spark.createDataFrame([("{oops",)], "value string")).repartition(6).write.text(path)
    return files.records(spark, path, "id string, name string")


@query("SELECT row_id, CASE WHEN source = 'ICO' THEN 'rewritten' ELSE id END AS id FROM enforcement_actions")
def ndjson_rewrite(spark, sf):
    """A store of lines that is replaced as a whole: readers see the old one or the new one."""
    path = place(spark, "store")
    old = table(spark, sf, "enforcement_actions").select("row_id", "source", "id")
    files.append_ndjson(old, f"{path}/v1")
    kept, _ = files.ndjson(spark, f"{path}/v1", "row_id long, source string, id string", "id")
    files.rewrite_ndjson(kept.withColumn("id", F.when(F.col("source") == "ICO", "rewritten").otherwise(F.col("id"))), f"{path}/v2")
    return files.ndjson(spark, f"{path}/v2", "row_id long, source string, id string", "id")[0].select("row_id", "id")


@query("""SELECT 'scan' AS tool, law_id AS rule_id, 'f/' || jurisdiction AS path, CAST(len(sector) AS BIGINT) AS start_line FROM law_rules UNION ALL SELECT 'review', register, domain, CAST(note_id % 90 AS BIGINT) FROM register_notes UNION ALL SELECT 'local', snapshot_source, domain, CAST(0 AS BIGINT) FROM site_bundles WHERE snapshot_source IS NOT NULL""")
def findings_fanin(spark, sf):
    """Findings of three tools in three formats as rows of one table."""
    path = place(spark, "findings")
    at = F.struct(F.struct(F.struct(F.concat(F.lit("f/"), "jurisdiction").alias("uri")).alias("artifactLocation"), F.struct(F.size("sector").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("law_id").alias("ruleId"), F.lit("error").alias("level"), F.struct(F.col("name").alias("text")).alias("message"), F.array(at).alias("locations"))
    run = F.struct(F.struct(F.struct(F.lit("scan").alias("name")).alias("driver")).alias("tool"), F.collect_list(result).alias("results"))
    table(spark, sf, "law_rules").groupBy().agg(F.to_json(F.struct(F.array(run).alias("runs"))).alias("value")).write.text(f"{path}/sarif")
    table(spark, sf, "register_notes").select(F.to_json(F.struct(F.col("register").alias("title"), F.struct(F.col("domain").alias("file"), (F.col("note_id") % 90).alias("line")).alias("at"))).alias("value")).write.text(f"{path}/review")
    table(spark, sf, "site_bundles").where("snapshot_source is not null").select(F.col("snapshot_source").alias("rule"), F.col("domain").alias("file")).write.json(f"{path}/local")
    scan = files.sarif(spark, f"{path}/sarif").select("tool", "rule_id", "path", F.col("start_line").cast("long").alias("start_line"))
    review = spark.read.schema("title string, at struct<file:string,line:long>").json(f"{path}/review").select(F.lit("review").alias("tool"), F.col("title").alias("rule_id"), F.col("at.file").alias("path"), F.coalesce("at.line", F.lit(0)).alias("start_line"))
    local = spark.read.schema("rule string, file string").json(f"{path}/local").select(F.lit("local").alias("tool"), F.col("rule").alias("rule_id"), F.col("file").alias("path"), F.lit(0).cast("long").alias("start_line"))
    return scan.unionByName(review).unionByName(local)


@query("SELECT law_id, status, true AS intact FROM law_rules")
def catalogue_artifact(spark, sf):
    """A compiled catalogue with the hash of each rule's content, read back and checked."""
    path = place(spark, "artifact")
    content = lambda: F.sha2(V.canonical("law_id", "name", "jurisdiction", F.array_join(F.array_sort("sector"), ","), "status"), 256)
    table(spark, sf, "law_rules").select("law_id", "name", "jurisdiction", "sector", "status").withColumn("content_hash", content()).coalesce(1).write.json(path)
    back = spark.read.schema("law_id string, name string, jurisdiction string, sector array<string>, status string, content_hash string").json(path)
    return back.select("law_id", "status", (F.col("content_hash") == content()).alias("intact"))


@query("SELECT source, count(*) AS objects FROM (SELECT DISTINCT source, summary FROM enforcement_actions) GROUP BY source")
def object_sink(spark, sf):
    """Objects under the hash of their content, in a folder for each source: the same content is one object however often it is put."""
    path = place(spark, "objects")
    a = table(spark, sf, "enforcement_actions").select("source", "summary")
    files.put_objects(a, path, "source", "summary")
    files.put_objects(a.where("source = 'ICO'"), path, "source", "summary")
    return files.objects(spark, path, "source string, object_key string, summary string").groupBy("source").agg(F.count("*").alias("objects"))


@query("SELECT jurisdiction, '## ' || jurisdiction || chr(10) || string_agg('- **' || law_id || '** ' || replace(name, '|', '/') || ' (' || status || ')', chr(10) ORDER BY law_id) AS markdown FROM law_rules GROUP BY jurisdiction")
def report_markdown(spark, sf):
    r = files.report_lines(table(spark, sf, "law_rules"), "jurisdiction", "law_id", F.concat(F.lit("- **"), "law_id", F.lit("** "), F.replace("name", F.lit("|"), F.lit("/")), F.lit(" ("), "status", F.lit(")")))
    return r.select("jurisdiction", F.concat(F.lit("## "), "jurisdiction", F.lit("\n"), "text").alias("markdown"))


@query("SELECT jurisdiction, '<h2>' || jurisdiction || '</h2><ul>' || chr(10) || string_agg('<li>' || replace(replace(name, '&', '&amp;'), '<', '&lt;') || '</li>', chr(10) ORDER BY law_id) || chr(10) || '</ul>' AS html FROM law_rules GROUP BY jurisdiction")
def report_html(spark, sf):
    r = files.report_lines(table(spark, sf, "law_rules"), "jurisdiction", "law_id", F.concat(F.lit("<li>"), F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</li>")))
    return r.select("jurisdiction", F.concat(F.lit("<h2>"), "jurisdiction", F.lit("</h2><ul>\n"), "text", F.lit("\n</ul>")).alias("html"))
