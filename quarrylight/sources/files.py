"""Readers with explicit schemas and error rows; sinks by append, content and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.runtime import exists


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file, with ``file``; what cannot be read is in ``_corrupt_record``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.select("file", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d")).select("file", "d.*")


def ndjson(spark: SparkSession, path: str, schema: str, *required: str) -> tuple[DataFrame, DataFrame]:
    """Rows of line-wise JSON, and the lines that are broken or lack a required field with the reason."""
    read = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull(), c) for c in required))
    marked = read.withColumn("problem", F.when(F.col("_corrupt_record").isNotNull(), "not JSON").when(missing != "", F.concat(F.lit("missing: "), missing)))
    return marked.where("problem is null").drop("problem", "_corrupt_record"), marked.where("problem is not null").select("problem", "_corrupt_record")


def append_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rewrite_ndjson(df: DataFrame, path: str) -> None:
    """Replace a store as a whole; the committer's rename makes it appear at once.  It must not be the path that ``df`` reads."""
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, stage: str) -> None:
    df.write.mode("append").partitionBy(stage).parquet(path)


def log_of_stage(spark: SparkSession, path: str, schema: str, stage: str, wanted: str) -> DataFrame:
    """Entries of one stage of a run log; the other stages' folders are not opened."""
    return spark.read.schema(schema).parquet(path).where(F.col(stage) == wanted)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(schema.., shape, problem)`` of catalogues, a line each: a bare list, or an object with ``records``; a broken one is one row with its problem."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    fields = ", ".join(f"{n}: {t}" for n, t in (x.split() for x in schema.split(", ")))
    # A reader of lists takes an object for a list of one, so the first sign tells them apart.
    bare = F.startswith(F.ltrim("value"), F.lit("["))
    rows = F.when(bare, F.from_json("value", f"array<struct<{fields}>>")).otherwise(F.from_json("value", f"struct<records: array<struct<{fields}>>>").getField("records"))
    shape = F.when(rows.isNull(), "broken").when(bare, "list").otherwise("wrapped")
    return raw.select(F.explode_outer(rows).alias("r"), shape.alias("shape"), F.when(rows.isNull(), "not JSON").alias("problem")).select("r.*", "shape", "problem")


def put_objects(df: DataFrame, path: str, folder: str, *content: str) -> None:
    """Write each row under the key of its content; what is there already is not written again."""
    new = sealed(df, folder, *content).dropDuplicates(["object_key"])
    spark = df.sparkSession
    if exists(spark, path):
        new = new.join(objects(spark, path, "object_key string").select("object_key"), "object_key", "left_anti").select(*new.columns)
    new.write.mode("append").partitionBy(folder).parquet(path)


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def sarif(spark: SparkSession, path: str) -> DataFrame:
    """Findings of static-analysis tools as flat rows."""
    schema = "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
    d = json_documents(spark, path, schema).select("file", F.explode("runs").alias("r")).select("file", F.col("r.tool.driver.name").alias("tool"), F.explode("r.results").alias("x"))
    at = F.get(F.col("x.locations"), F.lit(0)).getField("physicalLocation")
    return d.select("file", "tool", F.col("x.ruleId").alias("rule_id"), F.col("x.level").alias("severity"), F.col("x.message.text").alias("message"), at.getField("artifactLocation").getField("uri").alias("path"), F.coalesce(at.getField("region").getField("startLine"), F.lit(0)).alias("start_line"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The table after new rows replaced old ones of the same key; where both have a key the later by ``order`` stays."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sealed(df: DataFrame, key: str, *content: str) -> DataFrame:
    """With ``object_key``: the key and the start of the content's hash; equal content has an equal key."""
    from quarrylight.functions.values import content_key

    return df.withColumn("object_key", F.concat_ws("/", key, content_key(*(F.col(c) for c in content))))


def report_lines(df: DataFrame, group: str, order: str, line: Column) -> DataFrame:
    """One text for each group, lines in order; groups must be reports, not tables."""
    return df.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
