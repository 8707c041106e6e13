"""Queries over event logs: folds, chains, gaps, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylight.operators import order
from quarrylight.plans.registry import query
from quarrylight.sources.tables import table


@query("SELECT user_id, max_by(event_type, event_id) AS last_event, max(event_id) AS last_id, count(*) AS events FROM events GROUP BY user_id")
def latest_status_fold(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_event"), F.max("event_id").alias("last_id"), F.count("*").alias("events"))


_CHAIN = "SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR)) AS own, CASE WHEN event_id % 97 = 0 THEN 'tampered' ELSE sha256(CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR)) END AS previous FROM events"


def _chain(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("own"), F.lag("event_id").over(w).alias("p"))
    return e.select("user_id", "event_id", "own", F.when(F.col("event_id") % 97 == 0, "tampered").otherwise(F.sha2(F.col("p").cast("string"), 256)).alias("previous"))


@query(f"SELECT user_id, event_id FROM (SELECT *, lag(own) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ({_CHAIN})) WHERE previous IS DISTINCT FROM p")
def hash_chain_verify(spark, sf):
    return order.chain_breaks(_chain(spark, sf), ["user_id"], [F.col("event_id")], "own", "previous").select("user_id", "event_id")


@query("SELECT user_id, sha256(string_agg(event_id || ':' || event_type, chr(10) ORDER BY CAST(event_id AS VARCHAR) || ':' || event_type)) AS head FROM events GROUP BY user_id")
def chain_head(spark, sf):
    entry = F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("head"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 6")
def capped_evidence(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return order.capped(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], 6).select("user_id", "event_id", "event_type")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, event_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session, count(*) AS events, min(event_id) AS first_event FROM s GROUP BY ALL""")
def sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr("interval 6 hours"))
    e = table(spark, sf, "events").select("user_id", "event_id", "ts").withColumn("new", gap.cast("int")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query("""SELECT event_type, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def hourly_counts(spark, sf):
    h = F.date_trunc("hour", "ts")
    return table(spark, sf, "events").groupBy("event_type", h.alias("h")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "total")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)""")
def props_projection(spark, sf):
    return table(spark, sf, "events").where(F.try_parse_json("props").isNotNull()).select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("""WITH s AS (SELECT e.user_id, e.event_id AS signed, (SELECT min(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'error' AND p.event_id > e.event_id) AS reopened FROM events e WHERE e.event_type = 'signup')
SELECT user_id, signed, CASE WHEN reopened IS NULL THEN 'signed' ELSE 'reopened' END AS state FROM s""")
def transition_states(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type").withColumn("later", F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).over(w))
    return e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signed"), F.when(F.col("later").isNull(), "signed").otherwise("reopened").alias("state"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def upsert_latest(spark, sf):
    o = order.latest(table(spark, sf, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), "o_orderkey", "o_totalprice")
    return o.select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark, sf):
    from quarrylight.streaming import events as S

    w = S.drained(S.tumbling(S.source(spark, sf), "1 hour", "2 hours"), "complete")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf):
    from quarrylight.streaming import events as S

    w = S.drained(S.sessions(S.source(spark, sf), "6 hours", "2 hours"), "complete")
    return w.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, max(event_id) AS last_id, max_by(event_type, event_id) AS last_event, count(*) AS events FROM events GROUP BY user_id")
def stream_latest_state(spark, sf):
    from quarrylight.streaming import events as S

    return S.drained(S.latest_state(S.source(spark, sf)), "update")
