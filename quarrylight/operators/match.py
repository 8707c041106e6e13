"""Matching joins: tokens, phrases, similar names, prefixes, containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.runtime import cut

#: Rows up to which a table of patterns may be sent to every executor.
SMALL = 10_000
#: Candidates that may hold a token and meet by it, one by one.
RARE = 128
#: Common tokens up to which every set of a name's is looked up.
WIDE = 8


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A broadcast hint if the table has at most so many rows; otherwise the table as it is, joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def token_hits(texts: DataFrame, key: str, tokens: str, patterns: DataFrame, pattern_key: str, token: str, all_of: bool) -> DataFrame:
    """Texts that hold all, or any, of a pattern's tokens: an equi-join on tokens, then a count.

    ``texts`` has an array of words; ``patterns`` a row for each token.
    """
    exploded = texts.select(key, F.explode(F.array_distinct(F.col(tokens))).alias(token))
    need = patterns.groupBy(pattern_key).agg(F.count("*").alias("_need"))
    hits = exploded.join(small(patterns.select(pattern_key, token)), token).groupBy(key, pattern_key).agg(F.count("*").alias("hits"))
    found = hits.join(small(need), pattern_key)
    return (found.where("hits = _need") if all_of else found).drop("_need")


def best_name(queries: DataFrame, query_key: str, candidates: DataFrame, candidate_key: str, tokens: str, least: float) -> DataFrame:
    """For each query the candidate of the highest token Jaccard, ties to the lower key; both sides have arrays of distinct tokens.

    Pairs with a token in common that at most ``RARE`` candidates hold meet by
    it and are scored where they meet, so each token of a query meets at most
    so many.  All other pairs share common tokens only, and of the candidates
    with the same common tokens only the shortest and then the first can be
    the best of them; so names are brought down to their common tokens, each
    set of a candidate's keeps that one, and a query looks up the sets of its
    own.  A set smaller than what is shared scores too low, never too high, so
    the best of all is the best of all pairs.  Neither pairs nor sets of whole
    names are moved.  Names with more than ``WIDE`` common tokens would have
    too many sets: different ones of these meet by the rarest (a pair of at
    least ``least`` shares one of the first ``n - ceil(least * n) + 1`` of each
    side's n) and are scored where they meet.
    """
    words = F.transform(tokens, lambda t: F.xxhash64(t)).alias("_h")
    q = cut(queries.select(F.col(query_key).alias("_q"), words).withColumn("_id", F.monotonically_increasing_id()), "queries")
    # Numbers in the order of the keys: the lower key has the lower number.
    c = cut(candidates.select(F.col(candidate_key).alias("_c"), words).orderBy("_c").withColumn("_id", F.monotonically_increasing_id()), "candidates")
    spark = queries.sparkSession
    # Little to read but much to compute: the tasks are not left to their sizes in bytes.
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The planner takes what is exploded to be as small as its file; merged, it never passes through the driver.
    merged = lambda df: df.hint("merge")
    shared_least = lambda n: F.ceil(F.lit(float(least)) * n - 1e-9)

    often = cut(c.select(F.explode("_h").alias("_t")).groupBy("_t").agg(F.count("*").alias("_f")).where(F.col("_f") > RARE), "often")
    common = small(often)
    common = merged(often) if common is often else common

    def split(df: DataFrame, label: str) -> DataFrame:
        """Each name's rare tokens, and its common ones from the rarest on."""
        each = df.select("_id", F.explode("_h").alias("_t")).join(common, "_t", "left")
        rare, rest = F.collect_list(F.when(F.col("_f").isNull(), F.col("_t"))), F.collect_list(F.when(F.col("_f").isNotNull(), F.struct("_f", "_t")))
        parts = each.groupBy("_id").agg(rare.alias("_rare"), F.transform(F.sort_array(rest), lambda x: x["_t"]).alias("_often"))
        return cut(parts.withColumn("_n", (F.size("_rare") + F.size("_often")).cast("long")).withColumn("_s", F.xxhash64("_often", "_n")), label)

    of_q, of_c = split(q, "split-queries"), split(c, "split-candidates")

    def rare(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col("_id").alias(f"_{side}_id"), F.concat("_rare", "_often").alias(f"_{side}_h"), F.explode("_rare").alias("_t"))

    shared = F.size(F.array_intersect("_q_h", "_c_h"))
    by_rare = rare(of_q, "q").join(merged(rare(of_c, "c")), "_t").select("_q_id", (shared / (F.size("_q_h") + F.size("_c_h") - shared)).alias("score"), "_c_id").where(F.col("score") >= least)

    # Different common tokens and lengths; of candidates the least length and number in one long, so that it is kept in place.
    kinds_q = cut(of_q.where(F.size("_often") > 0).select("_s", "_often", "_n").distinct(), "kinds-queries")
    kinds_c = cut(of_c.where(F.size("_often") > 0).groupBy("_often").agg(F.min(F.shiftleft("_n", 48).bitwiseOR(F.col("_id"))).alias("_first")).withColumn("_n", F.shiftright("_first", 48)), "kinds-candidates")
    narrow, wide = F.size("_often") <= WIDE, F.size("_often") > WIDE

    def sets(df: DataFrame, key: str) -> DataFrame:
        k = F.bit_count("_m")
        each = df.where(narrow).repartition(tasks, key).withColumn("_m", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, size(_often)) - 1")))).where(k >= shared_least(F.col("_n")))
        of = [F.when(F.col("_m").bitwiseAND(1 << i) != 0, F.get("_often", F.lit(i))).otherwise(F.lit(0).cast("long")) for i in range(WIDE)]
        return each.select(key, "_n", k.cast("long").alias("_k"), reduce(lambda x, y: x.bitwiseXOR(y), of).alias("_set"))

    def scored(k):
        return (k / (F.col("_n") + F.shiftright("_first", 48) - k)).alias("score")

    held = sets(kinds_c, "_first").groupBy("_set", "_k").agg(F.min("_first").alias("_first"))
    by_sets = merged(sets(kinds_q, "_s")).join(held, ["_set", "_k"]).select("_s", scored(F.col("_k")), "_first")

    def prefixes(df: DataFrame) -> DataFrame:
        first = (F.size("_often") - shared_least(F.col("_n")) + F.lit(1 if least > 0 else 0)).cast("int")
        return df.where(first > 0).withColumn("_t", F.explode(F.slice("_often", F.lit(1), first)))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        held = prefixes(b).select("_t", "_first", F.col("_often").alias("_c_often"))
        return prefixes(a).join(merged(held), "_t").select("_s", scored(F.size(F.array_intersect("_often", "_c_often"))), "_first")

    kinds = by_sets.unionByName(met(kinds_q.where(wide), kinds_c)).unionByName(met(kinds_q.where(narrow), kinds_c.where(wide))).where(F.col("score") >= least)
    of_kind = best_of(kinds.select("_s", "score", F.col("_first").bitwiseAND((1 << 48) - 1).alias("_c_id")), "_s")
    by_kind = merged(of_q.select(F.col("_id").alias("_q_id"), "_s")).join(of_kind, "_s").select("_q_id", "score", "_c_id")

    best = best_of(by_rare.unionByName(by_kind), "_q_id")
    named = best.join(merged(q.select("_q", F.col("_id").alias("_q_id"))), "_q_id").join(merged(c.select("_c", F.col("_id").alias("_c_id"))), "_c_id")
    return named.groupBy(F.col("_q").alias(query_key)).agg(F.min_by(F.struct(F.col("_c").alias(candidate_key), "score"), F.struct(-F.col("score"), F.col("_c"))).alias("_b")).select(query_key, "_b.*")


def best_of(scored: DataFrame, key: str) -> DataFrame:
    """For each key the highest score and its lowest number; few scores for each key, so the first of each is kept in place, and of these the best."""
    first = scored.groupBy(key, "score").agg(F.min("_c_id").alias("_c_id"))
    return first.groupBy(key).agg(F.min_by(F.struct("_c_id", "score"), F.struct(-F.col("score"), F.col("_c_id"))).alias("_b")).select(key, "_b.*")


def longest_prefix(df: DataFrame, column: str, prefixes: DataFrame, prefix: str, value: str, most: int) -> DataFrame:
    """Each row with the value of its longest known prefix: one equi-join on the prefixes of each distinct value."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    each = values.select(column, F.explode(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.substring(F.col(column), 1, n))).alias(prefix)).distinct()
    hit = each.join(small(prefixes), prefix).groupBy(column).agg(F.max_by(value, F.length(prefix)).alias(value))
    return df.join(hit, column, "left")


def contains_quote(rows: DataFrame, text: str, quote: str) -> DataFrame:
    """With ``contained``: the quote stands in the text once white space and case are set aside."""
    from quarrylight.functions.text import squeeze

    return rows.withColumn("contained", F.coalesce(F.instr(F.lower(squeeze(text)), F.lower(squeeze(quote))) > 0, F.lit(False)))


def host_suffix(df: DataFrame, host: str, suffixes: DataFrame, suffix: str) -> DataFrame:
    """Rows whose host is, or lies under, a listed name: the label suffixes of each distinct host joined by equality."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = df.select(host).where(F.col(host).isNotNull()).distinct()
    each = hosts.select(host, F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))).alias(suffix))
    return df.join(each.join(small(suffixes), suffix, "left_semi").select(host).distinct(), host, "left_semi")


def quotes_in_pages(claims: DataFrame, pages: DataFrame, key: str, address: str, quote: str, text: str, least: int) -> DataFrame:
    """``(key, code)`` of claimed quotes: joined with the stored pages by address, then looked for once white space and case are set aside.

    Equal pages of one address are compared once; a quote below ``least`` characters proves nothing.
    """
    from quarrylight.functions.text import squeeze

    stored = pages.select(F.col(address).alias("_a"), F.lower(squeeze(text)).alias("_t")).distinct()
    asked = claims.select(key, F.col(address).alias("_a"), F.col(quote).alias("_q"), F.lower(squeeze(quote)).alias("_n"))
    met = asked.join(stored, "_a", "left").groupBy(key, "_q").agg(F.count("_t").alias("_pages"), F.bool_or(F.contains("_t", F.col("_n"))).alias("_in"))
    short = F.col("_q").isNull() | (F.length(F.trim("_q")) < least)
    return met.select(key, F.when(short, "too short").when(F.col("_pages") == 0, "page not found").when(F.coalesce("_in", F.lit(False)), "verified").otherwise("quote not found").alias("code"))
