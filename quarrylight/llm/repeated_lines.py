"""Lines repeated across the documents of one source (problem 6).

Each line becomes a 96-bit pair of hashes of its source and letters.  Distinct
addresses are counted by two aggregates, first for line and address together,
then for the line, so that no task holds a line that stands on every page of a
large source.  The frequent ones are joined back to the lines; a source's share
of all rows makes a skewed join key at worst, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.lines import exploded, letters
from quarrylight.runtime import cut

MIN_DOCUMENTS = 10


def repeated_lines(pages: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = 0.0, key: str = "page_id", source: str = "domain", address: str = "url", text: str = "text") -> DataFrame:
    """``(key, line_no)`` of the lines that recur over a source's addresses.

    A line counts by its letters only, in lower case; a line without a letter
    never counts.  It recurs if it stands on at least ``min_documents``
    distinct addresses of its source and on at least the share ``min_share``
    of them.  Repeated rows of one address count once.  A null text gives no
    rows; a null source or address counts as a value of its own.  An empty
    table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(key).alias("_k"), F.coalesce(F.col(source), F.lit("\u0000")).alias("_s"), F.xxhash64(F.coalesce(F.col(address), F.lit("\u0000"))).alias("_u"), F.col(text).alias("_t")).where("_t is not null")
    lines = exploded(rows, "_t", "_k", "_s", "_u").withColumn("_n", letters("line")).where("_n <> ''")
    hashed = lines.select(F.col("_k").alias(key), "line_no", "_u", F.xxhash64("_s", "_n").alias("_h"), F.hash("_n", "_s").alias("_g"), *([F.xxhash64("_s").alias("_d")] if min_share > 0 else []))
    # Numbers only from here on; cut, as counting and joining back both read them.
    hashed = cut(hashed, "lines")
    once = hashed.groupBy("_h", "_g", "_u").agg(*([F.first("_d").alias("_d")] if min_share > 0 else [F.lit(1).alias("_one")]))
    counted = once.groupBy("_h", "_g").agg(F.count("*").alias("n_documents"), *([F.first("_d").alias("_d")] if min_share > 0 else []))
    found = counted.where(F.col("n_documents") >= min_documents)
    if min_share > 0:
        sizes = rows.select(F.xxhash64("_s").alias("_d"), "_u").distinct().groupBy("_d").agg(F.count("*").alias("_all"))
        found = found.join(sizes, "_d").where(F.col("n_documents") >= F.col("_all") * min_share)
    return hashed.join(found.select("_h", "_g"), ["_h", "_g"]).select(key, "line_no")


def without_lines(pages: DataFrame, drop: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """The documents rebuilt without the lines named in ``drop(key, line_no)``.

    All columns are kept; a null text stays null, and a text that loses all
    its lines becomes empty.
    """
    name = "_drop"
    while name in pages.columns:
        name += "_"
    lists = drop.groupBy(key).agg(F.collect_set(F.col("line_no").cast("int")).alias(name))
    parts = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(name), (i + 1).cast("int"))), "\n")
    return pages.join(lists, key, "left").withColumn(text, F.when(F.col(name).isNull(), F.col(text)).otherwise(kept)).drop(name)
