"""Mixing sources to target weights (problem 9).

Each record gets a hash between 0 and 1 and its size in tokens.  Sizes are
summed by source and hash bucket, at most ``BUCKETS`` sums for a source.  A
source's budget is met by whole repeats of all its records and, for the rest,
by the records below a threshold of the hash: whole buckets by the sums, and
within the boundary bucket, which alone is looked at again, by a finer
histogram of the same kind.  Records are then filtered by comparing their hash
with the threshold; nothing is sorted, and thresholds nest: a larger total keeps
every record that a smaller one has below its threshold.  One record beyond it
fills what is left of a budget.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.runtime import bound_batches, cut

#: Buckets of one level; two levels part a source into BUCKETS ** 2 slices.
BUCKETS = 1024
LEVELS = 3
#: How far the share of a source with enough text may lie from its target.
TOLERANCE = 0.002
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that public vocabulary parts a text before it joins bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """The documents with their size in tokens in place of the text; a null text has none."""
    bound_batches(documents.sparkSession)
    rest = [c for c in documents.columns if c != text]
    schema = documents.select(*rest).schema.add(name, "long")

    # A vocabulary has a fixed size; executors need no file of their own.
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def batches(rows):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        coder = tiktoken.Encoding(os.path.basename(tokenizer), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in rows:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(sizes, pa.int64())], names=[*rest, name])

    return documents.select(*rest, text).mapInArrow(batches, schema)


def _total(sources: list[tuple[float, int, int]], size: str) -> int:
    """The tokens of the mix, from each source's share, its tokens, and its tokens with repeats."""
    if not sources:
        return 0
    if size == "whole":
        return sum(n for _, n, _ in sources)
    low = min(cap / w for w, _, cap in sources)
    if size == "exact":
        return int(low)
    # What is missing of the short ones raises the others' shares by missing / (1 - missing), the largest most.
    missing = lambda total: sum(max(0.0, w - cap / total) for w, _, cap in sources)
    # A tenth of the tolerance is left for sizes that no record fits exactly.
    most = 0.9 * TOLERANCE / (0.9 * TOLERANCE + max(w for w, _, _ in sources))
    high = max(low, float(sum(cap for _, _, cap in sources)))
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if missing(mid) <= most else (low, mid)
    return int(low)


def _digit(level: int):
    """The hash's digit of one level, in base BUCKETS."""
    return F.shiftright("_hash", 10 * level).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, size: str = "balanced") -> tuple[DataFrame, DataFrame]:
    """The mix as ``(key, source, n_tokens, uses)`` and its report by source.

    Sources without text or without a target, and null names, take no part; the
    targets of the others are brought to a sum of one (``feasible_share``).
    Without ``total_tokens`` the mix is, by ``size``, ``balanced``: the largest
    in which every source with enough text is within ``TOLERANCE`` of its
    feasible share, the rest being reported as ``short``; ``exact``: the largest
    in which none is short; or ``whole``: as large as all records of its sources
    together, which leaves more of them short and the others above their
    shares.  A record is used ``uses`` times, never
    more than its source's ``max_repeats``; a source's size is met as nearly as one more
    record can.  Null and blank texts have no tokens and are not used; repeated rows
    are records of their own.  Empty tables give an empty mix.
    """
    spark = documents.sparkSession
    t = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")).where("source is not null")
    wanted = documents.select(key, "source", text).join(F.broadcast(t.select("source").distinct()), "source", "left_semi") if _small(t) else documents.select(key, "source", text).join(t.select("source").distinct(), "source", "left_semi")
    wanted = wanted.where(F.col(text).isNotNull() & (F.trim(text) != ""))
    # 30 bits of hash are three digits; the row's own text takes part, so that repeated keys differ.
    hashed = wanted.withColumn("_hash", F.xxhash64(F.col(key), F.col(text)).bitwiseAND(F.lit((1 << (10 * LEVELS)) - 1)))
    sized = cut(token_counts(hashed, tokenizer, text).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    by_bucket = sized.groupBy("source", _digit(LEVELS - 1).alias("_b")).agg(F.sum("n_tokens").alias("_sum"))
    have = by_bucket.groupBy("source").agg(F.sum("_sum").alias("available"))
    plan = cut(t.join(have, "source", "left").na.fill(0, ["available"]), "targets")
    supplied = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    # A row for each target, no larger than the table of targets.
    caps = [(r["target_share"], r["available"], r["available"] * r["max_repeats"]) for r in plan.where(supplied).collect()]
    scale = sum(w for w, _, _ in caps) or 1.0
    plan = plan.withColumn("feasible_share", F.when(supplied, F.col("target_share") / F.lit(scale)).otherwise(0.0))
    if total_tokens is None:
        total_tokens = _total([(w / scale, n, cap) for w, n, cap in caps], size)
    plan = plan.withColumn("budget", F.least(F.round(F.col("feasible_share") * F.lit(total_tokens)).cast("long"), F.col("available") * F.col("max_repeats")))
    # Whole repeats of everything, and what is left for some records once more.
    plan = plan.withColumn("whole", F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(0)).withColumn("_left", F.col("budget") - F.col("whole") * F.col("available"))
    plan = plan.withColumn("_more", F.col("whole") < F.col("max_repeats"))
    # Nested thresholds: at each level the buckets that fit wholly, then only the boundary bucket again.
    bound = plan.where("_more and _left > 0").select("source", "_left", F.lit(0).cast("long").alias("_limit"))
    inside = sized
    for level in range(LEVELS - 1, -1, -1):
        shift = 10 * level
        sums = by_bucket if level == LEVELS - 1 else inside.groupBy("source", _digit(level).alias("_b")).agg(F.sum("n_tokens").alias("_sum"))
        w = Window.partitionBy("source").orderBy("_b")
        run = sums.join(bound, "source").withColumn("_upto", F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        fits = run.groupBy("source").agg(
            F.max("_left").alias("_left0"),
            F.max("_limit").alias("_base"),
            F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_left"), F.col("_upto"))), F.lit(0)).alias("_used"),
            F.min(F.when(F.col("_upto") > F.col("_left"), F.col("_b"))).alias("_edge"),
        )
        # Without a boundary bucket everything below the next slice fits.
        bound = fits.select("source", (F.col("_left0") - F.col("_used")).alias("_left"), (F.col("_base") + F.coalesce(F.col("_edge").cast("long"), F.lit(BUCKETS).cast("long")) * F.lit(1 << shift)).alias("_limit"))
        if level:
            inside = sized.join(_hint(bound), "source").where((F.col("_hash") >= F.col("_limit")) & (F.col("_hash") < F.col("_limit") + F.lit(1 << shift))).select(*sized.columns)
        bound = cut(bound, "thresholds")
    # What is still missing of a budget is filled by one record beyond the threshold, the one whose size comes nearest to it.
    beyond = sized.join(_hint(bound), "source").where((F.col("_hash") >= F.col("_limit")) & (F.col("_left") > 0) & (F.abs(F.col("n_tokens") - F.col("_left")) < F.col("_left")))
    extra = beyond.groupBy("source").agg(F.min_by("_row", F.struct(F.abs(F.col("n_tokens") - F.col("_left")), "_hash", "_row")).alias("_extra"))
    chosen = sized.join(_hint(plan.select("source", "whole")), "source").join(_hint(bound.select("source", "_limit")), "source", "left").join(_hint(cut(extra, "extras")), "source", "left")
    more = (F.col("_hash") < F.coalesce("_limit", F.lit(0))) | F.coalesce(F.col("_row") == F.col("_extra"), F.lit(False))
    chosen = chosen.withColumn("uses", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")).where("uses > 0").select(key, "source", "n_tokens", "uses")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"), F.count("*").alias("records"))
    report = plan.select("source", "target_share", "feasible_share", "max_repeats", "available").join(used, "source", "left").na.fill(0, ["used_tokens", "most_uses", "records"])
    # One window over the sources' totals, a row for each target.
    report = report.withColumn("_total", F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))).withColumn("actual_share", F.when(F.col("_total") > 0, F.col("used_tokens") / F.col("_total")).otherwise(0.0)).withColumn("short", F.col("actual_share") < F.col("target_share") - TOLERANCE).drop("_total")
    return chosen, report


def _small(df: DataFrame, rows: int = 10_000) -> bool:
    """Whether a table of short rows is small enough to be sent to every executor."""
    return df.limit(rows + 1).count() <= rows


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _small(df) else df
