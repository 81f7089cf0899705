"""Sources mixed to target weights by systematic sampling (problem 8).

Sizes are tokens of a public tokenizer.  The total is the largest for which every source with documents
can give its share without repeating a document more often than allowed, so each of its documents
is expected ``c`` times with ``c <= max_repeats``.  Within a source the documents stand in order of size;
prefix sums of ``c`` plus one random offset are taken, and a document comes out once for each whole
number that its interval crosses.  Each document so comes out floor(c) or ceil(c) times, and as
neighbours have like sizes, the tokens reached lie close to the target.

Scale: the prefix sum of equal steps is a rank, and the ranks come from a range partitioning by source
and size: each partition numbers its own rows and learns its offset from the counts of the partitions
before it.  No source is ever in one task; what is broadcast is one row per source, or one per partition
and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.trie_bpe import VOCABULARY, token_counts
from lodestrata.runtime import shuffle_tasks, spread, written

_FRACTION = 1 << 30


def sized_documents(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``source, doc_id, n_tokens`` of the documents of listed sources that have any tokens."""
    listed = targets.filter("source is not null and target_share > 0").select("source").distinct()
    docs = spread(documents.filter("doc_id is not null").select("doc_id", "source", "text")).join(listed, "source", "left_semi")
    return token_counts(docs.select("source", "doc_id", "text"), ["source", "doc_id"], vocabulary=vocabulary).filter("n_tokens > 0")


def ranked(sized: DataFrame, tasks: int) -> DataFrame:
    """``sized`` with ``rank``, the 0-based place within the source by size, without gathering a source."""
    placed = sized.repartitionByRange(tasks, "source", "n_tokens", "doc_id").withColumn("part", F.spark_partition_id())
    fixed = written(placed, "mix-placed")
    counts = fixed.groupBy("source", "part").count()
    before = counts.select("source", "part", F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("source", "part").orderBy("n_tokens", "doc_id")) - 1
    # one row per partition and source: at most partitions + sources rows, as the ranges are disjoint
    return fixed.withColumn("local", local).join(before, ["source", "part"]).select("source", "doc_id", "n_tokens", (F.col("before") + F.col("local")).alias("rank"))


def plan_shares(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per listed source: ``source, target_share, max_repeats, n_docs, available_tokens, copies``.

    ``copies`` is the expected number of times that each document is taken.  Sources without
    tokens get 0; the shares of the others are scaled to sum to 1.
    """
    listed = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.coalesce(F.min(F.greatest("max_repeats", F.lit(0))), F.lit(1)).alias("max_repeats"))
    have = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens").cast("long")).alias("available_tokens"))
    rows = listed.join(have, "source", "left").fillna(0, ["n_docs", "available_tokens"])
    usable = (F.col("available_tokens") > 0) & (F.col("max_repeats") > 0)
    everything = Window.partitionBy(F.lit(1))  # one row per listed source
    share = F.when(usable, F.col("target_share")) / F.sum(F.when(usable, F.col("target_share"))).over(everything)
    most = F.min(F.when(usable, F.col("available_tokens") * F.col("max_repeats") / F.col("share"))).over(everything)
    total = most if total_tokens is None else F.lit(float(total_tokens))
    wanted = F.try_divide(F.col("share") * F.col("total"), F.col("available_tokens"))
    return rows.withColumn("share", share).withColumn("total", total).select("source", "target_share", "max_repeats", "n_docs", "available_tokens", F.when(usable, F.least(wanted, F.col("max_repeats").cast("double"))).otherwise(0.0).alias("copies"))


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 1, total_tokens: int | None = None, vocabulary: str = VOCABULARY, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (``doc_id, source, copy, n_tokens``, one row per copy) and the report of shares.

    Defined cases: documents of sources that are not listed, or with null or empty texts (no tokens), do
    not occur; null shares and shares of 0 list no source; a null ``max_repeats`` allows one copy; a source
    listed twice has its shares added and the smaller limit; repeated rows of a document are documents of
    their own; with ``total_tokens`` set, sources that cannot fill their share give all that they may.
    Empty tables give an empty mixture.  The order of sizes and ids and the seed fix the result.
    """
    spark = documents.sparkSession
    sized = written(sized_documents(documents, targets, vocabulary), "mix-sized")
    plan = written(plan_shares(sized, targets, total_tokens), "mix-plan")
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(_FRACTION)) / F.lit(float(_FRACTION))
    at = ranked(sized, tasks or shuffle_tasks(spark)).join(plan.select("source", "copies", "max_repeats", offset.alias("offset")), "source")
    upto = lambda k: F.floor(k * F.col("copies") + F.col("offset"))
    times = at.withColumn("times", F.least(upto(F.col("rank") + 1) - upto(F.col("rank")), F.col("max_repeats").cast("long")))
    taken = times.filter("times > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    mixture = taken.select("doc_id", "source", "copy", "n_tokens")
    # from the number of copies, before they become rows
    reached = times.filter("times > 0").groupBy("source").agg(F.sum("times").alias("taken_docs"), F.sum(F.col("n_tokens").cast("long") * F.col("times")).alias("taken_tokens"))
    report = plan.join(reached, "source", "left").fillna(0, ["taken_docs", "taken_tokens"])
    actual = F.try_divide(F.col("taken_tokens"), F.sum("taken_tokens").over(Window.partitionBy(F.lit(1))))
    return mixture, report.select("source", "target_share", "max_repeats", "n_docs", "available_tokens", "copies", "taken_docs", "taken_tokens", F.coalesce(actual, F.lit(0.0)).alias("actual_share"))
