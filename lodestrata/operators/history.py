"""Histories: latest rows, comparable runs, trust states, trends, budgets, retained tails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lodestrata.operators.search import best_per_key, ranked
from lodestrata.runtime import shuffle_tasks, written

AGING_DAYS, STALE_DAYS = 30, 90
#: Rank of an answer by its trust state.
TRUST_RANK = {"stable": 100, "changed": 90, "aging": 80, "stale": 60, "superseded": 50, "insufficient": 40, "contradicted": 20}


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; the first order column decides, the others break ties."""
    return best_per_key(df, keys, *(F.col(c).desc_nulls_last() for c in order))


def in_order(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with each row's ``__position`` in its key (from 1) and the rows before and after it, ``__prev`` and ``__next``.

    Rows are cut into ranges by key and order, so that a key of any size is the work of many tasks.  Where a key
    goes on from one range to the next, the two rows at the cut and the rows so far are handed over: one row a range comes to the driver.
    """
    spark, columns = df.sparkSession, df.columns
    sort = [*(F.col(k).asc() for k in keys), *order]
    placed = written(df.repartitionByRange(shuffle_tasks(spark), *sort).withColumn("__part", F.spark_partition_id()), "in-order")
    run, part = Window.partitionBy("__part", *keys).orderBy(*order), Window.partitionBy("__part").orderBy(*sort)
    row = F.struct(*columns)
    rows = placed.select("*", F.row_number().over(run).alias("__at"), F.lag(row).over(run).alias("__before"), F.lead(row).over(run).alias("__after"))
    numbered = placed.select("__part", row.alias("__row"), F.row_number().over(run).alias("__at"), F.row_number().over(part).alias("__i"))
    ends = numbered.groupBy("__part").agg(F.min_by("__row", "__i").alias("first"), F.max_by("__row", "__i").alias("last"), F.max_by("__at", "__i").alias("run")).collect()
    ends.sort(key=lambda r: r["__part"])
    key = lambda r: tuple(r[k] for k in keys)
    bounds, so_far = [], 0
    for i, r in enumerate(ends):
        before = ends[i - 1].last if i and key(ends[i - 1].last) == key(r.first) else None
        after = ends[i + 1].first if i + 1 < len(ends) and key(ends[i + 1].first) == key(r.last) else None
        offset = so_far if before is not None else 0
        bounds.append((r["__part"], offset, before, after))
        so_far = r.run + (offset if key(r.first) == key(r.last) else 0)
    schema = StructType([StructField("__part", IntegerType()), StructField("__offset", LongType()), StructField("__head", df.schema), StructField("__tail", df.schema)])
    joined = rows.join(F.broadcast(spark.createDataFrame(bounds, schema)), "__part")
    same = lambda other: F.col(other).isNotNull() & reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{other}.{k}")) for k in keys))
    head, tail = same("__head"), same("__tail")
    return joined.select(
        *columns,
        (F.col("__at") + F.when(head, F.col("__offset")).otherwise(0)).cast("int").alias("__position"),
        F.coalesce("__before", F.when(head, F.col("__head"))).alias("__prev"),
        F.coalesce("__after", F.when(tail, F.col("__tail"))).alias("__next"),
    )


def comparable_pairs(df: DataFrame, keys: list[str], order: list[str], compared: list[str]) -> DataFrame:
    """Each run beside the run before it, with a ``*_changed`` flag for each compared column."""
    pairs = in_order(df.select(*dict.fromkeys([*keys, *order, *compared, *df.columns])), keys, [F.col(c) for c in order]).filter(F.col(f"__prev.{order[-1]}").isNotNull())
    before = [F.col(f"__prev.{c}").alias(f"previous_{c}") for c in (order[-1], *compared)]
    changed = [(~F.col(c).eqNullSafe(F.col(f"__prev.{c}"))).alias(f"{c}_changed") for c in compared]
    return pairs.select(*df.columns, *before, *changed)


def trust_states(df: DataFrame, keys: list[str], order: list[str], at: str, same: Column, contradicts: Column, sufficient: Column, as_of: Column) -> DataFrame:
    """The state of each run of a history.

    The newest run is insufficient, stale, aging, changed (against the one before) or stable, in this order
    of precedence; an older one is contradicted or superseded by the one after it.
    ``same`` and ``contradicts`` may use the columns ``nb_*`` of the neighbour that the run is compared with.
    """
    placed = in_order(df, keys, [F.col(c).desc() for c in order])
    neighbour = F.when(F.col("__position") == 1, F.col("__next")).otherwise(F.col("__prev"))
    rows = placed.select(*df.columns, (F.col("__position") - 1).alias("position"), neighbour.alias("nb")).select(*df.columns, "position", *(F.col(f"nb.{c}").alias(f"nb_{c}") for c in df.columns))
    first = F.col(f"nb_{order[-1]}").isNull()
    days = F.datediff(as_of, F.col(at))
    newest = F.when(~sufficient, "insufficient").when(days >= STALE_DAYS, "stale").when(days >= AGING_DAYS, "aging").when(~first & ~same, "changed").otherwise("stable")
    older = F.when(contradicts, "contradicted").otherwise("superseded")
    return rows.withColumn("trust_state", F.when(F.col("position") == 0, newest).otherwise(older)).drop(*(f"nb_{c}" for c in df.columns))


def trend(df: DataFrame, keys: list[str], order: list[str], good: Column, last: int = 8, least: int = 4) -> DataFrame:
    """The newer half of the last runs against the older half; ``unknown`` below ``least`` runs."""
    w = Window.partitionBy(*keys)
    # the filter on row_number limits each group before the shuffle
    rows = df.withColumn("__rn", F.row_number().over(w.orderBy(*(F.col(c).desc() for c in order)))).filter(F.col("__rn") <= last).withColumn("__n", F.count("*").over(w))
    recent = F.col("__rn") <= F.ceil(F.col("__n") / 2)
    rates = rows.groupBy(*keys).agg(F.max("__n").alias("runs"), F.round(F.avg(F.when(recent, good.cast("int"))), 4).alias("recent_rate"), F.round(F.avg(F.when(~recent, good.cast("int"))), 4).alias("prior_rate"))
    direction = F.when(F.col("runs") < least, "unknown").when(F.col("recent_rate") > F.col("prior_rate"), "improving").when(F.col("recent_rate") < F.col("prior_rate"), "declining").otherwise("steady")
    return rates.withColumn("direction", direction)


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The ranked rows up to the first whose running cost exceeds the budget; the first row always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("running_cost", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(w))
    over = F.max(F.when(F.col("position") > 1, F.col("running_cost") > budget).otherwise(False)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__over", over).filter(~F.col("__over")).drop("__over")


def skipping_budget(df: DataFrame, keys: list[str], rank: str, cost: str, header_cost: str, budget: int) -> DataFrame:
    """One row a key: which ranked items fit a budget when an item too large falls back to its
    header and is passed over if that does not fit either.  ``full`` and ``headers`` list the ranks.

    The choice depends on all choices before, so the ranked list of a key is folded in order.
    """
    items = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(cost).cast("long").alias("c"), F.col(header_cost).cast("long").alias("h")))).alias("items"))
    fold = f"""aggregate(items, named_struct('left', cast({budget} as bigint), 'full', cast(array() as array<int>), 'headers', cast(array() as array<int>)),
        (a, x) -> case when x.c <= a.left then named_struct('left', a.left - x.c, 'full', concat(a.full, array(x.r)), 'headers', a.headers)
                       when x.h <= a.left then named_struct('left', a.left - x.h, 'full', a.full, 'headers', concat(a.headers, array(x.r))) else a end)"""
    return items.withColumn("a", F.expr(fold)).select(*keys, F.col("a.full").alias("full"), F.col("a.headers").alias("headers"), (budget - F.col("a.left")).alias("used"))


def retained_tail(df: DataFrame, keys: list[str], order: list[str], tokens: str, window: int, keep: int = 4, share: float = 0.6) -> DataFrame:
    """``archive`` marks all but the last ``keep`` rows of the keys whose tokens reach the share of the window.

    No key is gathered: totals are combined before the shuffle, and of each key's rows only ``keep`` a task compete for the last ones.
    Keys and order must tell the rows apart.
    """
    totals = df.groupBy(*keys).agg(F.sum(tokens).alias("total_tokens"))
    last = ranked(df.select(*keys, *order), *(F.col(c).desc() for c in order), within=keys, limit=keep, name="__last")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, *order)]
    rows = df.join(totals, keys).alias("a").join(last.alias("b"), reduce(lambda x, y: x & y, same), "left")
    return rows.select("a.*", ((F.col("a.total_tokens") >= share * window) & F.col("b.__last").isNull()).alias("archive"))
