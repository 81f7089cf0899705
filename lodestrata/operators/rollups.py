"""Aggregates of telemetry, usage, acknowledgements and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_filter(df: DataFrame, **conditions) -> DataFrame:
    """Conjunction of the options that are set: ``name=value`` tests equality, ``name__since`` and
    ``name__until`` inclusive bounds, ``name__in`` membership, ``name__is`` null-safe equality."""
    for key, value in conditions.items():
        name, _, how = key.partition("__")
        if how == "is":
            df = df.filter(F.col(name).eqNullSafe(value))
        elif value is None:
            continue
        elif how == "since":
            df = df.filter(F.col(name) >= value)
        elif how == "until":
            df = df.filter(F.col(name) <= value)
        elif how == "in":
            df = df.filter(F.col(name).isin(list(value)))
        else:
            df = df.filter(F.col(name) == value)
    return df


def zero_filled(counts: DataFrame, key: str, values: list[str], measures: list[str]) -> DataFrame:
    """Counts for each of the given keys, 0 where none occurred."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{key} string")
    return every.join(counts, key, "left").select(key, *(F.coalesce(m, F.lit(0)).alias(m) for m in measures))


def pivot_counts(df: DataFrame, keys: list[str], by: Column, values: dict[str, object]) -> DataFrame:
    """One conditional count a value, and the total, in one aggregation."""
    return df.groupBy(*keys).agg(*(F.count_if(by == v).alias(name) for name, v in values.items()), F.count("*").alias("total"))


def rate(part: Column, whole: Column) -> Column:
    """A quotient rounded to 4 digits; null where the whole is 0."""
    return F.round(F.try_divide(part, whole), 4)


def grouping_sets(df: DataFrame, sets: list[list[str]], measures: dict[str, str]) -> DataFrame:
    """All groupings in one pass over the rows; ``grouping`` numbers them from 0 in the given order."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    listed = ", ".join(f"({', '.join(s)})" for s in sets)
    number = "case " + " ".join(f"when {' and '.join([f'grouping({c}) = {0 if c in s else 1}' for c in names]) or 'true'} then {i}" for i, s in enumerate(sets)) + " end"
    return df.sparkSession.sql(f"select {number} as grouping, {', '.join(names)}, {', '.join(f'{e} as {n}' for n, e in measures.items())} from {{rows}} group by grouping sets ({listed})", rows=df)


def index_percentile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The value at index floor(share * n) of the sorted values, without interpolation.

    Values are counted first, so that a hot group is as large as its distinct values; the place is found
    by a running sum of counts.
    """
    from pyspark.sql.window import Window

    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys)
    placed = counted.withColumn("__upto", F.sum("__c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(w))
    target = F.least(F.col("__n"), F.floor(F.col("__n") * share) + 1)
    return placed.filter(F.col("__upto") >= target).groupBy(*keys).agg(F.min(value).alias("value"), F.max("__n").alias("n"))
