"""Order-dependent reductions: the first or strongest row of a key, ordered distinct lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``; ties are settled by the rest of ``order`` alone."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(at)).where("_rank = 1").drop("_rank")


def ordered(value: Column, seq: Column) -> Column:
    """Aggregate: the values in the order of ``seq``, nulls left out."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(seq.alias("s"), value.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def ordered_distinct(value: Column, seq: Column) -> Column:
    """Aggregate: each value once, where it first occurs. Repeated values are met once before they are gathered."""
    return F.array_distinct(ordered(value, seq))


def first_value(value: Column, seq: Column) -> Column:
    """Aggregate: the first non-null value."""
    return F.min_by(value, F.when(value.isNotNull(), seq))


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once, however often it is used: no optimizer rule copies it
    into its users, as it would with a plain column of a large expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def numbered(df: DataFrame, keys: list[str], seq: str, name: str, size: int = 4096) -> DataFrame:
    """``df`` with each row's number within its key in the order of the integer column ``seq``, from 1.

    Rows are numbered within slices of ``size`` values of ``seq``, and counts of the slices before are
    added, so a key with a third of all rows is never sorted in one task. Null keys count as keys.
    """
    rows = df.withColumn("_slice", F.floor(F.col(seq) / size))
    same = lambda a, b, on: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in on]
    counts = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(seq)))
    joined = at.alias("a").join(before.alias("b"), same("a", "b", [*keys, "_slice"]))
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("_at") + F.col("_before")).cast("bigint").alias(name))
