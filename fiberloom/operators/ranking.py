"""First rows, slices, runs and deterministic top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list[str], most: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``most`` rows of each key in order, with their number if a name for it is given."""
    out = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank or "_rank") <= most)
    return out if rank else out.drop("_rank")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, least: int) -> DataFrame:
    """Runs of at least ``least`` neighbouring rows of a key with the same value: where each starts and how long it is."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    first = [F.min_by(c, F.struct(*order)).alias(f"first_{c}") for c in order]
    return marked.groupBy(*keys, "_run", value).agg(F.count("*").alias("n"), *first).where(F.col("n") >= least).drop("_run")


def top(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of a total order; the caller ends it with a unique column."""
    return df.orderBy(*order).limit(most)
