"""Contingency tables: counts per cell, kept as rows so any number of strata stays in Spark."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from statweave.plans.cumulate import cumulate


def crosstab(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, o) of non-null pairs, values as text."""
    return (df.select(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
              .where("a is not null and b is not null")
              .groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("o")))


def with_margins(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds row total, column total, grand total and level counts; a complete r x c grid is
    built from the distinct margins of each stratum (category x category, not rows)."""
    by = list(by)
    rows = cells.groupBy(*by, "a").agg(F.sum("o").alias("row_n"))
    cols = cells.groupBy(*by, "b").agg(F.sum("o").alias("col_n"))
    side = Window.partitionBy(*(by or [F.lit(0)]))
    rows = rows.withColumn("n", F.sum("row_n").over(side)).withColumn("_r", F.count(F.lit(1)).over(side))
    cols = cols.groupBy(*by).agg(F.collect_list(F.struct("b", "col_n")).alias("_cols"))
    grid = (rows.join(cols, by) if by else rows.withColumn("_k", F.lit(1)).join(
        cols.withColumn("_k", F.lit(1)), "_k").drop("_k"))
    grid = grid.select("*", F.size("_cols").alias("_c"), F.explode("_cols").alias("_col")).select(
        *by, "a", F.col("_col.b").alias("b"), "row_n", F.col("_col.col_n").alias("col_n"), "n", "_r", "_c")
    full = grid.join(cells, [*by, "a", "b"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    return full.withColumn("e", F.col("row_n").cast("double") * F.col("col_n") / F.col("n"))


def one_row_each(frames: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Summaries of one row per stratum side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(by)) if by else out.crossJoin(F.broadcast(f))        # without strata: one row each
    return out


def observed(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The observed cells with row_n and col_n; what empty cells add to a statistic follows from the margins."""
    by = list(by)
    rows = cells.groupBy(*by, "a").agg(F.sum("o").alias("row_n"))
    cols = cells.groupBy(*by, "b").agg(F.sum("o").alias("col_n"))
    return cells.join(rows, [*by, "a"]).join(cols, [*by, "b"])


def shape(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per stratum: n, level counts r and k, first and last level of each side, the largest share of a row that misses a column (``bare``), and how many cells of the complete table
    expect fewer than five rows (``small``).

    A cell is small where col_n <= (5 n - 1) div row_n, so one ordered pass over row thresholds and column totals counts them; no cell that is not there is made."""
    by = list(by)
    rows = cells.groupBy(*by, "a").agg(F.sum("o").alias("row_n"), F.count(F.lit(1)).alias("_seen"))
    cols = cells.groupBy(*by, "b").agg(F.sum("o").alias("col_n"))
    k = cols.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.min("b").alias("b_first"), F.max("b").alias("b_last"), F.sum("col_n").alias("n"))
    wide = rows.join(k, by) if by else rows.crossJoin(F.broadcast(k))
    top = wide.groupBy(*by).agg(F.max("n").alias("n"), F.max("k").alias("k"), F.count(F.lit(1)).alias("r"), F.min("a").alias("a_first"), F.max("a").alias("a_last"), F.max("b_first").alias("b_first"),
                                F.max("b_last").alias("b_last"), F.max(F.when(F.col("_seen") < F.col("k"), F.col("row_n") / F.col("n"))).alias("bare"))
    limit: Column = F.expr("(5 * n - 1) div row_n")
    axis = wide.select(*by, limit.alias("v"), F.lit(1).alias("_row"), F.lit(0).alias("_col")).unionByName(
        cols.select(*by, F.col("col_n").alias("v"), F.lit(0).alias("_row"), F.lit(1).alias("_col")))
    t = cumulate(axis, "v", {"_row": F.sum("_row"), "_col": F.sum("_col")}, by)
    small = t.groupBy(*by).agg(F.sum(F.col("_row") * (F.col("cum__col") + F.col("_col"))).cast("long").alias("small"))
    return one_row_each([top, small], by)
