"""Comparing two tables on a key."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from statweave.plans.common import cut_lineage, num, ratio
from statweave.plans.cumulate import quantiles

c = F.col


@dataclass
class TableDiff:
    """Lazy parts of a comparison; ``summary`` is the one-row verdict."""

    rows: DataFrame          # keys on one side only: key..., side
    columns: DataFrame       # per column: status, n_compared, n_diff, ratio, median/max abs diff
    cells: DataFrame         # changed cells: key..., column, from, to
    duplicates: DataFrame    # keys occurring more than once: key..., side, n
    summary: DataFrame


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def compare(a: DataFrame, b: DataFrame, key: Sequence[str] | str, columns: Sequence[str] | None = None,
            pairs: dict[str, str] | None = None) -> TableDiff:
    """Null-safe cell comparison of rows that share a key.  ``pairs`` links a column of ``a`` to its
    renamed twin in ``b``.  Keys occurring more than once have no unique partner: they are listed, and
    only uniquely keyed rows have their cells compared.  A null key matches nothing.

    Both tables go through one grouped union: per key the rows of each side and what changed, written
    once; all parts of the answer read that."""
    key = [key] if isinstance(key, str) else list(key)
    for k in key:
        if k not in a.columns or k not in b.columns:
            raise ValueError(f"key column {k!r} must be in both tables")
    twin = {x: y for x, y in (pairs or {}).items() if x in a.columns and y in b.columns}
    mapped = {x: twin.get(x, x) for x in a.columns if x not in key and (columns is None or x in columns)}
    mapped = {x: y for x, y in mapped.items() if y in b.columns}
    clean = lambda df, v: num(v) if dict(df.dtypes)[v] in ("double", "float") else c(v)
    names = list(mapped)
    ks = [f"k{i}" for i in range(len(key))]
    back = lambda df: df.withColumnsRenamed(dict(zip(ks, key)))

    def side(df: DataFrame, s: str, cols: Sequence[str]) -> DataFrame:
        cells = F.struct(F.lit(0).alias("_"), *[clean(df, x).alias(f"v{i}") for i, x in enumerate(cols)])
        keys = df.select(*[c(k).cast("string").alias(f"k{i}") for i, k in enumerate(key)], cells.alias(f"r{s}"))
        lone = reduce(lambda x, y: x | y, [c(k).isNull() for k in ks])
        return keys.select(*ks, F.when(lone, s).otherwise("").alias("_lone"), F.lit(s).alias("_s"), f"r{s}").withColumn(f"n{s}", F.lit(1))

    union = side(a, "a", names).unionByName(side(b, "b", [mapped[x] for x in names]), allowMissingColumns=True)
    grouped = union.groupBy(*ks, "_lone").agg(F.count("na").alias("n_a"), F.count("nb").alias("n_b"), F.first("ra", ignorenulls=True).alias("ra"), F.first("rb", ignorenulls=True).alias("rb"))
    flags = [_differs(c(f"ra.v{i}"), c(f"rb.v{i}")) for i in range(len(names))]
    numeric = [isinstance(a.schema[x].dataType, NumericType) and isinstance(b.schema[mapped[x]].dataType, NumericType) for x in names]
    nothing = F.expr("cast(array() as array<struct<column:string,`from`:string,to:string,gap:double>>)")
    changed = F.array_compact(F.array(*[F.when(f, F.struct(
        F.lit(x).alias("column"), c(f"ra.v{i}").cast("string").alias("from"), c(f"rb.v{i}").cast("string").alias("to"),
        (F.abs(c(f"ra.v{i}").cast("double") - c(f"rb.v{i}").cast("double")) if numeric[i] else F.lit(None).cast("double")).alias("gap")))
        for i, (x, f) in enumerate(zip(names, flags))])) if names else nothing
    pair = (c("n_a") == 1) & (c("n_b") == 1)
    keys = cut_lineage(grouped.select(*ks, "n_a", "n_b", F.when(pair, changed).otherwise(nothing).alias("changed")))
    several = F.filter(F.array(F.struct(F.lit("a").alias("side"), c("n_a").alias("n")), F.struct(F.lit("b").alias("side"), c("n_b").alias("n"))), lambda r: r["n"] > 1)
    dups = keys.select(*ks, F.explode(several).alias("r")).select(*ks, "r.side", "r.n")
    rows = keys.where("n_a = 0 or n_b = 0").select(*ks, F.when(c("n_b") == 0, "a").otherwise("b").alias("side"))
    cells = keys.select(*ks, F.explode("changed").alias("r")).select(*ks, "r.*")
    size = keys.agg(F.sum(pair.cast("long")).alias("n"), *[F.coalesce(F.sum(F.array_contains(c("changed.column"), x).cast("long")), F.lit(0)).alias(f"d{i}") for i, x in enumerate(names)])
    size = size.withColumn("n", F.coalesce("n", F.lit(0)))
    spark = a.sparkSession
    per = size.select("n", F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.lit(mapped[x]).alias("column_b"), c(f"d{i}").alias("n_diff"))
                                               for i, x in enumerate(names)])).alias("r")).select("n", "r.*") if names else None
    gaps = quantiles(cells.select("column", "gap"), "gap", [0.5, 1.0], ["column"]).select(
        "column", c("q0").alias("median_abs_diff"), c("q1").alias("max_abs_diff"))
    one_side = [(x, None, "only_a") for x in a.columns if x not in key and x not in mapped and (columns is None or x in columns)]
    one_side += [(None, y, "only_b") for y in b.columns if y not in key and y not in mapped.values() and (columns is None or y in columns)]
    cols = spark.createDataFrame(one_side, "column string, column_b string, status string").select(
        "column", "column_b", "status", *[F.lit(None).cast(t).alias(v) for v, t in (
            ("n_compared", "bigint"), ("n_diff", "bigint"), ("ratio", "double"), ("median_abs_diff", "double"), ("max_abs_diff", "double"))])
    if per is not None:
        cols = per.join(gaps, "column", "left").select(
            "column", "column_b", F.when(c("n_diff") > 0, "changed").otherwise("same").alias("status"), c("n").alias("n_compared"), "n_diff",
            ratio(c("n_diff"), c("n")).alias("ratio"), "median_abs_diff", "max_abs_diff").unionByName(cols)
    s = cols.agg(F.coalesce(F.sum("n_diff"), F.lit(0)).alias("cells_changed"), F.sum((c("status") == "changed").cast("long")).alias("columns_changed"),
                 F.sum(c("status").startswith("only").cast("long")).alias("columns_unmatched"))
    r = rows.agg(F.coalesce(F.sum((c("side") == "a").cast("long")), F.lit(0)).alias("rows_removed"),
                 F.coalesce(F.sum((c("side") == "b").cast("long")), F.lit(0)).alias("rows_added"))
    d = dups.agg(F.count(F.lit(1)).alias("duplicate_keys"))
    from statweave.operators.regression import _paste
    summary = _paste(_paste(s, r), d)
    summary = summary.withColumn("identical", sum((c(v) for v in ("cells_changed", "columns_unmatched", "rows_removed", "rows_added", "duplicate_keys")), F.lit(0)) == 0)
    return TableDiff(back(rows), cols, back(cells.drop("gap")), back(dups), summary)


def cell_examples(diff: TableDiff, key: Sequence[str] | str, shown: int = 5) -> DataFrame:
    """A few changed cells per column (smallest keys first)."""
    key = [key] if isinstance(key, str) else list(key)
    shard = Window.partitionBy("column", F.pmod(F.xxhash64(*key), F.lit(64))).orderBy(*key)
    pre = diff.cells.withColumn("_s", F.row_number().over(shard)).where(c("_s") <= shown)
    w = Window.partitionBy("column").orderBy(*key)
    return pre.withColumn("_r", F.row_number().over(w)).where(c("_r") <= shown).drop("_r", "_s")


def column_view(a: DataFrame, b: DataFrame, key: str, column: str, column_b: str | None = None) -> DataFrame:
    """Both sides of one matched numeric column: summaries, changed share, KS and Wasserstein-1."""
    from statweave.operators.rank_tests import energy_distance, ks_two_sample
    from statweave.operators.regression import _paste
    other = column_b or column
    j = a.select(c(key).alias("_k"), num(column).alias("x")).join(b.select(c(key).alias("_k"), num(other).alias("y")), "_k")
    long = j.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), c("x").alias("v")), F.struct(F.lit("b").alias("side"), c("y").alias("v")))).alias("r")).select("r.*")
    m = long.groupBy("side").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(long, "v", [0.25, 0.5, 0.75], ["side"]).select("side", c("q1").alias("median"), (c("q2") - c("q0")).alias("iqr"))
    both = m.join(q, "side")
    pick = lambda s, v: F.max(F.when(c("side") == s, c(v))).alias(f"{v}_{s}")
    wide = both.agg(*[pick(s, v) for s in "ab" for v in ("n", "mean", "median", "min", "max", "iqr")])
    changed = j.agg(F.sum((~c("x").eqNullSafe(c("y"))).cast("long")).alias("n_changed"), F.count(F.lit(1)).alias("n_rows"))
    ks = ks_two_sample(long, "v", "side", ["a", "b"]).select(c("statistic").alias("ks"))
    w1 = energy_distance(long, "v", "side", ["a", "b"], permutations=0).select(c("numbers")["wasserstein"].alias("wasserstein"))
    return _paste(_paste(_paste(wide, changed), ks), w1)


def column_view_text(a: DataFrame, b: DataFrame, key: str, column: str, column_b: str | None = None) -> DataFrame:
    """Level shares of both sides with their total variation distance on every row."""
    j = a.select(c(key).alias("_k"), c(column).cast("string").alias("x")).join(b.select(c(key).alias("_k"), c(column_b or column).cast("string").alias("y")), "_k")
    long = j.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), c("x").alias("level")), F.struct(F.lit("b").alias("side"), c("y").alias("level")))).alias("r")) \
            .select("r.*").where("level is not null")
    t = long.groupBy("level").agg(F.sum((c("side") == "a").cast("long")).alias("n_a"), F.sum((c("side") == "b").cast("long")).alias("n_b"))
    total = t.agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b"))
    share = lambda side: ratio(c(f"n_{side}"), total.select(side).scalar())
    t = t.select("*", share("a").alias("share_a"), share("b").alias("share_b"))
    return t.withColumn("tv", t.agg((F.sum(F.abs(c("share_a") - c("share_b"))) / 2).alias("tv")).scalar())
