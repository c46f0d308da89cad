"""Ordered accumulation over a numeric axis without a single-partition window.

``cumulate`` is the kernel behind every rank, ECDF, ROC and survival statistic:

1. equal values collapse first (``groupBy`` with map-side combine), so a value held by a third
   of all rows becomes one row before anything is ordered;
2. distinct values are cut into buckets at approximate quantiles; cut points only steer
   balance, any cut gives the same answer, and ties cannot straddle one;
3. a window runs inside each (stratum, bucket), and the per-bucket totals (a table of at most
   strata x buckets rows) supply the offset.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from statweave.plans.common import beside

GRID = 4096


def rows_per_bucket(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("statweave.rowsPerBucket", "1000000"))


def value_cuts(df: DataFrame, value: str) -> list[float]:
    """Bucket borders for ``value``: none while the rows fit one bucket, else one sketch pass and
    at most GRID-1 numbers to the driver."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    want = math.ceil(v.count() / rows_per_bucket(df))
    if want <= 1:
        return []
    want = min(want, GRID)
    grid = ",".join(f"{i / want!r}D" for i in range(1, want))
    row = v.agg(F.expr(f"percentile_approx(v, array({grid}), 20000)").alias("q")).first()
    return sorted({q for q in row["q"] or [] if math.isfinite(q)})


def add_bucket(df: DataFrame, value: str, cuts: Sequence[float], out: str = "_bucket") -> DataFrame:
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=value, outputCol=out,
                      handleInvalid="keep").transform(df)


def cumulate(df: DataFrame, value: str, sums: dict[str, Column], by: Sequence[str] = (),
             cuts: Sequence[float] | None = None, lead: bool = False,
             bucket: str | None = None, laid_out: bool = False) -> DataFrame:
    """One row per (by, distinct value): each sum, its exclusive running total ``cum_*`` and the
    stratum total ``tot_*``; ``next_value`` too when ``lead`` is set.  ``bucket`` names a column
    that is already a monotone function of the value inside each stratum; with ``laid_out`` the rows
    are partitioned by (by, bucket) as well, and nothing but a row per bucket moves."""
    by = list(by)
    src = df.where(F.col(value).isNotNull())
    if cuts is None and bucket is None:
        cuts = value_cuts(src, value)
    src = src.withColumn(value, F.col(value).cast("double") + F.lit(0.0))   # -0.0 joins 0.0
    if bucket:
        cuts = [0.0]
        table = src.groupBy(*by, F.col(bucket).alias("_bucket"), value).agg(*[c.alias(k) for k, c in sums.items()])
    else:
        table = add_bucket(src.groupBy(*by, value).agg(*[c.alias(k) for k, c in sums.items()]), value, cuts)
    names = list(sums)
    inner = Window.partitionBy(*by, "_bucket").orderBy(value)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    run = table.select("*", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"cum_{k}")
                              for k in names],
                       *([F.lead(value).over(inner).alias("next_value")] if lead else []))
    if not cuts:
        whole = Window.partitionBy(*by, "_bucket")
        return run.select("*", *[F.sum(k).over(whole).alias(f"tot_{k}") for k in names]) \
                  .drop("_bucket")
    part = Window.partitionBy(*(by or [F.lit(0)]))
    prior = part.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = table.groupBy(*by, "_bucket").agg(*[F.sum(k).alias(k) for k in names],
                                             F.min(value).alias("_first"))
    edge = edge.select(*by, "_bucket",
                       *[F.coalesce(F.sum(k).over(prior), F.lit(0)).alias(f"_off_{k}") for k in names],
                       *[F.sum(k).over(part).alias(f"tot_{k}") for k in names],
                       F.lead("_first").over(part.orderBy("_bucket")).alias("_next_first"))
    # strata may be null, so the offsets are matched null-safely
    e = edge.select(*[F.col(c).alias(f"_e_{c}") for c in by + ["_bucket"]],
                    *[c for c in edge.columns if c not in by + ["_bucket"]])
    cond = [run[c].eqNullSafe(e[f"_e_{c}"]) for c in by + ["_bucket"]]
    out = run.join(F.broadcast(e) if laid_out else e, cond)
    cols = [*by, value, *names, *[(F.col(f"cum_{k}") + F.col(f"_off_{k}")).alias(f"cum_{k}") for k in names],
            *[f"tot_{k}" for k in names]]
    if lead:
        cols.append(F.coalesce("next_value", "_next_first").alias("next_value"))
    return out.select(*cols)


def count_where(group: str, level) -> Column:
    return F.count(F.when(F.col(group).cast("string") == str(level), 1))


def mid_rank(n: str = "n") -> Column:
    return F.col(f"cum_{n}") + (F.col(n) + 1) / 2


def ranked(df: DataFrame, value: str, out: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """The input with the average rank of ``value``: distinct values are ranked, then joined back
    (AQE splits the join partition of a hot value)."""
    by = list(by)
    src = df.withColumn("_v", F.col(value).cast("double") + F.lit(0.0))
    ranks = cumulate(src, "_v", {"n": F.count(F.lit(1))}, by)
    ranks = ranks.select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col("_v").alias("_rv"),
                         mid_rank().alias(out), F.col("tot_n").alias(f"{out}_n"))
    cond = [src[c].eqNullSafe(ranks[f"_r_{c}"]) for c in by] + [src["_v"] == ranks["_rv"]]
    return src.join(ranks, cond, "left").drop("_v", "_rv", *[f"_r_{c}" for c in by])


def chunked_agg(df: DataFrame, exprs: dict[str, list[Column]], size: int = 4) -> dict:
    """One row of aggregates over many columns, a few columns per aggregation: each reads only its own
    columns, and the generated code stays small enough to be compiled."""
    out: dict = {}
    names = list(exprs)
    for i in range(0, len(names), size):
        out |= df.agg(*[e for n in names[i:i + size] for e in exprs[n]]).first().asDict()
    return out


SLACK = 5e-4        # half-width of a rank bracket, ten times the sketch error at accuracy 20000


def column_quantiles(df: DataFrame, cols: dict[str, Column], probs: Sequence[float]) -> dict[str, tuple[int, list[float | None]]]:
    """name -> (n, exact linear-interpolation quantiles) of several columns of one table.

    A sketch brackets each wanted rank, one more pass counts what lies below the brackets, and only
    values inside a bracket are shuffled and ordered.  Two numbers per quantile reach the driver."""
    names = list(cols)
    src = df.select(*[cols[v].cast("double").alias(f"v{i}") for i, v in enumerate(names)])
    ends = [x for p in probs for x in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
    grid = ",".join(f"{x!r}D" for x in ends)
    head = chunked_agg(src, {f"v{i}": [F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"),
                                       F.expr(f"percentile_approx(v{i}, array({grid}), 20000)").alias(f"q{i}")] for i in range(len(names))})
    spans = []
    for i in range(len(names)):
        n, q = head[f"n{i}"], head[f"q{i}"]
        for j in range(len(probs)):
            if n:
                spans.append((i, j, head[f"lo{i}"], head[f"hi{i}"]) if n < 10_000 else (i, j, q[2 * j], q[2 * j + 1]))
    if not spans:
        return {v: (0, [None] * len(probs)) for v in names}
    per_col: dict[str, list[Column]] = {}
    for i, j, lo, _ in spans:
        per_col.setdefault(f"v{i}", []).append(F.coalesce(F.sum((F.col(f"v{i}") < F.lit(lo)).cast("long")), F.lit(0)).alias(f"b{i}_{j}"))
    below = chunked_agg(src, per_col)

    def slot(i, lo, hi):                 # 64 equal parts of a bracket, monotone in the value
        return (F.floor((F.col(f"v{i}") - lo) / (hi - lo) * 64).cast("int") if hi > lo else F.lit(0)).alias("s")

    hit = F.array_compact(F.array(*[F.when(F.col(f"v{i}").between(lo, hi), F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}").alias("v"), slot(i, lo, hi))) for i, j, lo, hi in spans]))
    inside = src.select(F.explode(hit).alias("r")).select("r.*")
    small = sum(2 * SLACK * head[f"n{i}"] if head[f"n{i}"] >= 10_000 else head[f"n{i}"] for i, *_ in spans) <= rows_per_bucket(df)
    t = cumulate(inside, "v", {"m": F.count(F.lit(1))}, ["i", "j"], cuts=[] if small else None, bucket=None if small else "s")
    want = []
    for i, j, *_ in spans:
        h = (head[f"n{i}"] - 1) * float(probs[j])
        want.append((i, j, math.floor(h) - below[f"b{i}_{j}"], math.ceil(h) - below[f"b{i}_{j}"]))
    ranks = F.create_map(*[x for i, j, a, b in want for x in (F.lit(i * 10_000 + j), F.array(F.lit(a), F.lit(b)))])[F.col("i") * 10_000 + F.col("j")]
    on = lambda r: (F.col("cum_m") <= r) & (r < F.col("cum_m") + F.col("m"))
    got: dict[tuple, list] = {}
    for r in t.withColumn("_w", ranks).where(on(F.col("_w")[0]) | on(F.col("_w")[1])).select("i", "j", "v", on(F.col("_w")[0]).alias("a"), on(F.col("_w")[1]).alias("b")).collect():
        cell = got.setdefault((r["i"], r["j"]), [None, None])
        cell[0] = r["v"] if r["a"] else cell[0]
        cell[1] = r["v"] if r["b"] else cell[1]
    out: dict[str, tuple[int, list[float | None]]] = {}
    for i, v in enumerate(names):
        n, qs = head[f"n{i}"], []
        for j, p in enumerate(probs):
            if not n:
                qs.append(None)
                continue
            lo, hi = got.get((i, j), [None, None])
            if lo is None or hi is None:
                raise RuntimeError("quantile rank fell outside its bracket")
            h = (n - 1) * float(p)
            qs.append(lo + (h - math.floor(h)) * (hi - lo))
        out[v] = (n, qs)
    return out


def _quantiles_one_bucket(src: DataFrame, probs: Sequence[float], by: list[str]) -> DataFrame:
    """Quantiles read off the ordered distinct values of a table that fits one bucket."""
    t = cumulate(src, "_v", {"n": F.count(F.lit(1))}, by, cuts=[])
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("tot_n") - 1) * float(p)
        for tag, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("cum_n") <= r) & (r < F.col("cum_n") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{i}"))
    s = t.groupBy(*by).agg(F.max("tot_n").alias("n"), *picks)
    out = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * float(p)
        out.append((F.col(f"_lo{i}") + (h - F.floor(h)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}"))
    return s.select(*by, "n", *out)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
              total: int | None = None) -> DataFrame:
    """(by) -> n, q0, q1, ...: exact linear-interpolation quantiles.

    Beyond one bucket of rows (``total`` saves the count), a sketch brackets each wanted rank far wider than its error; only rows inside a bracket are
    shuffled and ordered, everything below is counted.  No task holds a whole column (the built-in
    exact percentile keeps every distinct value of a group in one buffer).  A rank outside its
    bracket raises instead of returning a neighbour."""
    by = list(by)
    v = F.col(value).cast("double")
    if not by:
        n, qs = column_quantiles(df, {"v": v}, probs)["v"]
        return df.sparkSession.createDataFrame([(n, *qs)], ", ".join(["n bigint", *[f"q{i} double" for i in range(len(probs))]]))
    src = df.select(*by, v.alias("_v")).where("_v is not null")
    if (src.count() if total is None else total) <= rows_per_bucket(df):
        return _quantiles_one_bucket(src, probs, by)
    slack = SLACK
    ends = [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    grid = ",".join(f"{x!r}D" for x in ends)
    head = src.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                F.expr(f"percentile_approx(_v, array({grid}), 20000)").alias("_q"))
    few = F.col("n") < 10_000
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
                               F.when(few, F.col("_lo")).otherwise(F.col("_q")[2 * i]).alias("lo"),
                               F.when(few, F.col("_hi")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"))
                      for i, p in enumerate(probs)])
    head = head.select(*by, F.struct("n", spans.alias("s")).alias("_b"))
    rows = beside(src, head, by).select(*by, "_v", "_b")
    n, sp = F.col("_b.n"), F.col("_b.s")
    below = rows.groupBy(*by).agg(F.first(n).alias("n"), F.first("_b").alias("_b"), *[
        F.sum((F.col("_v") < sp[i]["lo"]).cast("long")).alias(f"_k{i}") for i in range(len(probs))])
    inside = rows.select(*by, "_v", F.explode(F.filter(sp, lambda s: F.col("_v").between(s["lo"], s["hi"]))).alias("s"))
    width = F.col("s.hi") - F.col("s.lo")
    inside = inside.select(*by, "_v", F.col("s.i").alias("_i"),
                           F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("s.lo"), width) * 64), F.lit(0)).alias("_sub"))
    t = cumulate(inside, "_v", {"m": F.count(F.lit(1))}, [*by, "_i"], bucket="_sub")
    j = beside(t, below.select(*by, "n", F.array(*[f"_k{i}" for i in range(len(probs))]).alias("_below")), by)
    pos = F.col("_below")[F.col("_i")] + F.col("cum_m")
    p_of = F.array(*[F.lit(float(p)) for p in probs])[F.col("_i")]
    hh = (F.col("n") - 1) * p_of
    on = lambda r: (pos <= r) & (r < pos + F.col("m"))
    j = j.select(*by, "n", "_i", "_v", on(F.floor(hh)).alias("_a"), on(F.ceil(hh)).alias("_z"), hh.alias("_h"))
    picks = []
    for i in range(len(probs)):
        me = F.col("_i") == i
        lo, hi = F.max(F.when(me & F.col("_a"), F.col("_v"))), F.max(F.when(me & F.col("_z"), F.col("_v")))
        frac = F.max(F.when(me, F.col("_h") - F.floor("_h")))
        got = lo + frac * (hi - lo)
        picks.append(F.when(got.isNotNull(), got).otherwise(
            F.raise_error(F.lit("quantile rank fell outside its bracket")).cast("double")).alias(f"q{i}"))
    return j.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def running_extreme(table: DataFrame, value: str, col: str, how: str, by: Sequence[str] = (),
                    cuts: Sequence[float] = ()) -> DataFrame:
    """Adds ``run``: the largest ``col`` at or below each value (``prefix_max``) or the smallest at
    or above it (``suffix_min``), bucket by bucket with the buckets' own extremes as offsets."""
    by = list(by)
    t = add_bucket(table, value, list(cuts))
    prefix = how == "prefix_max"
    pick, join2 = (F.max, F.greatest) if prefix else (F.min, F.least)
    order = F.col(value).asc() if prefix else F.col(value).desc()
    inner = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_in", pick(col).over(inner))
    if not cuts:
        return t.withColumn("run", F.col("_in")).drop("_in", "_bucket")
    part = Window.partitionBy(*(by or [F.lit(0)]))
    b_order = F.col("_bucket").asc() if prefix else F.col("_bucket").desc()
    edge = t.groupBy(*by, "_bucket").agg(pick(col).alias("_x")).withColumn(
        "_off", pick("_x").over(part.orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)))
    e = edge.select(*[F.col(c).alias(f"_e_{c}") for c in by + ["_bucket"]], "_off")
    out = t.join(e, [t[c].eqNullSafe(e[f"_e_{c}"]) for c in by + ["_bucket"]])
    return out.withColumn("run", join2("_in", F.coalesce("_off", "_in"))).drop("_in", "_off", "_bucket", *[f"_e_{c}" for c in by + ["_bucket"]])
