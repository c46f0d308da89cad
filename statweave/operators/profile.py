"""Column profiles, distributions, semantic types, compositions and group structure.

All columns of a table are measured in a fixed number of passes: one wide aggregation, then one
unpivoted aggregation keyed by column name.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, FractionalType, NumericType, StringType, TimestampNTZType, TimestampType

from statweave.operators.missing import is_missing
from statweave.plans.common import num, ratio
from statweave.plans.cumulate import chunked_agg, column_quantiles
from statweave.plans.gram import gram, unpack

c = F.col
MAX_LEVELS = 12


def kind_of(df: DataFrame, col: str) -> str:
    t = df.schema[col].dataType
    if isinstance(t, (NumericType, BooleanType)):
        return "numeric"
    return "datetime" if isinstance(t, (TimestampType, TimestampNTZType, DateType)) else "categorical"


def _long(df: DataFrame, cols: Sequence[str], value: Column | None = None, cast: str = "string") -> DataFrame:
    """(column, value) rows of the named columns, nulls dropped."""
    parts = [F.struct(F.lit(v).alias("column"), (num(v) if cast == "double" else F.when(~is_missing(df, v), c(v)).cast(cast)).alias("value"))
             for v in cols]
    return df.select(F.explode(F.array(*parts)).alias("r")).select("r.*").where("value is not null")


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct values per column: (column, value) pairs collapse map-side first."""
    return _long(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(
        F.count("n").alias("n_unique"), F.sum("n").alias("n"), F.max("n").alias("largest"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column, dtype, missing_rate, n_unique, estimated (sketch instead of a distinct shuffle)."""
    cols = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, v in enumerate(cols):
        aggs.append(F.sum(is_missing(df, v).cast("long")).alias(f"m{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(v).alias(f"u{i}"))
    row = df.agg(*aggs)
    kinds = dict(df.dtypes)
    parts = [F.struct(F.lit(i).alias("position"), F.lit(v).alias("column"), F.lit(kinds[v]).alias("dtype"),
                      ratio(c(f"m{i}"), c("_n")).alias("missing_rate"),
                      (F.lit(None).cast("long") if exact else c(f"u{i}")).alias("n_unique")) for i, v in enumerate(cols)]
    t = row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    if exact:
        t = t.drop("n_unique").join(distinct_counts(df, cols).select("column", "n_unique"), "column", "left")
    return t.select("column", "dtype", "missing_rate", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"),
                    F.lit(not exact).alias("estimated"))


def compose(df: DataFrame, selected: Sequence[str] | None = None, held: Sequence[str] = ()) -> DataFrame:
    sel = list(selected or df.columns)
    use = [v for v in sel if v not in set(held)]
    kinds = [kind_of(df, v) for v in use]
    gap = F.lit(False)
    for v in use:
        gap = gap | is_missing(df, v)
    s = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum((~gap).cast("long")).alias("complete_rows"))
    return s.select("n_rows", F.lit(len(sel)).alias("n_selected"), F.lit(len(use)).alias("n_analysis"), F.lit(len(sel) - len(use)).alias("n_held"),
                    *[F.lit(kinds.count(k)).alias(f"n_{k}") for k in ("numeric", "categorical", "datetime")],
                    "complete_rows", (c("n_rows") - c("complete_rows")).alias("any_missing"))


# ------------------------------------------------------------------ distributions
def adjusted_skew(n: Column, g1: Column) -> Column:
    """Sample-size adjusted skewness from the population one."""
    return F.when(n > 2, g1 * F.sqrt(n.cast("double") * (n - 1)) / (n - 2)).otherwise(0.0)


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: moments, quartiles, fences, outlier shares by IQR and by (unscaled) MAD.  Columns
    stay side by side through every pass; only their summaries reach the driver."""
    cols = list(columns)
    x = {v: num(v) for v in cols}
    m = chunked_agg(df, {v: [F.count(x[v]).alias(f"n{i}"), F.avg(x[v]).alias(f"mean{i}"), F.stddev_samp(x[v]).alias(f"sd{i}"), F.skewness(x[v]).alias(f"g{i}"),
                             F.avg((x[v] == 0).cast("double")).alias(f"z{i}"), F.min(x[v]).alias(f"lo{i}"), F.max(x[v]).alias(f"hi{i}")] for i, v in enumerate(cols)})
    q = column_quantiles(df, x, [0.25, 0.5, 0.75])
    full = [v for v in cols if q[v][0]]
    mad = column_quantiles(df, {v: F.abs(x[v] - q[v][1][1]) for v in full}, [0.5]) if full else {}
    out: dict = {}
    if full:
        def shares(i, v):
            q1, med, q3 = q[v][1]
            iqr, d = q3 - q1, mad[v][1][0]
            far = (x[v] < q1 - 1.5 * iqr) | (x[v] > q3 + 1.5 * iqr) if iqr > 0 else F.lit(False)
            off = F.abs(x[v] - med) > 3 * d if d > 0 else F.lit(False)
            known = x[v].isNotNull()
            return [F.avg(F.when(known, far.cast("double"))).alias(f"oi{i}"), F.avg(F.when(known, off.cast("double"))).alias(f"om{i}")]
        out = chunked_agg(df, {v: shares(i, v) for i, v in enumerate(cols) if v in full})
    rows = []
    for i, v in enumerate(cols):
        n = m[f"n{i}"]
        if not n:
            rows.append((v, 0, *[None] * 14, None))
            continue
        q1, med, q3 = q[v][1]
        iqr, g = q3 - q1, m[f"g{i}"]
        skew = g * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 and g is not None and g == g else 0.0
        rows.append((v, n, m[f"mean{i}"], m[f"sd{i}"] or 0.0, skew, m[f"lo{i}"], q1, med, q3, m[f"hi{i}"], iqr, q1 - 1.5 * iqr, q3 + 1.5 * iqr,
                     out[f"oi{i}"], out[f"om{i}"], m[f"z{i}"], m[f"lo{i}"] < 0))
    return df.sparkSession.createDataFrame(rows, "column string, n bigint, mean double, sd double, skewness double, min double, q1 double, median double, q3 double, "
                                           "max double, iqr double, fence_lo double, fence_hi double, outlier_rate_iqr double, outlier_rate_mad double, zeros_rate double, negative boolean")


def bin_count(n: int, most: int = 20) -> int:
    return min(most, max(5, int(n ** 0.5)))


def histogram(df: DataFrame, columns: Sequence[str], most: int = 20, ranges: dict[str, tuple[int, float, float]] | None = None) -> DataFrame:
    """Equal-width bins per column (between 5 and ``most``, about sqrt n), last bin closed.  With the
    ranges known as numbers, all columns share one pass that emits (column, bin) counts."""
    cols = list(columns)
    if ranges is None:
        r = chunked_agg(df, {v: [F.count(num(v)).alias(f"n{i}"), F.min(num(v)).alias(f"a{i}"), F.max(num(v)).alias(f"b{i}")] for i, v in enumerate(cols)})
        ranges = {v: (r[f"n{i}"], r[f"a{i}"], r[f"b{i}"]) for i, v in enumerate(cols)}
    edges = {}
    for v in cols:
        n, a, b = ranges[v]
        if n:
            edges[v] = (bin_count(n, most), a, b) if b > a else (bin_count(n, most), a - 0.5, b + 0.5)   # a constant gets a unit-wide range
    spark = df.sparkSession
    if not edges:
        return spark.createDataFrame([], "column string, bin int, left double, right double, count bigint")
    cells = [F.struct(F.lit(v).alias("column"), F.least(F.lit(k - 1), F.floor((num(v) - a) / (b - a) * k).cast("int")).alias("bin"))
             for v, (k, a, b) in edges.items()]
    counts = df.select(F.explode(F.array(*cells)).alias("r")).groupBy("r.column", "r.bin").agg(F.count(F.lit(1)).alias("count")).where("bin is not null")
    grid = spark.createDataFrame([(v, i, a + i * (b - a) / k, a + (i + 1) * (b - a) / k) for v, (k, a, b) in edges.items() for i in range(k)],
                                 "column string, bin int, left double, right double")
    return grid.join(counts, ["column", "bin"], "left").select("column", "bin", "left", "right", F.coalesce("count", F.lit(0)).alias("count"))


def category_summary(df: DataFrame, columns: Sequence[str], top: int = MAX_LEVELS) -> DataFrame:
    """Most frequent levels per column, the tail folded into one row (value null)."""
    t = _long(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    total = t.groupBy("column").agg(F.sum("n").alias("total"), F.count("n").alias("n_levels"))
    w = Window.partitionBy("column").orderBy(c("n").desc(), "value")
    # only a level that can still make the top needs ranking: pre-trim inside hash shards
    shard = Window.partitionBy("column", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(c("n").desc(), "value")
    head = t.withColumn("_s", F.row_number().over(shard)).where(c("_s") <= top).withColumn("rank", F.row_number().over(w)).where(c("rank") <= top)
    rest = total.join(head.groupBy("column").agg(F.sum("n").alias("h"), F.count("n").alias("k")), "column").where("n_levels > k").select(
        "column", F.lit(None).cast("string").alias("value"), (c("total") - c("h")).alias("n"), F.lit(top + 1).alias("rank"))
    both = head.select("column", "value", "n", "rank").unionByName(rest)
    return both.join(total, "column").select("column", "rank", "value", "n", ratio(c("n"), c("total")).alias("ratio"), "n_levels")


# ------------------------------------------------------------------ shape
#: fixed values: limits of the shape verdicts (variation of bin heights, share of an end bin, height of a peak against the highest bin, skewness)
FLAT, END, PEAK, SKEWED, LEAST_ROWS = 0.35, 0.15, 0.4, 1.0, 10
#: shape verdicts, the first whose condition holds over (n, skew, spread, first, last, peaks)
SHAPES = (("too_few", f"n < {LEAST_ROWS} OR n IS NULL"), ("flat", f"spread IS NULL OR spread < {FLAT}"), ("bimodal_ends", f"first > {END} AND last > {END}"),
          ("bimodal", "peaks >= 2"), ("skewed", f"abs(skew) >= {SKEWED}"), ("unimodal", "true"))


def shapes(bins: DataFrame, facts: DataFrame) -> DataFrame:
    """column, shape of every row of facts (column, n, skew) from histogram rows (column, bin, count)."""
    side = Window.partitionBy("column").orderBy("bin")
    whole = Window.partitionBy("column")
    b = bins.withColumns({"before": F.lag("count").over(side), "after": F.lead("count").over(side), "top": F.max("count").over(whole)})
    peak = (c("count") > c("before")) & (c("count") > c("after")) & (c("count") > PEAK * c("top"))
    total = F.sum("count")
    seen = b.groupBy("column").agg(ratio(F.stddev_pop("count"), F.avg("count")).alias("spread"), ratio(F.min_by("count", "bin"), total).alias("first"),
                                   ratio(F.max_by("count", "bin"), total).alias("last"), F.count_if(peak).alias("peaks"))
    return facts.select("column", "n", "skew").join(seen, "column", "left").select("column", _first_that_holds(SHAPES).alias("shape"))


def _first_that_holds(rules) -> Column:
    return F.coalesce(*[F.when(F.expr(condition), F.lit(name)) for name, condition in rules])


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, dict]:
    """Everything the type and shape rules need, one dict per column (columns, not rows, reach the
    driver)."""
    cols = list(columns or df.columns)
    kinds = {v: kind_of(df, v) for v in cols}
    nums = [v for v in cols if kinds[v] == "numeric"]
    per: dict[str, list[Column]] = {"": [F.count(F.lit(1)).alias("_rows")]}
    for i, v in enumerate(cols):
        if v in nums:
            x = num(v)
            per[v] = [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"sd{i}"),
                      F.skewness(x).alias(f"g{i}"), F.sum((x == 0).cast("long")).alias(f"zero{i}"), F.coalesce(F.min((x == F.floor(x)).cast("int")), F.lit(1)).alias(f"int{i}"),
                      F.hll_sketch_estimate(F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), F.lit(14))).alias(f"u{i}")]
        else:
            txt = c(v).cast("string")
            # a cheap look first: failed timestamp parses are slow
            date = F.when(txt.rlike(r"^\d{1,4}[-/.]?\d{1,2}[-/.]?\d{1,4}"), F.coalesce(*[F.try_to_timestamp(txt, F.lit(f)) for f in DATE_FORMATS]))
            per[v] = [F.count(txt).alias(f"n{i}"), F.count(date if kinds[v] == "categorical" else txt).alias(f"date{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(txt, F.lit(14))).alias(f"u{i}")]
    row = chunked_agg(df, per)
    # the sketch settles large counts; where a rule turns on the exact number it is counted
    exact = [v for i, v in enumerate(cols) if row[f"n{i}"] and (row[f"u{i}"] <= 1000 or 0.87 <= row[f"u{i}"] / row[f"n{i}"] <= 0.93)]
    uniq = {r["column"]: r["n_unique"] for r in distinct_counts(df, exact).collect()} if exact else {}
    facts: dict[str, dict] = {}
    for i, v in enumerate(cols):
        f = {"kind": kinds[v], "rows": row["_rows"], "n": row[f"n{i}"], "distinct": uniq.get(v, row[f"u{i}"])}
        if v in nums:
            f |= {"min": row[f"lo{i}"], "max": row[f"hi{i}"], "mean": row[f"mean{i}"], "sd": row[f"sd{i}"], "integer": bool(row[f"int{i}"]),
                  "g1": row[f"g{i}"], "zeros": row[f"zero{i}"]}
            n, g1 = f["n"], f["g1"]
            f["skew"] = g1 * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 and g1 is not None and g1 == g1 else 0.0
        else:
            f["date_share"] = row[f"date{i}"] / f["n"] if f["n"] else 0.0
        facts[v] = f
    few = [v for v in nums if facts[v]["integer"] and 0 < facts[v]["distinct"] <= 20]      # a bar per value
    rest = [v for v in nums if v not in few and facts[v]["n"] >= LEAST_ROWS]
    bins = histogram(df, rest, ranges={v: (facts[v]["n"], facts[v]["min"], facts[v]["max"]) for v in rest}).select("column", c("bin").cast("double").alias("bin"), "count")
    if few:
        bins = bins.unionByName(_long(df, few, cast="double").groupBy("column", c("value").alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    known = df.sparkSession.createDataFrame([(v, facts[v]["n"], float(facts[v]["skew"])) for v in nums], "column string, n bigint, skew double")
    found = {r["column"]: r["shape"] for r in shapes(bins, known).collect()} if nums else {}
    for v in cols:
        facts[v]["shape"] = found.get(v, "categorical")
    return facts


# ------------------------------------------------------------------ semantic types
#: fixed values: date layouts tried on text columns
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")
#: fixed values: type pairs whose confusion costs an analysis
COSTLY = ({"probability", "proportion"}, {"proportion", "normalized score"}, {"count", "proportion"}, {"log-scale", "continuous"},
          {"ordinal code", "nominal code"})
#: fixed values: weak hints in column names
NAME_HINTS = ((r"\b(prob|p_|pred|score)\b|prob", "probability"), (r"(frac|ratio|prop|pct_)", "proportion"), (r"(count|_n$|^n_|num)", "count"),
              (r"(log2?|ln_|_log)", "log-scale"), (r"(id$|_id$|^id)", "id"), (r"(zscore|_z$)", "z-score"))
LABEL_HINT = r"label|group|arm|class|cohort|dx|diagnos|status|grade"


_TEXT, _NUMBER = "kind <> 'numeric'", "kind = 'numeric' AND n > 0"
_UNIT, _REAL, _WHOLE = f"{_NUMBER} AND min >= 0 AND max <= 1", f"{_NUMBER} AND NOT integer", f"{_NUMBER} AND integer"
#: fixed values: what speaks for a type: condition over a column's facts, type, points, evidence
SIGNALS = (
    (f"{_TEXT} AND uniq > 0.9", "id", 3.0, "almost every value is unique"), (f"{_WHOLE} AND uniq > 0.9", "id", 1.5, "almost every value is unique"),
    (f"{_TEXT} AND uniq <= 0.9", "nominal code", 3.0, "few levels"), (f"{_UNIT} AND integer AND distinct <= 2", "nominal code", 2.5, "only 0 and 1"),
    (f"{_WHOLE} AND min >= 0 AND max > 1 AND distinct <= 10", "nominal code", 1.5, "few integer levels"),
    (f"{_TEXT} AND uniq <= 0.9 AND labelled", "label", 3.5, "name suggests a label"), (f"{_TEXT} AND uniq <= 0.9 AND NOT labelled AND distinct <= 6", "label", 2.0, "six levels or fewer"),
    (f"{_TEXT} AND uniq <= 0.9 AND distinct <= 10", "ordinal code", 1.0, "few levels could be ordered"),
    (f"{_WHOLE} AND min >= 0 AND max > 1 AND distinct <= 10", "ordinal code", 2.0, "few integer levels"),
    (f"{_TEXT} AND n > 0 AND date_share = 1", "datetime", 2.0, "parses as a date"),
    (f"{_UNIT} AND composed", "proportion", 4.0, "rows sum to one with its siblings"), (f"{_UNIT} AND NOT integer", "proportion", 1.5, "lies in 0..1"),
    (f"{_UNIT} AND NOT integer", "probability", 2.0, "lies in 0..1"),
    (f"{_UNIT} AND NOT integer AND shape IN ('bimodal', 'bimodal_ends')", "probability", 1.5, "mass at both ends"),
    (f"{_UNIT} AND NOT integer AND min = 0 AND max = 1", "normalized score", 3.0, "range is exactly 0 to 1"),
    (f"{_UNIT} AND integer AND distinct <= 2", "count", 1.0, "non-negative integers"), (f"{_WHOLE} AND min >= 0 AND max > 1", "count", 3.0, "non-negative integers"),
    (f"{_REAL} AND min >= 0 AND max > 1 AND max <= 100", "percent", 2.0, "lies in 0..100"),
    (f"{_NUMBER} AND min < 0", "continuous", 2.0, "has negative values"), (f"{_REAL} AND max > 1", "continuous", 1.5, "real values above one"),
    ("kind = 'numeric' AND n = 0", "continuous", 1.0, "no values"),
    (f"{_NUMBER} AND min < 0", "expression index", 1.5, "negative values of a log ratio"), (f"{_REAL} AND max > 1", "expression index", 1.0, "relative to a reference of one"),
    (f"{_NUMBER} AND min < 0 AND abs(mean) < 0.3 AND sd > 0.7 AND sd < 1.4", "z-score", 3.0, "mean near 0 and sd near 1"))
#: fixed values: what leaves a choice open: condition, remark
OPEN_CHOICES = ((f"{_TEXT} AND uniq <= 0.9 AND distinct <= 10", "nominal or ordinal"), (f"{_WHOLE} AND min >= 0 AND max > 1 AND distinct <= 10", "nominal or ordinal"),
                (f"{_UNIT} AND integer AND distinct <= 2", "binary code or count"), (f"{_NUMBER} AND min < 0", "negative values rule out several scales"))


def facts_table(df: DataFrame, facts: dict[str, dict], composed: Sequence[str] = ()) -> DataFrame:
    """One row of facts per column, as the rules read them."""
    get = lambda f, k: None if f.get(k) is None else float(f[k])
    rows = [(v, f["kind"], f["n"], f["distinct"], f["distinct"] / max(1, f["n"]), get(f, "min"), get(f, "max"), get(f, "mean"), get(f, "sd"), f.get("integer"), get(f, "date_share"), f["shape"],
             v in composed, bool(re.search(LABEL_HINT, v, re.I))) for v, f in facts.items()]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, n bigint, distinct bigint, uniq double, min double, max double, mean double, sd double, integer boolean, "
                                                 "date_share double, shape string, composed boolean, labelled boolean")


def score_types(facts: DataFrame) -> DataFrame:
    """column, type, points, evidence: the signals that hold for each row of facts, added up; a numeric column without any is continuous; names add a weak hint to numbers."""
    row = lambda type_, points, reason: F.struct(F.lit(type_).alias("type"), F.lit(points).alias("points"), F.lit(reason).alias("reason"))
    held = F.filter(F.array(*[F.when(F.expr(cond), row(t, p, why)) for cond, t, p, why in SIGNALS]), lambda x: x.isNotNull())
    held = F.when(F.size(held) > 0, held).when(F.expr("kind = 'numeric'"), F.array(row("continuous", 1.0, "no stronger signal"))).otherwise(held)
    hints = F.filter(F.array(*[F.when(F.expr(_NUMBER) & F.lower("column").rlike(pattern), row(t, 0.5, "name hint")) for pattern, t in NAME_HINTS]), lambda x: x.isNotNull())
    one = facts.select("column", F.posexplode(F.concat(held, hints)).alias("i", "s"))
    return one.groupBy("column", "s.type").agg(F.sum("s.points").alias("points"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s.reason"))), lambda x: x["reason"]).alias("evidence"))


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, type, rank, evidence, shape, conflicts, needs_confirm: one row per candidate type, ranked with ties sharing a place."""
    facts = column_facts(df)
    cols = list(columns or df.columns)
    groups = compositions(df, facts)
    outside = [v for v in cols if any(v in g and not g <= set(cols) for g in groups)]
    table = facts_table(df, {v: facts[v] for v in cols}, [v for g in groups for v in g])
    remarks = [F.when(F.expr(cond), F.lit(what)) for cond, what in OPEN_CHOICES]
    remarks.append(F.when(c("column").isin(*outside) if outside else F.lit(False), F.lit("part of a composition whose other members are not selected")))
    open_ = table.select("column", "shape", F.filter(F.array(*remarks), lambda x: x.isNotNull()).alias("conflicts"))
    ranked = score_types(table).withColumn("rank", F.rank().over(Window.partitionBy("column").orderBy(F.round("points", 6).desc())))
    second = F.min(F.when(c("rank") > 1, c("rank")))
    places = ranked.groupBy("column").agg(second.alias("second"))
    tops = ranked.join(places, "column").groupBy("column").agg(F.collect_set(F.when(c("rank") == 1, c("type"))).alias("top"), F.collect_set(F.when(c("rank") == c("second"), c("type"))).alias("next"))
    costly = F.lit(False)
    for a, b in (sorted(x) for x in COSTLY):
        costly = costly | (F.array_contains("top", a) & F.array_contains("next", b)) | (F.array_contains("top", b) & F.array_contains("next", a))
        costly = costly | (F.array_contains("top", a) & F.array_contains("top", b))
    return ranked.join(open_, "column").join(tops, "column").select(
        "column", "type", "rank", "evidence", "shape", "conflicts", ((F.size("conflicts") > 0) | (F.size("top") > 1) | costly).alias("needs_confirm"))


# ------------------------------------------------------------------ compositions
def _sum_facts(df: DataFrame, members: Sequence[str]) -> bool:
    """Do the members' rows sum to 1 (within .01) or 100 (within 1) on more than 90 % of complete rows?"""
    if len(members) < 2:
        return False
    total = sum((num(m) for m in members), F.lit(0.0))
    r = df.select(total.alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("k"),
                                        F.avg((F.abs(c("t") - 1) <= 0.01 + 1e-5).cast("double")).alias("one"),
                                        F.avg((F.abs(c("t") - 100) <= 1 + 1e-3).cast("double")).alias("hundred")).first()
    return r["k"] >= max(10, 0.05 * r["n"]) and max(r["one"] or 0, r["hundred"] or 0) > 0.9


#: fixed value: variance below which a direction counts as still (a sum within .01 of one)
STILL = 5e-5


def compositions(df: DataFrame, facts: dict[str, dict] | None = None) -> list[set[str]]:
    """Disjoint sets of numeric columns within 0..1 whose rows close to one.

    One cross-product table serves all columns: rows that close are directions without variance, and in the reduced echelon form of these directions each set
    is a row of ones. What closes is confirmed on the rows."""
    facts = facts or column_facts(df)
    pool = [v for v in df.columns if facts.get(v, {}).get("kind") == "numeric" and facts[v]["n"] and facts[v]["min"] >= -0.01 and facts[v]["max"] <= 1.01]
    fixed = sorted((v for v in pool if facts[v]["max"] == facts[v]["min"]), key=lambda v: (-facts[v]["max"], v))
    pool = [v for v in pool if v not in fixed]
    if len(pool) < 2:
        return []
    row = gram(df.select(*[num(v).alias(f"x{i}") for i, v in enumerate(pool)]), [f"x{i}" for i in range(len(pool))]).first()
    n, _, cross = unpack(row, len(pool))
    if not n:
        return []
    size, direction = np.linalg.eigh(np.nan_to_num(cross / n))
    null = direction[:, size < STILL].T
    done = 0
    for j in range(len(pool)):                                    # reduced echelon form
        if done == len(null):
            break
        k = done + int(np.argmax(np.abs(null[done:, j])))
        if abs(null[k, j]) < 1e-3:
            continue
        null[[done, k]] = null[[k, done]]
        null[done] /= null[done, j]
        for i in range(len(null)):
            if i != done:
                null[i] -= null[i, j] * null[done]
        done += 1
    sets = [{pool[j] for j in np.flatnonzero(np.abs(v - 1) < 0.1)} for v in null[:done] if (np.minimum(np.abs(v), np.abs(v - 1)) < 0.1).all()]
    for g in sets:                                                # constant columns fill what a still sum leaves open
        for v in fixed:
            if 0 < facts[v]["max"] <= 1.01 - sum(facts[m]["mean"] for m in g):
                g.add(v)
    return [g for g in sets if len(g) > 1 and _sum_facts(df, sorted(g))]


def composition_set(df: DataFrame, name: str, facts: dict[str, dict] | None = None) -> set[str]:
    """Numeric columns that close to a constant (1 or 100) together with ``name``: those of its name's family if they do, else what `compositions` finds."""
    facts = facts or column_facts(df)
    stem = re.match(r"[^\d]*[^\d_\-]", name)
    family = [v for v in df.columns if stem and len(stem[0]) >= 2 and v.startswith(stem[0].rsplit("_", 1)[0])]
    if name in family and all(facts.get(v, {}).get("kind") == "numeric" for v in family) and _sum_facts(df, family):
        return set(family)
    return next((g for g in compositions(df, facts) if name in g), set())


def count_set(df: DataFrame, name: str) -> list[str]:
    """Columns whose counts make up a sample together with ``name``: whole numbers from 0 on, with a row total that varies (a constant one is a closed composition, not counts).

    They are the columns that share a word of their names with ``name``, the word that most of them share; without such a word, all count columns. Two aggregations over the table."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    whole = df.agg(*[F.coalesce(F.bool_and((num(v) >= 0) & (num(v) == F.floor(num(v)))), F.lit(False)).alias(v) for v in numbers]).first().asDict() if numbers else {}
    counts = [v for v in numbers if whole[v]]
    words = {v: re.findall(r"[^\W\d_]{2,}", v.lower()) for v in counts}
    held = {w: [v for v in counts if w in words[v]] for w in words.get(name, ())}
    members = max(held.values(), key=len, default=[])
    members = members if len(members) > 1 else counts
    if name not in counts or len(members) < 2:
        raise ValueError(f"{name!r} does not belong to a set of count columns")
    total = sum((F.coalesce(num(v), F.lit(0.0)) for v in members), F.lit(0.0))
    if df.agg((F.min(total) == F.max(total)).alias("closed")).first()["closed"]:
        raise ValueError(f"the columns with {name!r} have one total in all rows: a composition, not counts")
    return sorted(members)


# ------------------------------------------------------------------ group structure
#: fixed values: name patterns of structural columns
STRUCTURE_HINTS = (("subject", r"\b(patient|subject|animal|donor)\b|(^|_)(pid|sid|sample|case)(_?id)?$"),
                   ("batch", r"\b(batch|plate|run|lane|chip|slide|flowcell)\b"),
                   ("site", r"\b(site|center|centre|hospital|institution|clinic|lab)\b"),
                   ("time", r"\b(visit|timepoint|week|day|cycle|session)\b|(^|_)time(point)?$"))


def group_structure(df: DataFrame, columns: Sequence[str] | None = None, min_repeat: float = 2.0) -> DataFrame:
    """Identifier and repeated-structure candidates of all columns in one keyed count."""
    cols = list(columns or df.columns)
    floats = [v for v in cols if isinstance(df.schema[v].dataType, FractionalType)]
    if floats:
        r = df.agg(*[F.max((num(v) != F.floor(num(v))).cast("int")).alias(v) for v in floats]).first()
        cols = [v for v in cols if v not in floats or not r[v]]
    cols = [v for v in cols if isinstance(df.schema[v].dataType, (NumericType, StringType, BooleanType, TimestampType, TimestampNTZType, DateType))]
    t = distinct_counts(df, cols)
    uniq, mean = ratio(c("n_unique"), c("n")), ratio(c("n"), c("n_unique"))
    is_id = uniq >= 0.9
    low = F.lower("column")
    hint = F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in STRUCTURE_HINTS])
    t = t.where(is_id | ((mean >= min_repeat) & (uniq <= 0.5)))
    return t.select("column", c("n_unique").alias("n_levels"), uniq.alias("unique_ratio"), mean.alias("mean_per_group"),
                    c("largest").alias("max_per_group"), (is_id | (ratio(c("sd"), mean) < 0.5)).alias("balanced"),
                    F.coalesce(hint, F.lit("unknown")).alias("kind"), is_id.alias("is_identifier"), hint.isNotNull().alias("name_hint"))


def repeat_candidates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Identifier-like columns whose values repeat (possible subjects)."""
    t = distinct_counts(df, columns)
    return t.where("n_unique < n").select("column", "n", "n_unique", (c("n") - c("n_unique")).alias("repeats"))
