"""Guardrails on the data behind a result: impossible values, group ratios, losses, imbalance.

Every check returns signal rows ``rule, check, column, level, hit, tier, numbers``; the pipeline
is their union in the order losses, ratios, balance, domain.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from statweave.functions import distributions as D
from statweave.operators.profile import kind_of
from statweave.plans.common import cut_lineage, num, ratio, sq, two_levels
from statweave.plans.cumulate import chunked_agg, column_quantiles
from statweave.plans.moments import pair_moments

c = F.col

#: fixed values: mathematical domain of a semantic type
DOMAIN = {"probability": (0.0, 1.0), "proportion": (0.0, 1.0), "percent": (0.0, 100.0), "count": (0.0, None)}
#: fixed values: base thresholds
LIMITS = {"tail_quantile": 0.999, "srm_p": 0.0005, "join_gate": 0.90, "join_warn": 0.98, "bias_p": 0.01, "bias_smd": 0.10,
          "loss_spread": 0.05, "small_n": 10, "tiny_n": 5, "coverage": 0.80, "smd": 0.10, "imbalance": 1.5}
TIERS = {"gate": 2, "diagnostic": 1}


def signals(df: DataFrame, rule: str, check: str, hit: Column, tier, numbers: dict[str, Column], column=None, level=None) -> DataFrame:
    txt = lambda v: (F.lit(v) if v is None or isinstance(v, str) else v).cast("string")
    return df.select(F.lit(rule).alias("rule"), F.lit(check).alias("check"), txt(column).alias("column"), txt(level).alias("level"),
                     F.coalesce(hit, F.lit(False)).alias("hit"), txt(tier).alias("tier"),
                     F.create_map(*[x for k, v in numbers.items() for x in (F.lit(k), v.cast("double"))]).alias("numbers"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ GR-01
def out_of_range(df: DataFrame, types: dict[str, str], tail: float = LIMITS["tail_quantile"]) -> DataFrame:
    """Impossible values (gate), boundary values and the far tail (diagnostic); columns are
    measured side by side."""
    cols = [v for v in types if types[v] in DOMAIN]
    q = column_quantiles(df, {v: num(v) for v in cols}, [0.5, tail])
    per: dict[str, list[Column]] = {}
    for i, v in enumerate(cols):
        (lo, hi), x = DOMAIN[types[v]], num(v)
        bad = (x < lo) if hi is None else (x < lo) | (x > hi)
        edge = x.isin(0.0, 1.0) if types[v] in ("probability", "proportion") else F.lit(False)
        cut = q[v][1][1]
        per[v] = [F.sum(bad.cast("long")).alias(f"bad{i}"), F.sum(edge.cast("long")).alias(f"edge{i}"), F.sum((x > F.lit(cut)).cast("long")).alias(f"tail{i}"),
                  F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.approx_count_distinct(x).alias(f"u{i}")]
    r = chunked_agg(df, per)
    s = df.sparkSession.createDataFrame(
        [(v, q[v][0], r[f"bad{i}"], r[f"edge{i}"], r[f"tail{i}"], q[v][1][1], q[v][1][0], r[f"lo{i}"], r[f"hi{i}"], r[f"u{i}"]) for i, v in enumerate(cols) if q[v][0]],
        "column string, n bigint, bad bigint, edge bigint, tail bigint, cut double, med double, min double, max double, u bigint")
    return _union([
        signals(s, "GR-01", "impossible", c("bad") > 0, "gate", {"n": c("bad"), "ratio": c("bad") / c("n"), "min": c("min"), "max": c("max")}, c("column")),
        signals(s, "GR-01", "boundary", c("edge") > 0, "diagnostic", {"n": c("edge"), "ratio": c("edge") / c("n")}, c("column")),
        signals(s, "GR-01", "tail", (c("n") >= 50) & (c("u") > 5) & (c("tail") > 0) & (c("cut") > c("med")), "diagnostic",
                {"n": c("tail"), "cut": c("cut"), "max": c("max")}, c("column"))])


def apply_action(df: DataFrame, column: str, semantic_type: str, action: str = "flag") -> DataFrame:
    """flag / keep change nothing; drop removes and clip moves values outside the domain."""
    if action not in ("flag", "keep", "drop", "clip"):
        raise ValueError(f"unknown action {action!r}")
    lo, hi = DOMAIN.get(semantic_type, (None, None))
    if action in ("flag", "keep") or (lo is None and hi is None):
        return df
    v = num(column)
    if action == "drop":
        bad = (v < lo) if hi is None else (v < lo) | (v > hi)
        return df.where(~F.coalesce(bad, F.lit(False)))
    low = F.greatest(v, F.lit(lo))
    return df.withColumn(column, F.when(v.isNotNull(), low if hi is None else F.least(low, F.lit(hi))))


# ------------------------------------------------------------------ GR-02
def _share(expected: dict[str, float] | None, g: Column, k: Column) -> Column:
    if not expected:
        return 1.0 / k
    total = sum(expected.values())
    return F.coalesce(F.create_map(*[x for a, b in expected.items() for x in (F.lit(a), F.lit(b / total))])[g], F.lit(0.0))


def _srm_stats(df: DataFrame, group: str, expected=None, by: Sequence[str] = ()) -> DataFrame:
    cells = df.where(c(group).isNotNull()).groupBy(*by, c(group).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("o"))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    cells = cells.select("*", F.sum("o").over(w).alias("n"), F.count("o").over(w).alias("k"))
    e = c("n") * _share(expected, c("g"), c("k"))
    s = cells.withColumn("e", e).groupBy(*by).agg(F.sum(ratio(sq(c("o") - c("e")), c("e"))).alias("chi2"), F.max("k").alias("k"), F.max("n").alias("n"))
    return s.withColumn("p", D.p_chi2(c("chi2"), c("k") - 1))


def srm(df: DataFrame, group: str, expected: dict[str, float] | None = None, p_threshold: float = LIMITS["srm_p"]) -> DataFrame:
    s = _srm_stats(df, group, expected)
    return signals(s, "GR-02", "srm", (c("k") >= 2) & (c("p") < p_threshold), "gate", {"chi2": c("chi2"), "p": c("p"), "n": c("n")}, group)


def srm_by_dimension(df: DataFrame, group: str, meta: Sequence[str], expected=None, p_threshold: float = LIMITS["srm_p"]) -> DataFrame:
    """Group ratio inside every level of every metadata column; the threshold is shared out over
    all levels looked at."""
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(m).alias("dim"), c(m).cast("string").alias("level")) for m in meta])).alias("r")) \
             .select(group, "r.*").where("level is not null")
    tests = long.select("dim", "level").distinct().count()
    adj = p_threshold / max(1, tests)
    s = _srm_stats(long, group, expected, ["dim", "level"]).where("k >= 2")
    return signals(s, "GR-02", "srm_dimension", c("p") < adj, "gate", {"chi2": c("chi2"), "p": c("p"), "n": c("n"), "threshold": F.lit(adj)}, c("dim"), c("level"))


def srm_counterfactual(kept: DataFrame, lost: DataFrame, group: str, expected=None, p_threshold: float = LIMITS["srm_p"]) -> DataFrame:
    """Would the ratio be as expected had nothing been lost?"""
    s = _srm_stats(kept.select(group).unionByName(lost.select(group)), group, expected)
    return signals(s, "GR-02", "counterfactual", c("p") < p_threshold, "diagnostic", {"p_restored": c("p"), "n": c("n")}, group)


# ------------------------------------------------------------------ GR-03
def retention_funnel(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Row counts per step and the share kept from the step before."""
    counts = _union([d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), F.lit(name).alias("step"), "n") for i, (name, d) in enumerate(steps)])
    w = Window.partitionBy(F.lit(0)).orderBy("i")
    s = counts.withColumn("before", F.lag("n").over(w)).where("before > 0")
    rate = c("n") / c("before")
    return signals(s, "GR-03", "retention", rate < 1, "diagnostic", {"n_before": c("before"), "n_after": c("n"), "rate": rate, "lost": c("before") - c("n")}, None, c("step"))


def flag_lost(before: DataFrame, kept: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``before`` with ``lost`` = no row with the same key in ``kept``."""
    k = kept.select(*[c(v).alias(f"_k_{v}") for v in key]).distinct().withColumn("_in", F.lit(True))
    j = before.join(k, [c(v).eqNullSafe(c(f"_k_{v}")) for v in key], "left")
    return j.withColumn("lost", c("_in").isNull()).drop("_in", *[f"_k_{v}" for v in key])


def loss_by_group(flagged: DataFrame, group: str) -> DataFrame:
    g = flagged.where(c(group).isNotNull()).groupBy(group).agg(F.avg(c("lost").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"),
                                                               F.sum(c("lost").cast("double")).alias("l"))
    s = g.agg(F.max("rate").alias("hi"), F.min("rate").alias("lo"), (F.sum("l") / F.sum("n")).alias("overall"))
    spread = c("hi") - c("lo")
    return signals(s, "GR-03", "loss_by_group", spread > LIMITS["loss_spread"], "diagnostic", {"overall": c("overall"), "spread": spread}, group)


def _smd(m: DataFrame) -> Column:
    sd = F.sqrt((c("v1") + c("v2")) / 2)
    return F.coalesce(ratio(F.abs(c("m1") - c("m2")), sd), F.lit(0.0))


def biased_loss(flagged: DataFrame, columns: Sequence[str], p_threshold: float = LIMITS["bias_p"]) -> DataFrame:
    """Is the loss tied to a column?  Welch with SMD for measurements, chi-square for categories."""
    from statweave.operators.table_tests import chi_square
    distinct = flagged.agg(*[F.approx_count_distinct(v).alias(v) for v in columns]).first().asDict()
    parts = []
    for v in columns:
        if distinct[v] < 2:
            continue
        if isinstance(flagged.schema[v].dataType, NumericType) and distinct[v] > 10:
            m = pair_moments(flagged, v, "lost", ["true", "false"])
            a, b = c("v1") / c("n1"), c("v2") / c("n2")
            m = m.select("*", ratio(c("m1") - c("m2"), F.sqrt(a + b)).alias("t"),
                         ratio(sq(a + b), sq(a) / (c("n1") - 1) + sq(b) / (c("n2") - 1)).alias("df"), _smd(m).alias("smd"))
            m = m.withColumn("p", D.p_t(c("t"), c("df")))
            parts.append(signals(m, "GR-03", "biased_loss", (c("p") < p_threshold) & (c("smd") >= LIMITS["bias_smd"]), "gate",
                                 {"smd": c("smd"), "t": c("t"), "p": c("p")}, v))
        else:
            x = chi_square(flagged, v, "lost")
            parts.append(signals(x, "GR-03", "biased_loss", c("p") < p_threshold, "gate", {"chi2": c("statistic"), "p": c("p")}, v))
    return _union(parts)


def join_rate(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Share of left rows with a match; the right side is reduced to distinct keys first."""
    s = flag_lost(left, right, key).agg(F.count(F.lit(1)).alias("n"), F.sum((~c("lost")).cast("long")).alias("m"))
    rate = F.coalesce(ratio(c("m"), c("n")), F.lit(1.0))
    tier = F.when(rate < LIMITS["join_gate"], "gate").otherwise("diagnostic")
    return signals(s, "GR-03", "join_rate", rate < LIMITS["join_warn"], tier, {"rate": rate, "n_left": c("n"), "n_matched": c("m")}, ",".join(key))


# ------------------------------------------------------------------ GR-04
def group_balance(df: DataFrame, group: str) -> DataFrame:
    s = df.where(c(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    nums = {"min_n": c("lo"), "max_n": c("hi"), "ratio": ratio(c("hi"), c("lo"))}
    return _union([
        signals(s, "GR-04", "tiny_group", c("lo") < LIMITS["tiny_n"], "gate", nums, group),
        signals(s, "GR-04", "small_group", (c("lo") >= LIMITS["tiny_n"]) & (c("lo") < LIMITS["small_n"]), "diagnostic", nums, group),
        signals(s, "GR-04", "imbalance", ratio(c("hi"), c("lo")) > LIMITS["imbalance"], "diagnostic", nums, group)])


def coverage(df: DataFrame, columns: Sequence[str], threshold: float = LIMITS["coverage"]) -> DataFrame:
    from statweave.operators.missing import is_missing
    row = df.agg(*[F.avg((~is_missing(df, v)).cast("double")).alias(f"c{i}") for i, v in enumerate(columns)])
    t = row.select(F.explode(F.array(*[F.struct(F.lit(v).alias("column"), c(f"c{i}").alias("cov")) for i, v in enumerate(columns)])).alias("r")).select("r.*")
    return signals(t, "GR-04", "coverage", c("cov") < threshold, "diagnostic", {"coverage": c("cov")}, c("column"))


def smd_imbalance(df: DataFrame, group: str, meta: Sequence[str], levels=None, threshold: float = LIMITS["smd"],
                  rule: str = "GR-04", check: str = "meta_imbalance") -> DataFrame:
    """Standardised difference of metadata between two groups beside its chance level.  Numeric
    columns share one keyed moment pass, categories one keyed count pass."""
    lv = two_levels(df, group, levels)
    g = c(group).cast("string")
    src = df.where(g.isin(lv))
    nums = [v for v in meta if v != group and kind_of(df, v) == "numeric"]
    cats = [v for v in meta if v != group and v not in nums]
    sizes = src.agg(F.sum((g == lv[0]).cast("long")).alias("na"), F.sum((g == lv[1]).cast("long")).alias("nb"))
    noise = sizes.select(F.struct("na", "nb", F.sqrt(1 / c("na") + 1 / c("nb")).alias("chance"))).scalar()
    parts = []
    if nums:
        long = src.select(g.alias("_g"), F.explode(F.array(*[F.struct(F.lit(v).alias("column"), num(v).alias("x")) for v in nums])).alias("r")).select("_g", "r.*")
        m = pair_moments(long, "x", "_g", lv, ["column"]).where("n1 >= 2 and n2 >= 2")
        parts.append(m.select("column", _smd(m).alias("smd")))
    if cats:
        long = src.select(g.alias("_g"), F.explode(F.array(*[F.struct(F.lit(v).alias("column"), c(v).cast("string").alias("x")) for v in cats])).alias("r")) \
                  .select("_g", "r.*").where("x is not null")
        t = long.groupBy("column", "x").agg(F.sum((c("_g") == lv[0]).cast("double")).alias("a"), F.sum((c("_g") == lv[1]).cast("double")).alias("b"))
        tot = t.groupBy("column").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
        p = t.join(tot, "column").select("column", (c("a") / c("ta")).alias("p1"), (c("b") / c("tb")).alias("p2"))
        mid = (c("p1") + c("p2")) / 2
        s = p.groupBy("column").agg(F.sum(F.abs(c("p1") - c("p2"))).alias("d"), F.sum(mid * (1 - mid)).alias("pool"))
        parts.append(s.select("column", F.coalesce(ratio(c("d"), F.sqrt("pool")), F.lit(0.0)).alias("smd")))
    s = _union(parts).withColumn("_n", noise)
    return signals(s, rule, check, c("smd") >= threshold, "diagnostic",
                   {"smd": c("smd"), "n_a": c("_n.na"), "n_b": c("_n.nb"), "chance_level": c("_n.chance")}, c("column"))


def metric_stability(df: DataFrame, group: str, value: str, key: Sequence[str], reps: int = 200, seed: int = 0) -> DataFrame:
    """Bootstrap width of the mean in groups below the small-group size (the only rows resampled)."""
    from statweave.plans.resample import bootstrap_sums, percentile_ci
    src = df.select(*key, c(group).cast("string").alias("_g"), num(value).alias("x")).dropna()
    m = src.groupBy("_g").agg(F.count("x").alias("n"), F.avg("x").alias("m")).where((c("n") >= 2) & (c("n") < LIMITS["small_n"]))
    b = bootstrap_sums(src.join(m.select("_g"), "_g", "left_semi"), key, ["x"], reps, ["_g"], seed).where("w > 0")
    ci = percentile_ci(b.withColumn("v", c("s_x") / c("w")), c("v"), ["_g"])
    s = m.join(ci, "_g")
    width = c("ci_high") - c("ci_low")
    return signals(s, "GR-04", "metric_stability", F.lit(True), "diagnostic",
                   {"n": c("n"), "ci_low": c("ci_low"), "ci_high": c("ci_high"), "width": width, "relative_width": ratio(width, F.abs("m"))}, value, c("_g"))


# ------------------------------------------------------------------ pipeline
def run_guard(df: DataFrame, types: dict[str, str], group: str | None = None, meta: Sequence[str] = (), metrics: Sequence[str] = (),
              before: DataFrame | None = None, key: Sequence[str] = (), steps: Sequence[tuple[str, DataFrame]] = (),
              expected: dict[str, float] | None = None, tier_cap: dict[str, str] | None = None) -> DataFrame:
    """All applicable guardrails.  A check never ranks above its rule's cap; what could not be
    looked at is reported as ``skipped`` rather than passed."""
    spark = df.sparkSession
    parts: list[DataFrame] = []
    skipped: list[tuple[str, str]] = []
    if steps:
        parts.append(retention_funnel(steps))
    flagged = flag_lost(before, df, key) if before is not None and key else None
    if flagged is not None:
        flagged = cut_lineage(flagged)                                # read by every check of GR-03
        parts.append(biased_loss(flagged, [*([group] if group else []), *meta]))
        if group:
            parts.append(loss_by_group(flagged, group))
            parts.append(srm_counterfactual(df, flagged.where("lost"), group, expected))
    else:
        skipped.append(("GR-03", "no table from before the loss"))
    if group:
        parts.append(srm(df, group, expected))
        if meta:
            parts.append(srm_by_dimension(df, group, meta, expected))
        parts.append(group_balance(df, group))
        levels = df.select(group).dropna().distinct().limit(3).count()
        if meta and levels == 2:
            parts.append(smd_imbalance(df, group, meta))
        if key:
            parts += [metric_stability(df, group, m, key) for m in metrics]
    else:
        skipped += [("GR-02", "no group column"), ("GR-04", "no group column")]
    if metrics or types:
        parts.append(coverage(df, list(metrics) or list(types)))
    known = {k: v for k, v in types.items() if v in DOMAIN}
    if known:
        parts.append(out_of_range(df, known))
    else:
        skipped.append(("GR-01", "no confirmed semantic types"))
    out = _union(parts).where("hit")
    if tier_cap:
        cap = F.create_map(*[x for k, v in tier_cap.items() for x in (F.lit(k), F.lit(v))])[c("rule")]
        out = out.withColumn("tier", F.when((cap == "diagnostic") & (c("tier") == "gate"), "diagnostic").otherwise(c("tier")))
    rows = [(r, "skipped", None, why, False, "skipped") for r, why in skipped]
    if rows:
        sk = spark.createDataFrame(rows, "rule string, check string, column string, level string, hit boolean, tier string") \
                  .withColumn("numbers", F.expr("cast(map() as map<string,double>)"))
        out = out.unionByName(sk)
    order = F.when(c("rule") == "GR-03", 0).when(c("rule") == "GR-02", 1).when(c("rule") == "GR-04", 2).otherwise(3)
    return out.orderBy(order, (c("tier") != "gate").cast("int"), "check", "column", "level")


def cause_of_ratio(guard: DataFrame) -> DataFrame:
    """Where a group-ratio alarm may come from: loss that differs by group and whose undoing
    restores the ratio, or unexplained."""
    has = lambda chk: F.coalesce(F.max((c("check") == chk) & c("hit")), F.lit(False))
    s = guard.agg(has("srm").alias("srm"), has("loss_by_group").alias("loss"), has("counterfactual").alias("still"))
    return s.select("srm", F.when(~c("srm"), None).when(c("loss") & ~c("still"), "loss").otherwise("unexplained").alias("candidate"))
