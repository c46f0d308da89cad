"""Time-to-event tests over event-time tables (``cumulate`` along time)."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from statweave.functions import distributions as D
from statweave.operators.regression import _fit_rows, _paste
from statweave.plans.common import beside, cut_lineage, levels_of, num, ratio, result, sq
from statweave.plans.cumulate import add_bucket, cumulate, value_cuts
from statweave.plans.dominance import FEW, pair_sums
from statweave.plans.gram import design, per_row
from statweave.plans.newton import Fit, newton, with_theta

c = F.col


def survival_rows(df: DataFrame, time: str, group: str | None, event: str | None, by: Sequence[str] = ()) -> DataFrame:
    """time > 0, status 0/1 (all events when no event column), group as text."""
    if event is None:
        status = F.lit(1.0)
    elif df.schema[event].dataType.simpleString() == "string":
        first = levels_of(df, event, 2)[0]
        status = F.when(c(event).isNotNull(), (c(event) != first).cast("double"))
    else:
        status = (num(event) > 0).cast("double")
    cols = [num(time).alias("t"), status.alias("d")]
    if group:
        cols.append(c(group).cast("string").alias("g"))
    out = df.select(*by, *cols).dropna()
    return out.where("t > 0")


def by_time(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, n, d): subjects and events per time, written once: every later pass reads these few rows instead of making the subjects anew."""
    return cut_lineage(rows.groupBy(*keys, "t").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("d").alias("d")))


def risk_table(rows: DataFrame, levels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per time: events d, at-risk n, and both per group (d0.., n0..). ``rows`` come from ``by_time`` with the group among its keys."""
    sums = {"n": F.sum("n"), "d": F.sum("d")}
    for i, lv in enumerate(levels):
        g = c("g") == lv
        sums[f"n{i}"] = F.sum(F.when(g, c("n")).otherwise(0.0))
        sums[f"d{i}"] = F.sum(F.when(g, c("d")).otherwise(0.0))
    t = cumulate(rows, "t", sums, by)
    keep = [*by, "t", "d", (c("tot_n") - c("cum_n")).alias("n")]
    for i in range(len(levels)):
        keep += [f"d{i}", (c(f"tot_n{i}") - c(f"cum_n{i}")).alias(f"n{i}")]
    return t.select(*keep)


def logrank_like(df, time, group, event=None, by=(), weight: str = "logrank", alternative="two-sided",
                 levels: Sequence[str] | None = None, with_hr: bool = True) -> DataFrame:
    """Observed minus expected per group, weighted 1 (log-rank) or by the number at risk (Gehan)."""
    by = list(by)
    lv = [str(v) for v in levels] if levels else levels_of(df, group)
    if len(lv) < 2:
        raise ValueError("need at least two groups")
    rows = by_time(survival_rows(df, time, group, event, by).where(c("g").isin(lv)), [*by, "g"])
    t = risk_table(rows, lv, by).where("d > 0")
    w = c("n") if weight == "gehan" else F.lit(1.0)
    k = len(lv)
    var0 = F.when(c("n") > 1, c("d") * (c("n") - c("d")) / (c("n") - 1)).otherwise(0.0)
    aggs = [F.sum(w * (c(f"d{i}") - c("d") * c(f"n{i}") / c("n"))).alias(f"u{i}") for i in range(k)]
    aggs += [F.sum(sq(w) * var0 * c(f"n{i}") / c("n") * ((1.0 if i == j else 0.0) - c(f"n{j}") / c("n"))).alias(f"v{i}_{j}")
             for i in range(k) for j in range(i, k)]
    # totals come from the rows themselves so that late censoring counts too
    s = t.groupBy(*by).agg(*aggs, F.sum("d").alias("events"))
    size = rows.groupBy(*by).agg(F.sum("n").alias("total"))
    s = s.join(size, by) if by else _paste(s, size)

    def finish(r):
        u = np.array([r[f"u{i}"] for i in range(k)])
        v = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                v[i, j] = v[j, i] = r[f"v{i}_{j}"]
        seen = [i for i in range(1, k) if v[i, i] > 0]
        x2 = float(u[seen] @ np.linalg.pinv(v[np.ix_(seen, seen)]) @ u[seen]) if seen else 0.0
        return {**{b: r[b] for b in by}, "chi2": x2, "df": len(seen), "events": int(r["events"]), "total": int(r["total"])}

    s = per_row(s, finish, ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
                                     + ["chi2 double", "df int", "events bigint", "total bigint"]))
    name, hr = "", None
    if with_hr:
        fits, labels = cox_fits(df.where(c(group).cast("string").isin(lv)), time, group, event, by, lv)
        vals = [(*key, *(float(np.exp(v)) for v in (f.theta[0], f.theta[0] - 1.96 * f.wald(0)[1], f.theta[0] + 1.96 * f.wald(0)[1])))
                for key, f in fits.items()]
        h = df.sparkSession.createDataFrame(vals, ", ".join([f"`{b}` string" for b in by] + ["hr double", "lo double", "hi double"]))
        s = s.withColumns({b: c(b).cast("string") for b in by}).join(h, by, "left") if by else _paste(s, h)
        name, hr = f"HR ({lv[1]} vs {lv[0]})", c("hr")
    return result(s, "T-902" if weight == "gehan" else "T-901", by=by, statistic=c("chi2"), p=D.p_chi2(c("chi2"), c("df")),
                  effect_name=name, effect=hr, ci=(c("lo"), c("hi")) if with_hr else (None, None),
                  n={"total": c("total"), "events": c("events")}, numbers={"df": c("df")})


def logrank(df, time, group, event=None, by=(), **kw) -> DataFrame:
    return logrank_like(df, time, group, event, by, "logrank", **kw)


def gehan(df, time, group, event=None, by=(), **kw) -> DataFrame:
    return logrank_like(df, time, group, event, by, "gehan", **kw)


def survival_curve(df, time, group, event=None, by: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """Kaplan-Meier per (by, group): t, at risk, events, survival, next event time. ``counts`` is the table of ``by_time``, if there is one."""
    keys = [*by, "g"]
    rows = counts if counts is not None else by_time(survival_rows(df, time, group, event, by), keys)
    t = cumulate(rows, "t", {"n": F.sum("n"), "d": F.sum("d")}, keys)
    t = t.select(*keys, "t", "d", (c("tot_n") - c("cum_n")).alias("n"), c("tot_n").alias("size")).where("d > 0")
    lnq = F.when(c("d") < c("n"), F.log1p(-c("d") / c("n"))).otherwise(0.0)
    s = cumulate(t.select("*", lnq.alias("_l"), (c("d") >= c("n")).cast("double").alias("_z")), "t",
                 {"l": F.sum("_l"), "z": F.sum("_z"), "d": F.sum("d"), "n": F.max("n"), "size": F.max("size")}, keys, lead=True)
    dead = c("cum_z") + c("z") > 0
    return s.select(*keys, "t", "n", "d", "size", F.when(dead, 0.0).otherwise(F.exp(c("cum_l") + c("l"))).alias("surv"), "next_value")


def median_survival(df, time, group, event=None, by=()) -> DataFrame:
    """First time with survival <= 1/2 per group; null while half have not had the event."""
    s = survival_curve(df, time, group, event, by)
    return s.groupBy(*by, "g").agg(F.max("size").cast("long").alias("n"), F.sum("d").cast("long").alias("events"),
                                   F.min(F.when(c("surv") <= 0.5, c("t"))).alias("median"), F.min("surv").alias("lowest"))


def rmst(df, time, group, event=None, by=(), alternative="two-sided", levels=None) -> DataFrame:
    """Difference of restricted mean survival up to the smaller of the two last times."""
    by = list(by)
    lv = [str(v) for v in levels] if levels else levels_of(df, group)
    if len(lv) != 2:
        raise ValueError(f"need exactly two groups, found {len(lv)}")
    rows = by_time(survival_rows(df, time, group, event, by), [*by, "g"])
    last = rows.groupBy(*by).agg(F.least(*[F.max(F.when(c("g") == v, c("t"))) for v in lv]).alias("tau"),
                                 *[F.sum(F.when(c("g") == v, c("n")).otherwise(0.0)).cast("long").alias(f"N{i}") for i, v in enumerate(lv)])
    s = survival_curve(df, time, group, event, by, rows)
    if by:
        s = s.join(last.select(*by, "tau"), by)
    else:
        s = s.withColumn("tau", F.lit(last.first()["tau"]))
    s = s.where("t <= tau")
    width = F.least(F.coalesce("next_value", "tau"), c("tau")) - c("t")
    s = s.select("*", (c("surv") * width).alias("_a"))
    a = cumulate(s, "t", {"a": F.sum("_a"), "d": F.max("d"), "n": F.max("n")}, [*by, "g"])
    rest = c("tot_a") - c("cum_a")
    part = F.when(c("n") > c("d"), sq(rest) * c("d") / (c("n") * (c("n") - c("d")))).otherwise(0.0)
    per = a.groupBy(*by, "g").agg(F.min("t").alias("t1"), F.sum("a").alias("area"), F.sum(part).alias("var"))
    pick = lambda v, col: F.max(F.when(c("g") == v, col))
    z = per.groupBy(*by).agg(*[pick(v, c("t1") + c("area")).alias(f"r{i}") for i, v in enumerate(lv)],
                             *[pick(v, c("var")).alias(f"v{i}") for i, v in enumerate(lv)])
    z = last.join(z, by, "left") if by else _paste(z, last)
    # a group without an event before tau keeps survival 1 throughout
    z = z.withColumns({k: F.coalesce(c(k), v) for k, v in {"r0": c("tau"), "r1": c("tau"), "v0": F.lit(0.0), "v1": F.lit(0.0)}.items()})
    d, se = c("r0") - c("r1"), F.sqrt(c("v0") + c("v1"))
    z = z.select("*", d.alias("diff"), se.alias("se")).withColumn("z", F.coalesce(ratio(c("diff"), c("se")), F.lit(0.0)))
    return result(z, "T-903", by=by, statistic=c("z"), p=D.p_z(c("z"), alternative), effect_name="RMST difference",
                  effect=c("diff"), ci=(c("diff") - 1.96 * c("se"), c("diff") + 1.96 * c("se")),
                  n={lv[0]: c("N0"), lv[1]: c("N1")}, numbers={"tau": c("tau"), "rmst_1": c("r0"), "rmst_2": c("r1")})


# ------------------------------------------------------------------ Cox model
def _risk_sums(rows: DataFrame, names, th, by, cuts=None) -> DataFrame:
    """Per time: event sums and the risk-set sums of exp(xb) times 1, x, xx. Rows laid out by ``_time_bucket`` stay where they are."""
    k = len(names)
    xb = sum((t * c(v) for t, v in zip(th, names)), F.lit(0.0))
    r = rows.withColumn("_xb", xb).withColumn("_e", F.exp("_xb") * c("w"))
    sums = {"s": F.sum("_e"), "d": F.sum("d"), "dx": F.sum(c("d") * c("_xb"))}
    for i in range(k):
        sums[f"s{i}"] = F.sum(c("_e") * c(names[i]))
        sums[f"d{i}"] = F.sum(c("d") * c(names[i]))
        for j in range(i, k):
            sums[f"s{i}_{j}"] = F.sum(c("_e") * c(names[i]) * c(names[j]))
    laid_out = "_time_bucket" in rows.columns
    t = cumulate(r, "t", sums, by, cuts=cuts, bucket="_time_bucket" if laid_out else None, laid_out=laid_out)
    risk = {m: c(f"tot_{m}") - c(f"cum_{m}") for m in sums if m.startswith("s")}
    return t.select(*by, "t", *[m for m in sums if m.startswith("d")], *[v.alias(m) for m, v in risk.items()]).where("d > 0")


def cox_fits(df, time, x, event=None, by=(), levels=None) -> tuple[dict[tuple, Fit], list[str]]:
    """Breslow-tie Cox fits for all strata at once; indicator designs first collapse to counts per
    (time, level)."""
    by = list(by)
    base = survival_rows(df.withColumn("_x", c(x)), time, None, event, [*by, "_x"])
    xs = design(base, "_x", x, levels)
    names = [f"x{i}" for i in range(len(xs))]
    rows = base.select(*by, "t", "d", *[v.alias(n) for n, v in zip(names, xs.values())]).dropna()
    # subjects alike in time and x are one row; the table is written once, and means, borders and Newton steps read it
    rows = cut_lineage(rows.groupBy(*by, "t", *names).agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("d").alias("d")))
    if list(xs) == ["_x"]:
        labels = [x]
        m = rows.agg(F.sum(c("x0") * c("w")) / F.sum("w")).first()[0] or 0.0
        rows = rows.withColumns({"x0": c("x0") - F.lit(m)})
    else:
        labels = list(xs)
    # with more than one bucket of distinct times the rows are laid out once by time: each Newton step scans the buckets in place and shares a row per bucket;
    # fewer times are summed before they move
    cuts = value_cuts(rows.select("t").distinct(), "t")
    if cuts:
        spread = max(len(cuts) + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if by else 1)
        rows = rows.withColumns({v: c(v).cast("string") for v in by})
        rows = add_bucket(rows, "t", cuts, "_time_bucket").withColumn("_time_bucket", c("_time_bucket").cast("int")).repartition(spread, *by, "_time_bucket")
    k = len(names)

    def totals(r, th):
        t = _risk_sums(r, names, th, by, cuts)
        aggs = [F.sum(c("dx") - c("d") * F.ln("s")).alias("ll")]
        aggs += [F.sum(c(f"d{i}") - c("d") * c(f"s{i}") / c("s")).alias(f"g{i}") for i in range(k)]
        aggs += [F.sum(-c("d") * (c(f"s{i}_{j}") / c("s") - c(f"s{i}") * c(f"s{j}") / sq(c("s")))).alias(f"h{i}_{j}")
                 for i in range(k) for j in range(i, k)]
        return t.groupBy(*by).agg(*aggs)

    fits = newton(rows, by, lambda r: np.zeros(k), None, k, {"_rows": F.sum("w"), "_ev": F.sum("d")}, totals=totals)
    return fits, labels


def cox(df, time, x, event=None, by=(), alternative="two-sided", test_id="T-807") -> DataFrame:
    fits, labels = cox_fits(df, time, x, event, by)
    rows = survival_rows(df, time, x, event, list(by))
    cnt = {tuple(str(r[b]) for b in by): r for r in rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("e")).collect()}
    for k, f in fits.items():
        f.n = cnt[k]["n"]
    return _fit_rows(df, test_id, fits, list(by), labels, 0, "HR", n_extra={k: {"events": int(cnt[k]["e"])} for k in fits})


def proportional_hazards(df, time, x, event=None) -> DataFrame:
    """C-11: correlation of Schoenfeld residuals with the rank of the event time."""
    fits, _ = cox_fits(df, time, x, event)
    f = fits[()]
    base = survival_rows(df.withColumn("_x", c(x)), time, None, event, ["_x"])
    xs = design(base, "_x", x)
    names = [f"x{i}" for i in range(len(xs))]
    rows = base.select("t", "d", *[v.alias(n) for n, v in zip(names, xs.values())]).dropna()
    # per time: the risk set's sums and the events' x; one pass over the subjects, everything after it is per time
    eb = F.exp(sum((F.lit(float(v)) * c(n) for v, n in zip(f.theta, names)), F.lit(0.0)))
    sick = F.when(c("d") > 0, c("x0"))
    times = cut_lineage(rows.groupBy("t").agg(F.sum(eb).alias("s"), F.sum(eb * c("x0")).alias("s0"), F.sum("d").alias("e"), F.avg(sick).alias("m"), F.var_pop(sick).alias("v")))
    t = cumulate(times, "t", {k: F.sum(k) for k in ("s", "s0", "e", "m", "v")}).where("e > 0")
    u = c("m") - (c("tot_s0") - c("cum_s0")) / (c("tot_s") - c("cum_s"))
    t = t.select("e", (c("cum_e") + (c("e") + 1) / 2).alias("rank"), u.alias("u"), "v")
    mean = t.agg((F.sum(c("e") * c("u")) / F.sum("e")).alias("u"), (F.sum(c("e") * c("rank")) / F.sum("e")).alias("r")).first()
    du, dr = c("u") - F.lit(mean["u"]), c("rank") - F.lit(mean["r"])
    s = t.agg(ratio(F.sum(c("e") * du * dr), F.sqrt(F.sum(c("e") * (c("v") + sq(du)))) * F.sqrt(F.sum(c("e") * sq(dr)))).alias("r"), F.sum("e").cast("long").alias("n"))
    s = s.withColumn("stat", c("n") * sq(c("r")))
    return result(s, "C-11", statistic=c("stat"), p=D.p_chi2(c("stat"), F.lit(1.0)), effect_name="r(residual, time rank)",
                  effect=c("r"), n={"events": c("n")})


def concordance_index(df, time, score, event=None) -> DataFrame:
    """Harrell's C: usable pairs are (event at t, someone still at risk later); higher score should
    fail first.  Events and later subjects meet as left and right children of the time tree."""
    rows = survival_rows(df.withColumn("_s", num(score)), time, None, event, ["_s"])
    pts = cut_lineage(rows.groupBy("t", "d", c("_s").alias("y")).agg(F.count(F.lit(1)).alias("n")))
    # axis position 2r for events and 2r+1 for censorings: a censoring at an event time outlives it
    axis = cumulate(pts, "t", {"one": F.max(F.lit(1))}).select("t", c("cum_one").alias("_r"))
    p = beside(pts, axis, ["t"], few=FEW).select((2 * c("_r") + (1 - c("d"))).alias("x"), "y", "n")
    s = pair_sums(p, "x", "y", {"e": F.when(F.expr("pmod(x, 2) = 0"), c("n")).otherwise(0), "a": c("n")}, ["e"], ["a"], count="n")
    return s.select((c("all_e_a") - c("below_e_a") - c("tie_e_a")).alias("con"), c("tie_e_a").alias("tied"), c("all_e_a").alias("usable")).select(
        "usable", ((c("con") + c("tied") / 2) / c("usable")).alias("c_index"))
