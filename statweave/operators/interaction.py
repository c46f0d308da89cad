"""Two-factor analyses from the table of cells."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from statweave.functions import distributions as D
from statweave.plans.common import beside, num, result
from statweave.plans.cumulate import ranked
from statweave.plans.gram import per_row
from statweave.plans.moments import group_moments

c = F.col


def cell_means(df, y, a, b, by=()) -> DataFrame:
    return group_moments(df, y, [a, b], by)


def _two_way(df, y, a, b, by, test_id, effect_name) -> DataFrame:
    """Type II F tests: within-cell squares plus weighted least squares on the cell means."""
    by = list(by)
    cells = cell_means(df, y, a, b, by).select(*by, c(a).cast("string").alias("a"), c(b).cast("string").alias("b"), "n", "mean",
                                               F.coalesce("var", F.lit(0.0)).alias("var"))
    rows = cells.groupBy(*by).agg(F.collect_list(F.struct("a", "b", "n", "mean", "var")).alias("t"))

    def finish(r):
        t = r["t"]
        n = np.array([u["n"] for u in t], float)
        m = np.array([u["mean"] for u in t], float)
        la, lb = sorted({u["a"] for u in t}), sorted({u["b"] for u in t})
        one = np.ones((len(t), 1))
        da = np.array([[float(u["a"] == v) for v in la[1:]] for u in t]).reshape(len(t), -1)
        db = np.array([[float(u["b"] == v) for v in lb[1:]] for u in t]).reshape(len(t), -1)
        within = float(sum((u["n"] - 1) * u["var"] for u in t))
        w = np.sqrt(n)[:, None]

        def rss(*parts):
            x = np.hstack([one, *parts])
            beta, _, rank, _ = np.linalg.lstsq(w * x, w[:, 0] * m, rcond=None)
            return float(np.sum(n * (m - x @ beta) ** 2)), int(rank)

        add, r_add = rss(da, db)
        only_a, r_a = rss(da)
        only_b, r_b = rss(db)
        dfe, dfi = float(n.sum() - len(t)), len(t) - r_add
        mse = within / dfe if dfe > 0 else float("nan")
        f = lambda ss, d: ss / d / mse if d > 0 and mse > 0 else float("nan")
        return {**{v: r[v] for v in by}, "f": f(add, dfi), "d1": float(dfi), "d2": dfe, "ss": add, "within": within,
                "rows": int(n.sum()), "cells": len(t), "fa": f(only_b - add, r_add - r_b), "fb": f(only_a - add, r_add - r_a),
                "smallest": int(n.min()), "largest": int(n.max())}

    s = per_row(rows, finish, ", ".join([f"`{v}` {df.schema[v].dataType.simpleString()}" for v in by] + [
        "f double", "d1 double", "d2 double", "ss double", "within double", "rows bigint", "cells bigint", "fa double", "fb double",
        "smallest bigint", "largest bigint"]))
    return result(s, test_id, by=by, statistic=c("f"), p=D.p_f(c("f"), c("d1"), c("d2")), effect_name=effect_name,
                  effect=F.try_divide(c("ss"), c("ss") + c("within")),
                  n={"rows": c("rows"), "cells": c("cells"), "smallest_cell": c("smallest"), "largest_cell": c("largest")},
                  numbers={"df1": c("d1"), "df2": c("d2"), f"F_{a}": c("fa"), f"F_{b}": c("fb")})


def two_way_anova(df, y, a, b, by: Sequence[str] = (), alternative="two-sided") -> DataFrame:
    return _two_way(df, y, a, b, by, "T-401", "partial eta^2")


def aligned_rank_anova(df, y, a, b, alternative="two-sided") -> DataFrame:
    """Main effects are removed through marginal means, what is left is ranked over the whole
    table, and the interaction is tested on the ranks."""
    src = df.select(c(a).alias("a"), c(b).alias("b"), num(y).alias("y")).dropna()
    ma = src.groupBy("a").agg(F.avg("y").alias("_ma"))
    mb = src.groupBy("b").agg(F.avg("y").alias("_mb"))
    grand = src.agg(F.avg("y")).first()[0] or 0.0
    al = beside(beside(src, ma, ["a"]), mb, ["b"]).withColumn("_al", F.round(c("y") - c("_ma") - c("_mb") + F.lit(grand), 9))
    return _two_way(ranked(al, "_al", "_rank"), "_rank", "a", "b", [], "T-402", "partial eta^2 (rank)")
