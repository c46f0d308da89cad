"""Shaking a result: bootstrap band, trimmed tails, other tests of the same question."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from statweave.operators.run import RUNNERS, null_value
from statweave.plans.common import num
from statweave.plans.cumulate import quantiles
from statweave.plans.resample import _POISSON1
from statweave.spec import Spec

c = F.col
TRIMS = (0.01, 0.05)


def bootstrap_rows(df: DataFrame, key: Sequence[str], reps: int, seed: int = 0) -> DataFrame:
    """Every row as often as its Poisson(1) draw in each replicate ``_b``; the draw is a hash of (key,
    replicate, seed).  With ``_b`` as a stratum one job runs the test on all replicates."""
    b = df.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), "_b", *key), F.lit(1 << 53)) / float(1 << 53)
    w = sum(((u >= float(t)).cast("int") for t in _POISSON1), F.lit(0))
    return b.withColumn("_w", w).where("_w > 0").withColumn("_", F.explode(F.sequence(F.lit(1), c("_w")))).drop("_", "_w")


def bootstrap_effect(df: DataFrame, spec: Spec, test_id: str, key: Sequence[str], reps: int = 200, seed: int = 0) -> DataFrame:
    """Band of the effect over replicates and the share on the other side of "no difference"."""
    used = list(dict.fromkeys([*key, *[v for v in (spec.y, spec.group, spec.event, spec.by, spec.subject) if v]]))
    base = RUNNERS[test_id](df, spec, []).select(F.struct(c("effect.value").alias("v"), null_value(c("effect.name")).alias("ref"))).scalar()
    r = RUNNERS[test_id](bootstrap_rows(df.select(*used), key, reps, seed), spec, ["_b"]).select(c("effect.value").alias("v")).withColumn("_o", base)
    flip = (c("v") - c("_o.ref")) * (c("_o.v") - c("_o.ref")) < 0
    return r.agg(F.count("v").alias("draws"), F.first("_o.v").alias("effect"), *[F.percentile("v", p / 100).alias(f"p{p}") for p in (5, 25, 50, 75, 95)],
                 F.avg(flip.cast("double")).alias("flip_share"))


def trim(df: DataFrame, y: str, share: float) -> DataFrame:
    """Rows between the ``share`` and 1 - ``share`` quantiles of y."""
    q = quantiles(df.select(num(y).alias("y")), "y", [share, 1 - share]).select(F.struct("q0", "q1")).scalar()
    return df.withColumn("_q", q).where(num(y).between(c("_q.q0"), c("_q.q1"))).drop("_q")


def robustness(df: DataFrame, spec: Spec, test_id: str, alternatives: Sequence[str] = (), trims: Sequence[float] = TRIMS) -> DataFrame:
    """The result beside its trimmed versions and the other tests, with direction flips."""
    def tag(d: DataFrame, kind: str, label: str) -> DataFrame:
        return d.select(F.lit(kind).alias("kind"), F.lit(label).alias("label"), "test_id", "statistic", "p", "effect")

    base = RUNNERS[test_id](df, spec, [])
    parts = [tag(base, "result", test_id)]
    parts += [tag(RUNNERS[test_id](trim(df, spec.y, s), spec, []), "trim", f"{s:.0%} each tail") for s in trims]
    parts += [tag(RUNNERS[a](df, spec, []), "other test", a) for a in alternatives if a != test_id]
    side = F.signum(c("effect.value") - null_value(c("effect.name")))
    own = base.select(side.alias("s")).scalar()
    return reduce(DataFrame.unionByName, parts).withColumn("_own", own).withColumn("flipped", F.coalesce(side * c("_own") < 0, F.lit(False))).drop("_own")
