"""Audits of train / validation / test / external tables: leaks, splits, balance, evaluation.

Findings are rows ``check, role, column, verdict, numbers``.  Nothing is trained.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from statweave.functions import distributions as D
from statweave.operators import guard
from statweave.plans.common import num, ratio, sq
from statweave.plans.cumulate import cumulate

c = F.col
DEV = ("train", "valid", "test")
#: fixed values: thresholds of the audits
LIMITS = {"near_sd": 0.001, "proxy_auc": 0.98, "proxy_r": 0.95, "srm_p": 0.0005, "epv": 10, "separation": 0.02, "vif": 5.0, "pair_r": 0.7, "ece_bins": 10}


@dataclass(frozen=True)
class ModelSpec:
    sets: dict[str, DataFrame]                 # role -> table
    label: str
    features: tuple[str, ...] = ()
    group: str | None = None
    time: str | None = None
    score: str | None = None
    positive: str | None = None
    threshold: float = 0.5
    planned: dict[str, float] = field(default_factory=dict)

    def features_in(self, df: DataFrame) -> list[str]:
        skip = {self.label, self.group, self.time, self.score}
        return [v for v in (self.features or df.columns) if v in df.columns and v not in skip]

    def dev(self) -> DataFrame:
        parts = [self.sets[r] for r in DEV if r in self.sets]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def finding(df: DataFrame, check: str, verdict: Column, numbers: dict[str, Column], role=None, column=None) -> DataFrame:
    txt = lambda v: (F.lit(v) if v is None or isinstance(v, str) else v).cast("string")
    return df.select(F.lit(check).alias("check"), txt(role).alias("role"), txt(column).alias("column"), verdict.cast("string").alias("verdict"),
                     F.create_map(*[x for k, v in numbers.items() for x in (F.lit(k), v.cast("double"))]).alias("numbers"))


def _verdict(bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), "fail").otherwise("pass")


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _numeric(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [v for v in cols if isinstance(df.schema[v].dataType, NumericType)]


# ------------------------------------------------------------------ leaks
def _same(a: DataFrame, b: DataFrame, cols: Sequence[str], how: str) -> DataFrame:
    """Null-safe semi / anti join on equal feature values; the right side keeps one row per value."""
    keys = b.select(*[c(v).alias(f"_b{i}") for i, v in enumerate(cols)]).distinct()
    return a.join(keys, [c(v).eqNullSafe(c(f"_b{i}")) for i, v in enumerate(cols)], how)


def exact_duplicates(train: DataFrame, other: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of ``other`` whose features all occur together in ``train``."""
    return _same(other, train, features, "left_semi")


def near_duplicates(train: DataFrame, other: DataFrame, features: Sequence[str], tol: float = LIMITS["near_sd"], cell: float = 64.0) -> DataFrame:
    """Rows of ``other`` with a ``train`` row inside ``tol`` SD on every numeric feature.

    Both sides are laid on a grid ``cell`` tolerances wide over all features at once; a probe visits
    the second cell of a feature only when it lies within ``tol`` of the border, so it meets its own
    cell and rarely another.  A semi join stops at the first partner; train points are distinct."""
    feats = list(features)
    st = train.agg(*[F.avg(num(v)).alias(f"m{i}") for i, v in enumerate(feats)], *[F.stddev_pop(num(v)).alias(f"s{i}") for i, v in enumerate(feats)]).first()
    z = lambda i, v: F.coalesce((num(v) - F.lit(st[f"m{i}"] or 0.0)) / F.lit(st[f"s{i}"] or 1.0), F.lit(0.0))
    w = cell * tol
    a = train.select(*[z(i, v).alias(f"_a{i}") for i, v in enumerate(feats)]).distinct()
    a = a.withColumn("_ca", F.array(*[F.floor(c(f"_a{i}") / w) for i in range(len(feats))]))
    b = other.withColumns({f"_z{i}": z(i, v) for i, v in enumerate(feats)})
    b = b.withColumn("_id", F.xxhash64(*[c(f"_z{i}") for i in range(len(feats))]))
    probe = b.select(*[f"_z{i}" for i in range(len(feats))]).distinct().withColumn("_cb", F.expr("cast(array() as array<bigint>)"))
    for i in range(len(feats)):
        ends = F.array_distinct(F.array(F.floor((c(f"_z{i}") - tol) / w), F.floor((c(f"_z{i}") + tol) / w)))
        probe = probe.withColumn("_x", F.explode(ends)).withColumn("_cb", F.concat("_cb", F.array(c("_x")))).drop("_x")
    near = reduce(lambda p, q: p & q, [F.abs(c(f"_z{i}") - c(f"_a{i}")) <= tol + 1e-12 for i in range(len(feats))])
    hit = probe.join(a, (c("_ca") == c("_cb")) & near, "left_semi").select(*[c(f"_z{i}").alias(f"_h{i}") for i in range(len(feats))]).distinct()
    return b.join(hit, [c(f"_z{i}") == c(f"_h{i}") for i in range(len(feats))], "left_semi").select(*other.columns)


def duplicate_audit(spec: ModelSpec) -> DataFrame:
    """MB-C01."""
    train = spec.sets["train"]
    parts = []
    for role in ("test", "external"):
        if role not in spec.sets:
            continue
        other = spec.sets[role]
        shared = [v for v in spec.features_in(train) if v in other.columns]
        nums = [v for v in _numeric(train, shared) if v in _numeric(other, shared)]
        flag = exact_duplicates(train, other, shared).agg(F.count(F.lit(1)).alias("exact"))
        near = near_duplicates(train, other, nums).agg(F.count(F.lit(1)).alias("near")) if nums else other.limit(0).agg(F.count(F.lit(1)).alias("near"))
        from statweave.operators.regression import _paste
        s = _paste(_paste(flag, near), other.agg(F.count(F.lit(1)).alias("rows")))
        parts.append(finding(s, "MB-C01", _verdict((c("exact") > 0) | (c("near") > 0)),
                             {"rows": c("rows"), "exact": c("exact"), "near": c("near"), "features": F.lit(len(nums))}, role))
    return _all(parts)


def group_crossing(spec: ModelSpec) -> DataFrame:
    """MB-C02: groups present on both sides and the rows they touch."""
    parts = []
    for role, other in spec.sets.items():
        if role == "train":
            continue
        both = spec.sets["train"].select(spec.group).intersect(other.select(spec.group)).dropna()
        from statweave.operators.regression import _paste
        s = _paste(both.agg(F.count(F.lit(1)).alias("groups")), other.join(both, spec.group, "left_semi").agg(F.count(F.lit(1)).alias("rows")))
        parts.append(finding(s, "MB-C02", _verdict(c("groups") > 0), {"groups": c("groups"), "rows": c("rows")}, role, spec.group))
    return _all(parts)


def time_overlap(spec: ModelSpec) -> DataFrame:
    """MB-C03: the evaluation set starts before training ends."""
    end = spec.sets["train"].agg(F.max(spec.time).alias("v")).scalar()
    parts = []
    for role in ("test", "external"):
        if role in spec.sets:
            s = spec.sets[role].agg(F.min(spec.time).alias("start"), F.max(spec.time).alias("stop"),
                                    F.sum((c(spec.time) <= end).cast("long")).alias("inside")).withColumn("train_end", end)
            parts.append(finding(s, "MB-C03", _verdict(c("start") <= c("train_end")), {"rows_inside": F.coalesce("inside", F.lit(0))}, role, spec.time))
    return _all(parts)


def feature_auc(df: DataFrame, features: Sequence[str], label: str, positive: str) -> DataFrame:
    """Rank AUC of every numeric feature against a binary label: one unpivot, one ordered table."""
    parts = [F.struct(F.lit(v).alias("column"), num(v).alias("v")) for v in features]
    long = df.where(c(label).isNotNull()).select((c(label).cast("string") == str(positive)).cast("long").alias("_y"), F.explode(F.array(*parts)).alias("r")) \
             .select("_y", "r.*").where("v is not null")
    t = cumulate(long, "v", {"n": F.count(F.lit(1)), "pos": F.sum("_y")}, ["column"])
    neg, below = c("n") - c("pos"), c("cum_n") - c("cum_pos")
    s = t.groupBy("column").agg(F.sum(c("pos").cast("double") * (below + neg / 2)).alias("u"), F.max("tot_pos").alias("p"), F.max("tot_n").alias("n"))
    return s.select("column", "n", ratio(c("u"), c("p").cast("double") * (c("n") - c("p"))).alias("auc"))


def label_proxy(spec: ModelSpec) -> DataFrame:
    """MB-C05: one feature that nearly is the label (AUC or correlation)."""
    df = spec.sets["train"]
    feats = _numeric(df, spec.features_in(df))
    levels = [r[0] for r in df.select(c(spec.label).cast("string").alias("v")).dropna().distinct().limit(3).collect()]
    if len(levels) == 2:
        s = feature_auc(df, feats, spec.label, spec.positive or sorted(levels)[-1]).where("n >= 10")
        score = F.greatest(c("auc"), 1 - c("auc"))
        return finding(s, "MB-C05", _verdict(score >= LIMITS["proxy_auc"]), {"auc": score}, "train", c("column"))
    row = df.agg(*[F.corr(num(v), num(spec.label)).alias(f"r{i}") for i, v in enumerate(feats)])
    s = row.select(F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.abs(c(f"r{i}")).alias("r")) for i, v in enumerate(feats)])).alias("x")).select("x.*")
    return finding(s, "MB-C05", _verdict(c("r") >= LIMITS["proxy_r"]), {"r": c("r")}, "train", c("column"))


# ------------------------------------------------------------------ splits and labels
def roles(spec: ModelSpec, cols: Sequence[str]) -> DataFrame:
    """All sets stacked with their role."""
    return _all([d.select(F.lit(r).alias("role"), *[c(v).cast("string").alias(v) for v in cols]) for r, d in spec.sets.items()])


def split_ratio(spec: ModelSpec) -> DataFrame:
    """MB-C06: planned sizes (only when a plan is given) and the class mix of each set against all."""
    parts = []
    stacked = roles(spec, [spec.label])
    if spec.planned:
        s = guard._srm_stats(stacked.where(c("role").isin(list(spec.planned))), "role", spec.planned)
        parts.append(finding(s, "MB-C06", _verdict(c("p") < LIMITS["srm_p"]), {"chi2": c("chi2"), "p": c("p"), "n": c("n")}, "planned"))
    cells = stacked.where(c(spec.label).isNotNull()).groupBy("role", spec.label).agg(F.count(F.lit(1)).alias("o"))
    w, r = Window.partitionBy(spec.label), Window.partitionBy("role")
    seen = cells.select("*", F.sum("o").over(w).alias("cls"), F.sum("o").over(r).alias("size"), F.sum("o").over(Window.partitionBy(F.lit(0))).alias("all"),
                        F.count("o").over(r).alias("k"))
    e = c("size") * c("cls") / c("all")
    s = seen.groupBy("role").agg(F.sum(sq(c("o") - e) / e).alias("chi2"), F.max("k").alias("k"), F.max("size").alias("n"))
    s = s.withColumn("p", D.p_chi2(c("chi2"), c("k") - 1))
    adj = LIMITS["srm_p"] / len(spec.sets)
    verdict = F.when(c("k") < 2, "skipped").otherwise(_verdict(c("p") < adj))
    parts.append(finding(s, "MB-C06", verdict, {"chi2": c("chi2"), "p": c("p"), "n": c("n"), "threshold": F.lit(adj)}, c("role"), spec.label))
    return _all(parts)


def class_mix(spec: ModelSpec, dev_external: bool = False) -> DataFrame:
    """Class counts and shares per set, or for development sets against external."""
    t = roles(spec, [spec.label]).where(c(spec.label).isNotNull())
    if dev_external:
        t = t.withColumn("role", F.when(c("role").isin(list(DEV)), "dev").otherwise("ext"))
    g = t.groupBy("role", c(spec.label).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("ratio", c("n") / F.sum("n").over(Window.partitionBy("role")))


def source_coverage(source: DataFrame, spec: ModelSpec, key: Sequence[str]) -> DataFrame:
    """MB-C07: source rows that reached a set, sets' rows found in the source, columns whose
    distribution the loss changed."""
    used = _all([d.select(*key) for d in spec.sets.values()]).distinct()
    flagged = guard.flag_lost(source, used, key)
    s = flagged.agg(F.count(F.lit(1)).alias("n"), F.sum(c("lost").cast("long")).alias("lost"))
    parts = [finding(s, "MB-C07", F.when(c("lost") == 0, "pass").otherwise("fail"), {"rows": c("n"), "lost": c("lost"), "ratio": ratio(c("lost"), c("n"))}, "source")]
    for role, d in spec.sets.items():
        j = guard.join_rate(d, source, key)
        parts.append(finding(j, "MB-C07", _verdict(c("hit")), {"rate": c("numbers")["rate"]}, role))
    cols = [v for v in [spec.label, *spec.features_in(source)] if v in source.columns and v not in key]
    b = guard.biased_loss(flagged, cols)
    parts.append(finding(b, "MB-C07", _verdict(c("hit")), {"p": c("numbers")["p"]}, "shift", c("column")))
    return _all(parts)


def before_after(flagged: DataFrame, column: str) -> DataFrame:
    """One column before the loss and after it: moments, or level counts for categories."""
    if isinstance(flagged.schema[column].dataType, NumericType):
        v = num(column)
        kept = F.when(~c("lost"), v)
        return flagged.agg(F.count(v).alias("n_before"), F.avg(v).alias("mean_before"), F.stddev_samp(v).alias("sd_before"),
                           F.count(kept).alias("n_after"), F.avg(kept).alias("mean_after"), F.stddev_samp(kept).alias("sd_after"))
    return flagged.where(c(column).isNotNull()).groupBy(c(column).cast("string").alias("level")).agg(
        F.count(F.lit(1)).alias("n_before"), F.sum((~c("lost")).cast("long")).alias("n_after"))


def class_balance(spec: ModelSpec) -> DataFrame:
    """MB-C08 / MB-C24: smallest class and majority : minority over the development sets."""
    g = spec.dev().where(c(spec.label).isNotNull()).groupBy(c(spec.label).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    s = g.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("n").alias("k"), F.min_by("level", F.struct("n", "level")).alias("minority"))
    bad = (c("lo") < guard.LIMITS["small_n"]) | (c("hi") > guard.LIMITS["imbalance"] * c("lo"))
    return finding(s, "MB-C08", F.when(c("k") < 2, "skipped").otherwise(_verdict(bad)), {"n_minority": c("lo"), "ratio": ratio(c("hi"), c("lo")), "classes": c("k")},
                   "dev", c("minority"))


def shortcut_risk(spec: ModelSpec, meta: Sequence[str], levels=None) -> DataFrame:
    """MB-C08: metadata that differs by label."""
    s = guard.smd_imbalance(spec.dev(), spec.label, meta, levels)
    return finding(s, "MB-C08", _verdict(c("hit")), {"smd": c("numbers")["smd"], "chance_level": c("numbers")["chance_level"]}, "dev", c("column"))


def external_shift(spec: ModelSpec) -> DataFrame:
    """MB-C08: development against external features; text identifiers are left out."""
    dev, ext = spec.dev(), spec.sets["external"]
    feats = [v for v in spec.features_in(dev) if v in ext.columns]
    both = dev.select(*feats).withColumn("_set", F.lit("dev")).unionByName(ext.select(*feats).withColumn("_set", F.lit("ext")))
    text = [v for v in feats if v not in _numeric(dev, feats)]
    if text:
        u = both.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(v).alias(v) for v in text]).first()
        feats = [v for v in feats if v not in text or u[v] < 0.5 * u["_n"]]
    s = guard.smd_imbalance(both, "_set", feats, ["dev", "ext"])
    return finding(s, "MB-C08", _verdict(c("hit")), {"smd": c("numbers")["smd"], "chance_level": c("numbers")["chance_level"]}, "external", c("column"))


def label_levels(spec: ModelSpec) -> DataFrame:
    """MB-C13: levels never trained on (unseen) and levels a set lacks (absent)."""
    t = roles(spec, [spec.label]).where(c(spec.label).isNotNull()).select("role", c(spec.label).alias("level")).distinct()
    every = t.select("level").distinct()
    grid = t.select("role").distinct().withColumn("_k", F.lit(1)).join(every.withColumn("_k", F.lit(1)), "_k").drop("_k")   # roles x levels
    train = t.where("role = 'train'").select("level", F.lit(True).alias("trained"))
    g = grid.join(t.withColumn("here", F.lit(True)), ["role", "level"], "left").join(train, "level", "left")
    here, trained = F.coalesce("here", F.lit(False)), F.coalesce("trained", F.lit(False))
    s = g.groupBy("role").agg(F.sum((here & ~trained).cast("long")).alias("unseen"), F.sum((~here).cast("long")).alias("absent"), F.count(F.lit(1)).alias("k"))
    return finding(s, "MB-C13", _verdict((c("unseen") > 0) | (c("absent") > 0)), {"unseen": c("unseen"), "absent": c("absent"), "levels": c("k")}, c("role"), spec.label)


def code_direction(spec: ModelSpec, mapping: dict[str, int] | None = None) -> DataFrame:
    """MB-C13: does the positive class carry the largest code (recorded, else alphabetical)?"""
    dev = spec.dev().select(c(spec.label).cast("string").alias("v")).dropna()
    if mapping:
        ok = spec.positive in mapping and mapping[spec.positive] == max(mapping.values())
        s, verdict, levels = dev.sparkSession.range(1), F.lit("pass" if ok else "fail"), F.lit(len(mapping))
    else:
        s = dev.distinct().agg(F.max("v").alias("last"), F.count("v").alias("k"))
        verdict, levels = F.when(c("last") == F.lit(spec.positive), "pass").otherwise("fail"), c("k")
    return finding(s, "MB-C13", verdict, {"recorded": F.lit(float(mapping is not None)), "levels": levels}, "dev", spec.label)


# ------------------------------------------------------------------ preparation
def scale_spread(spec: ModelSpec, check: str = "MB-C10") -> DataFrame:
    """MB-C10 SD of each feature against the smallest; MB-C11 its share of total variance."""
    df = spec.dev()
    feats = _numeric(df, spec.features_in(df))
    row = df.agg(*[F.stddev_pop(num(v)).alias(f"s{i}") for i, v in enumerate(feats)])
    t = row.select(F.explode(F.array(*[F.struct(F.lit(v).alias("column"), c(f"s{i}").alias("sd")) for i, v in enumerate(feats)])).alias("x")).select("x.*").where("sd > 0")
    w = Window.partitionBy(F.lit(0))
    t = t.select("*", (c("sd") / F.min("sd").over(w)).alias("spread"), (sq(c("sd")) / F.sum(sq(c("sd"))).over(w)).alias("share"))
    bad = c("spread") > 10 if check == "MB-C10" else c("share") > 0.9
    return finding(t, check, _verdict(bad), {"sd": c("sd"), "ratio": c("spread"), "variance_share": c("share")}, "dev", c("column"))


def events_per_variable(spec: ModelSpec) -> DataFrame:
    """MB-C15: minority-class rows per feature in training."""
    df = spec.sets["train"]
    k = max(1, len(spec.features_in(df)))
    s = df.where(c(spec.label).isNotNull()).groupBy(spec.label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("lo"))
    epv = c("lo") / F.lit(k)
    return finding(s, "MB-C15", _verdict(epv < LIMITS["epv"]), {"events": c("lo"), "features": F.lit(k), "epv": epv}, "train")


# ------------------------------------------------------------------ evaluation of recorded scores
def _scored(spec: ModelSpec, role: str = "test") -> DataFrame:
    df = spec.sets[role]
    return df.where(c(spec.label).isNotNull()).select((c(spec.label).cast("string") == str(spec.positive)).cast("long").alias("y"), num(spec.score).alias("s")).dropna()


def roc_pr(df: DataFrame, score: str = "s", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC and average precision from the ordered score table (no score bins)."""
    t = cumulate(df, score, {"n": F.count(F.lit(1)), "pos": F.sum(label)}, by)
    neg, below = c("n") - c("pos"), c("cum_n") - c("cum_pos")
    at_or_above = c("tot_n") - c("cum_n")
    tp = c("tot_pos") - c("cum_pos")
    return t.groupBy(*by).agg(F.sum(c("pos").cast("double") * (below + neg / 2)).alias("u"), F.max("tot_pos").alias("n_pos"), F.max("tot_n").alias("n"),
                              F.sum(c("pos").cast("double") * tp / at_or_above).alias("ap")).select(
        *by, "n", "n_pos", ratio(c("u"), c("n_pos").cast("double") * (c("n") - c("n_pos"))).alias("roc_auc"), ratio(c("ap"), c("n_pos")).alias("pr_auc"),
        ratio(c("n_pos"), c("n")).alias("base_rate"))


def auc_power(n_pos: int, n_neg: int, ref: float = 0.7, alpha: float = 0.05) -> float:
    """Power to tell an AUC of ``ref`` from one half, both with their variance after Hanley and McNeil (1982)."""
    if min(n_pos, n_neg) < 2:
        return 0.0

    def sd(auc: float) -> float:
        above_two_negatives, below_two_positives = auc / (2 - auc) - auc ** 2, 2 * auc ** 2 / (1 + auc) - auc ** 2      # covariances of pairs that share one case
        return math.sqrt((auc * (1 - auc) + (n_pos - 1) * above_two_negatives + (n_neg - 1) * below_two_positives) / n_pos / n_neg)

    critical = float(D.norm_ppf(np.array([1 - alpha / 2]))[0]) * sd(0.5)
    return float(D.norm_sf((critical - abs(ref - 0.5)) / sd(ref)))


def metric_pair(spec: ModelSpec, role: str = "test") -> DataFrame:
    """MB-C16: ROC and PR side by side; a rare positive class makes ROC alone misleading."""
    s = roc_pr(_scored(spec, role))
    r = s.first()
    pw = auc_power(r["n_pos"], r["n"] - r["n_pos"])
    return finding(s, "MB-C16", _verdict(c("base_rate") < 0.2), {"roc_auc": c("roc_auc"), "pr_auc": c("pr_auc"), "base_rate": c("base_rate"),
                                                                   "n_positive": c("n_pos"), "power": F.lit(pw)}, role)


def class_recall(spec: ModelSpec, role: str = "test") -> DataFrame:
    """MB-C18 / C20: recall of both classes at the threshold."""
    hit = (c("s") >= spec.threshold).cast("long")
    s = _scored(spec, role).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg((hit == c("y")).cast("double")).alias("recall"))
    return finding(s, "MB-C18", _verdict(c("recall") < 0.5), {"n": c("n"), "recall": c("recall")}, role, c("y"))


def calibration_bins(df: DataFrame, prob: str = "s", label: str = "y", bins: int = LIMITS["ece_bins"]) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(c(prob) * bins).cast("int")))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("confidence"), F.avg(label).alias("actual"))


def calibration_error(df: DataFrame, prob: str = "s", label: str = "y", bins: int = LIMITS["ece_bins"]) -> DataFrame:
    g = calibration_bins(df, prob, label, bins)
    gap = F.abs(c("confidence") - c("actual"))
    return g.agg((F.sum(c("n") * gap) / F.sum("n")).alias("ece"), F.max(F.when(c("n") >= 10, gap)).alias("worst_gap"), F.sum("n").alias("n"))


def calibration(spec: ModelSpec, role: str = "test") -> DataFrame:
    """MB-C19."""
    s = calibration_error(_scored(spec, role))
    return finding(s, "MB-C19", _verdict(c("ece") > 0.1), {"ece": c("ece"), "worst_gap": c("worst_gap"), "n": c("n")}, role)


def fold_scores(folds: DataFrame, score: str = "score") -> DataFrame:
    """MB-C22: mean, spread and worst over recorded fold scores."""
    s = folds.agg(F.count(num(score)).alias("k"), F.avg(num(score)).alias("m"), F.stddev_samp(num(score)).alias("sd"), F.min(num(score)).alias("worst"))
    return finding(s, "MB-C22", F.when(c("k") < 2, "skipped").otherwise("pass"), {"folds": c("k"), "mean": c("m"), "sd": c("sd"), "worst": c("worst")}, "folds")


# ------------------------------------------------------------------ model-family specifics
def separation(spec: ModelSpec) -> DataFrame:
    """MB-C28: value ranges of the two classes that do not (complete) or barely (quasi) overlap."""
    df = spec.dev()
    feats = _numeric(df, spec.features_in(df))
    y = c(spec.label).cast("string") == str(spec.positive)
    long = df.where(c(spec.label).isNotNull()).select(y.alias("_y"), F.explode(F.array(*[F.struct(F.lit(v).alias("column"), num(v).alias("v")) for v in feats])).alias("r")) \
             .select("_y", "r.*").where("v is not null")
    a, b = F.when(c("_y"), c("v")), F.when(~c("_y"), c("v"))
    s = long.groupBy("column").agg(F.min(a).alias("la"), F.max(a).alias("ha"), F.min(b).alias("lb"), F.max(b).alias("hb"), F.count(a).alias("na"), F.count(b).alias("nb"),
                                   (F.max("v") - F.min("v")).alias("span")).where("na >= 2 and nb >= 2")
    over = F.least("ha", "hb") - F.greatest("la", "lb")
    share = over / F.greatest(c("span"), F.lit(1e-12))
    kind = F.when(over <= 0, 2).when(share < LIMITS["separation"], 1).otherwise(0)
    return finding(s, "MB-C28", _verdict(kind > 0), {"kind": kind, "overlap": F.greatest(F.lit(0.0), share)}, "dev", c("column"))


def collinear(spec: ModelSpec) -> DataFrame:
    """MB-C29: variance inflation above 5."""
    from statweave.operators.checks import collinearity
    df = spec.dev()
    s = collinearity(df, _numeric(df, spec.features_in(df)), LIMITS["vif"])
    return finding(s, "MB-C29", _verdict(c("verdict") == "violated"), {"vif": c("numbers")["vif"]}, "dev", c("group"))


def correlated_pairs(spec: ModelSpec) -> DataFrame:
    """MB-C31: feature pairs with |r| of .7 or more."""
    df = spec.dev()
    feats = _numeric(df, spec.features_in(df))
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    row = df.agg(*[F.corr(num(a), num(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    t = row.select(F.explode(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("column"), c(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
    return finding(t, "MB-C31", _verdict(F.abs("r") >= LIMITS["pair_r"]), {"r": c("r")}, "dev", c("column"))


def report(spec: ModelSpec) -> DataFrame:
    """Every applicable audit; one that cannot run leaves a ``skipped`` row instead of stopping."""
    steps = {"MB-C06": split_ratio, "MB-C08": class_balance, "MB-C13": label_levels, "MB-C10": scale_spread, "MB-C15": events_per_variable}
    if "train" in spec.sets:
        steps["MB-C05"] = label_proxy
        if {"test", "external"} & set(spec.sets):
            steps["MB-C01"] = duplicate_audit
            if spec.time:
                steps["MB-C03"] = time_overlap
        if spec.group and len(spec.sets) > 1:
            steps["MB-C02"] = group_crossing
    if spec.positive:
        steps |= {"MB-C28": separation}
    steps |= {"MB-C29": collinear, "MB-C31": correlated_pairs}
    if spec.score and spec.positive and "test" in spec.sets:
        steps |= {"MB-C16": metric_pair, "MB-C18": class_recall, "MB-C19": calibration}
    parts = []
    spark = next(iter(spec.sets.values())).sparkSession
    for name, fn in steps.items():
        try:
            parts.append(fn(spec))
        except (ValueError, KeyError, TypeError) as e:
            parts.append(finding(spark.range(1), name, F.lit("skipped"), {"n": F.lit(0)}, None, str(e)[:200]))
    return _all(parts)
