"""One door to every test: label maps, the test overall and per stratum, direction flips."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from statweave.operators import (association as A, composition as C, group_tests as G, interaction as I, rank_tests as R,
                                 regression as L, repeated as W, survival as S, table_tests as T)
from statweave.plans.common import num
from statweave.spec import Spec

def _paired(fn):
    return lambda df, s, by: fn(df, s.y, s.group, s.subject, s.levels, by, s.direction)


def _surv(fn, **kw):
    return lambda df, s, by: fn(df, s.y, s.group, s.event, by, **kw)


def _comp(fn):
    return lambda df, s, by: fn(df, s.y, s.group, list(s.members), s.levels, by, s.direction)


Runner = Callable[[DataFrame, Spec, list[str]], DataFrame]


def _two(fn) -> Runner:
    return lambda df, s, by: fn(df, s.y, s.group, s.levels, by=by, alternative=s.direction)


def _plain(fn) -> Runner:
    return lambda df, s, by: fn(df, s.y, s.group, by=by, alternative=s.direction)


def _weighted(fn) -> Runner:
    return lambda df, s, by: fn(df, s.y, s.group, s.weights, s.levels, by, s.direction)


RUNNERS: dict[str, Runner] = {
    "T-101": _two(G.welch_t), "T-102": _two(G.student_t), "T-103": _two(R.mann_whitney),
    "T-104": _two(R.brunner_munzel), "T-121": _plain(G.anova), "T-122": _plain(G.alexander_govern),
    "T-123": _two(R.kruskal), "T-201": _plain(T.chi_square), "T-202": _plain(T.fisher_exact),
    "T-203": _plain(T.g_test), "T-211": _plain(T.mcnemar), "T-221": _plain(T.two_proportions),
    "T-301": _plain(A.pearson), "T-302": _plain(A.spearman), "T-303": _plain(A.kendall),
    "T-304": lambda df, s, by: A.distance_correlation(df, s.y, s.group, by=by),
    "T-305": _plain(A.bicor), "T-321": _plain(A.proportionality),
    "T-501": _two(R.jonckheere), "T-502": _two(T.cochran_armitage),
    "T-504": _plain(A.trend_ols),
    "T-601": lambda df, s, by: A.icc(df, s.y, s.group, by=by, key=s.options.get("key", ())),
    "T-602": _plain(A.bland_altman),
    "T-603": lambda df, s, by: A.lins_ccc(df, s.y, s.group, by=by, key=s.options.get("key", ())),
    "T-604": _plain(T.cohen_kappa), "T-605": _plain(T.fleiss_kappa),
    "T-701": _two(R.ks_two_sample), "T-704": _two(R.cramer_von_mises),
    "T-1006": _plain(T.marginal_vs_conditional), "T-1101": _weighted(G.planned_contrast),
    "T-1104": _weighted(R.pooled_contrast),
    "T-1103": lambda df, s, by: G.helmert(df, s.y, s.group, s.levels, by, s.direction),
    "T-105": lambda df, s, by: G.permutation_t(df, s.y, s.group, s.options.get("key", ()), s.levels, s.direction),
    "T-124": lambda df, s, by: G.permutation_f(df, s.y, s.group),
    "T-111": _paired(W.paired_t), "T-112": _paired(W.wilcoxon), "T-113": _paired(W.sign_test),
    "T-131": _paired(W.rm_anova), "T-132": _paired(W.friedman), "T-133": _paired(W.mixed_repeated), "T-212": _paired(W.cochran_q),
    "T-311": lambda df, s, by: A.partial_correlation(df, s.y, s.group, s.by, alternative=s.direction),
    "T-401": lambda df, s, by: I.two_way_anova(df, s.y, s.group, s.by),
    "T-402": lambda df, s, by: I.aligned_rank_anova(df, s.y, s.group, s.by),
    "T-403": lambda df, s, by: L.interaction_regression(df, s.y, s.group, s.by),
    "T-404": lambda df, s, by: W.mixed_interaction(df, s.y, s.group, s.by, s.subject),
    "T-503": lambda df, s, by: A.mann_kendall(df, s.y, s.group, s.direction),
    "T-702": lambda df, s, by: R.anderson_darling(df, s.y, s.group, s.levels, by, permutations=s.options.get("permutations", 0)),
    "T-703": lambda df, s, by: R.energy_distance(df, s.y, s.group, s.levels, by, permutations=s.options.get("permutations", 999)),
    "T-801": _plain(L.logistic), "T-802": _plain(L.ols), "T-803": _plain(L.poisson), "T-804": _plain(L.ordinal), "T-805": _plain(L.beta_regression),
    "T-806": lambda df, s, by: L.huber(df, s.y, s.group),
    "T-807": lambda df, s, by: S.cox(df, s.y, s.group, s.event, by), "T-904": lambda df, s, by: S.cox(df, s.y, s.group, s.event, by, test_id="T-904"),
    "T-901": _surv(S.logrank), "T-902": _surv(S.gehan), "T-903": _surv(S.rmst),
    "T-1001": _comp(C.clr_compare), "T-1002": _comp(C.alr_compare), "T-1004": _comp(C.bias_corrected), "T-1005": _plain(C.proportionality_of_parts),
    "T-1003": lambda df, s, by: C.dirichlet_compare(df, s.y, s.group, list(s.members), s.options["key"], s.levels, s.direction),
    "T-1102": lambda df, s, by: G.dunnett(df, s.y, s.group, s.control, s.levels, by, s.direction),
}
#: tests whose ``by`` is part of the design, not a stratum
DESIGN_BY = {"T-311", "T-401", "T-402", "T-403", "T-404"}
#: tests that run once over the whole table (relabelling, robust and exact-slope fits)
WHOLE_TABLE = {"T-105", "T-124", "T-503", "T-806", "T-1003"}


def null_value(effect_name: Column) -> Column:
    """The effect that means "no difference": 1 for ratios, .5 for P(X>Y), else 0."""
    key = F.split(effect_name, " \\(")[0]
    return F.when(key.isin("OR", "IRR", "HR"), 1.0).when(key == "P(X>Y)", 0.5).otherwise(0.0)


def run_test(df: DataFrame, spec: Spec, test_id: str, label_maps: dict[str, dict] | None = None) -> DataFrame:
    """Outcome rows: ``overall`` first, then one per level of ``spec.by`` with ``flipped`` set
    where the stratum's effect lies on the other side of "no difference"."""
    from statweave.operators.labels import apply_label_maps
    if test_id not in RUNNERS:
        raise ValueError(f"test {test_id!r} is not available; known: {sorted(RUNNERS)}")
    if label_maps:
        df = apply_label_maps(df, {k: v for k, v in label_maps.items() if k in (spec.y, spec.group)})
    fn = RUNNERS[test_id]
    overall = fn(df, spec, [])
    extra = [c for c in overall.columns if c in ("comparison", "contrast")]
    overall = overall.withColumn("stratum", F.lit("overall"))
    if spec.by and test_id not in DESIGN_BY | WHOLE_TABLE:
        strata = fn(df.where(F.col(spec.by).isNotNull()), spec, [spec.by]) \
            .withColumn("stratum", F.col(spec.by).cast("string")).drop(spec.by)
        overall = overall.unionByName(strata)
    base = (overall.where("stratum = 'overall'")
            .select(*[F.col(c).alias(f"_{c}") for c in extra], F.col("effect.value").alias("_base")))
    ref = null_value(F.col("effect.name"))
    joined = overall.join(F.broadcast(base), [F.col(c) == F.col(f"_{c}") for c in extra] or F.lit(True), "left")
    gap = (F.col("effect.value") - ref) * (F.col("_base") - ref)
    return (joined.withColumn("flipped", F.coalesce(gap < 0, F.lit(False)))
            .withColumn("alpha", F.lit(0.05 / max(1, spec.n_tests)))
            .drop("_base", *[f"_{c}" for c in extra]))


def complete_cases(df: DataFrame, spec: Spec) -> DataFrame:
    """How many rows the test can use out of all."""
    used = [c for c in (spec.y, spec.group, spec.event, spec.by) if c]
    ok = F.lit(True)
    for col in used:
        v = num(col) if dict(df.dtypes)[col] in ("double", "float") else F.col(col)
        ok = ok & v.isNotNull()
    return df.agg(F.sum(ok.cast("long")).alias("used"), F.count(F.lit(1)).alias("total"))
