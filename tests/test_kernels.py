"""Plan kernels against brute force, on one bucket and on many."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statweave.operators import association as A, rank_tests as R
from statweave.operators.metrics import mmd, quantile_normalise, spacing_entropy
from statweave.operators.survival import concordance_index
from statweave.plans.cumulate import column_quantiles, cumulate, quantiles, ranked
from statweave.plans import dominance
from statweave.plans.dominance import concordance, pair_sums
from statweave.plans.neighbours import knn, knn_forest, knn_recall, nan_knn_mean
from statweave.plans.resample import _at_bucket, bootstrap_sums, level_sums, permuted


def test_cumulate_many_buckets(spark, table, buckets):
    pdf, df = table
    got = cumulate(df, "tied", {"n": F.count(F.lit(1))}, ["arm"], lead=True).toPandas().sort_values(["arm", "tied"])
    for arm, g in got.groupby("arm"):
        v = np.sort(pdf.loc[pdf.arm == arm, "tied"])
        assert list(g.n) == [int((v == u).sum()) for u in np.unique(v)]
        assert list(g.cum_n) == [int((v < u).sum()) for u in np.unique(v)]
        assert set(g.tot_n) == {len(v)}
        assert list(g.next_value)[:-1] == list(np.unique(v))[1:]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_rank_statistics_do_not_depend_on_layout(spark, table, buckets, parts):
    pdf, df = table
    d = df.repartition(parts)
    one = {}
    for name, fn in (("u", lambda q: R.mann_whitney(q, "tied", "arm")), ("bm", lambda q: R.brunner_munzel(q, "tied", "arm")), ("kw", lambda q: R.kruskal(q, "y", "dose")),
                     ("ks", lambda q: R.ks_two_sample(q, "y", "arm")), ("e", lambda q: R.energy_distance(q, "y", "arm")), ("cvm", lambda q: R.cramer_von_mises(q, "tied", "arm")),
                     ("ad", lambda q: R.anderson_darling(q, "tied", "dose")), ("jt", lambda q: R.jonckheere(q, "y", "dose"))):
        one[name] = fn(d).first()["statistic"]
    spark.conf.unset("statweave.rowsPerBucket")
    a, b = (pdf.loc[pdf.arm == v, "tied"].to_numpy() for v in "AB")
    u = (a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()
    assert one["u"] == pytest.approx(u)
    assert one["kw"] == pytest.approx(R.kruskal(df, "y", "dose").first()["statistic"])
    assert one["ad"] == pytest.approx(R.anderson_darling(df, "tied", "dose").first()["statistic"])
    ya, yb = (np.sort(pdf.loc[pdf.arm == v, "y"]) for v in "AB")
    grid = np.concatenate([ya, yb])
    gap = np.searchsorted(ya, grid, "right") / len(ya) - np.searchsorted(yb, grid, "right") / len(yb)
    assert one["ks"] == pytest.approx(np.abs(gap).max())
    cross = np.abs(ya[:, None] - yb).mean() * 2 - np.abs(ya[:, None] - ya).mean() - np.abs(yb[:, None] - yb).mean()
    assert one["e"] == pytest.approx(np.sqrt(cross))


def test_ranked_average_ties(spark, table, buckets):
    pdf, df = table
    got = ranked(df, "tied", "r").select("id", "r").toPandas().set_index("id").r
    assert np.allclose(got.sort_index(), pdf.tied.rank())


def test_concordance_brute_force(spark, table, buckets):
    pdf, df = table
    got = concordance(df, "dose", "tied").first()
    s = np.sign(pdf.dose.to_numpy()[:, None] - pdf.dose.to_numpy()) * np.sign(pdf.tied.to_numpy()[:, None] - pdf.tied.to_numpy())
    assert (got["con"], got["dis"]) == ((s > 0).sum() / 2, (s < 0).sum() / 2)


@pytest.mark.parametrize("bits", [2, 13])
@pytest.mark.parametrize("bucket", ["1000000", "60"])
def test_pair_sums_brute_force(spark, monkeypatch, bits, bucket):
    monkeypatch.setattr(dominance, "BITS", bits)                            # many levels
    monkeypatch.setattr(dominance, "STEP", 16)
    spark.conf.set("statweave.rowsPerBucket", bucket)                       # many buckets of y in the larger nodes
    r = np.random.default_rng(11)
    n = 700
    pdf = pd.DataFrame({"g": r.choice(["a", "b", "c"], n, p=[0.8, 0.19, 0.01]), "x": np.where(r.random(n) < 0.3, 7.5, r.integers(0, 90, n)),
                        "y": np.where(r.random(n) < 0.3, -2.0, r.integers(-20, 20, n) / 4)})
    df = spark.createDataFrame(pdf).withColumn("g", F.nullif("g", F.lit("b")))
    got = {row["g"]: row for row in pair_sums(df, "x", "y", {"n": F.col("n"), "u": F.col("n") * F.col("y")}, ["n", "u"], ["n"], ["g"]).collect()}
    spark.conf.unset("statweave.rowsPerBucket")
    assert got.keys() == {"a", None, "c"}
    for g, p in pdf.groupby("g"):
        x, y = p.x.to_numpy(), p.y.to_numpy()
        right = x[:, None] < x
        for name, l in (("n", np.ones(len(p))), ("u", y)):
            for kind, m in (("below", y[:, None] < y), ("tie", y[:, None] == y), ("all", True)):
                assert got[None if g == "b" else g][f"{kind}_{name}_n"] == (l[:, None] * (right & m)).sum()


def test_concordance_moves_points_once_per_level(spark):
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    n = 40_000
    points = spark.range(n).select(F.rand(3).alias("x"), F.rand(4).alias("y"), F.lit(1).alias("n")).localCheckpoint()
    before = moved()
    row = concordance(points, "x", "y").first()
    assert row["con"] + row["dis"] == n * (n - 1) / 2
    assert moved() - before < 250 * n


def test_concordance_index_brute_force(spark, table, buckets):
    pdf, df = table
    t, d, v = (pdf[k].to_numpy() for k in ("time", "event", "tied"))
    later = (d[:, None] == 1) & ((t > t[:, None]) | ((t == t[:, None]) & (d == 0)))
    got = concordance_index(df, "time", "tied", "event").first()
    assert got["usable"] == later.sum()
    assert got["c_index"] == pytest.approx(((later & (v[:, None] > v)).sum() + (later & (v[:, None] == v)).sum() / 2) / later.sum(), abs=1e-12)


def test_distance_correlation_brute_force(spark, table, buckets):
    pdf, df = table
    x, y = pdf.x.to_numpy(), pdf.tied.to_numpy()
    cen = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    a, b = cen(np.abs(x[:, None] - x)), cen(np.abs(y[:, None] - y))
    want = np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))
    got = A.distance_correlation(df, "tied", "x").first()
    assert got["statistic"] == pytest.approx(want)
    assert got["p"] < 1e-6


@pytest.mark.parametrize("n", [500, 30_000])
def test_quantiles_exact(spark, n, buckets):
    r = np.random.default_rng(3)
    v = np.where(r.random(n) < 0.34, 2.5, r.lognormal(size=n))             # a third of the rows share one value
    df = spark.createDataFrame(pd.DataFrame({"v": v, "g": (np.arange(n) % 3).astype("int64")}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    n_got, q = column_quantiles(df, {"v": F.col("v")}, probs)["v"]
    assert n_got == n and np.allclose(q, np.quantile(v, probs))
    by = quantiles(df, "v", probs, ["g"]).toPandas().set_index("g")
    for g in range(3):
        assert np.allclose(by.loc[g, [f"q{i}" for i in range(len(probs))]].astype(float), np.quantile(v[np.arange(n) % 3 == g], probs))


def test_knn_exact_with_many_blocks(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 4))
    v[100:200] = v[100] + r.normal(size=(100, 4)) * 1e-3                    # a dense clump
    df = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(v)], "id long, v array<double>")
    got = knn(df, "id", "v", 4, block=32).toPandas()
    d = np.sqrt(((v[:, None] - v) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(300):
        want = np.lexsort((np.arange(300), d[i]))[:4]
        assert list(got[got.qid == i].sort_values("rank").did) == list(want)


def test_nan_knn_mean(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(80, 3))
    x[r.random((80, 3)) < 0.2] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(a) else float(a) for a in row]) for i, row in enumerate(x)], "id long, a double, b double, c double")
    got = nan_knn_mean(df, "id", ["a", "b", "c"], 5, block=16).toPandas().set_index("id")
    for i in range(80):
        for j, col in enumerate("abc"):
            if not np.isnan(x[i, j]):
                continue
            both = ~np.isnan(x) & ~np.isnan(x[i])
            with np.errstate(invalid="ignore", divide="ignore"):
                d = np.sqrt(np.nansum(np.where(both, (x - x[i]) ** 2, 0), axis=1) * 3 / both.sum(1))
            ok = ~np.isnan(x[:, j]) & np.isfinite(d) & (np.arange(80) != i)
            near = np.where(ok)[0][np.argsort(d[ok], kind="stable")[:5]]
            if len(near):
                assert got.loc[i, f"_f_{col}"] == pytest.approx(x[near, j].mean())


def test_mmd_block_sum(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(90, 3))
    g = np.arange(90) % 2
    v[g == 1] += 0.7
    df = spark.createDataFrame([(i, str(g[i]), [float(a) for a in v[i]]) for i in range(90)], "id long, g string, v array<double>")
    k = np.exp(-0.5 * ((v[:, None] - v) ** 2).sum(-1))
    want = k[g == 0][:, g == 0].mean() + k[g == 1][:, g == 1].mean() - 2 * k[g == 0][:, g == 1].mean()
    assert mmd(df, "v", "g", ["0", "1"], 0.5, key="id", block=20).first()[0] == pytest.approx(want)
    assert mmd(df, "v", "g", ["0", "1"], 0.5, key="id", block=7).first()[0] == pytest.approx(want)
    assert mmd(df, "v", "g", ["0", "1"], 0.5, key="id").first()[0] == pytest.approx(want)
    assert mmd(df, "v", "g", ["0", "1"], 0.5, features=4000).first()[0] == pytest.approx(want, abs=0.05)


def test_quantile_normalise_gives_one_distribution(spark, table):
    _, df = table
    got = quantile_normalise(df, "id", ["x", "y"]).toPandas()
    assert np.allclose(np.sort(got.x), np.sort(got.y))


def test_spacing_entropy_of_a_uniform_is_near_zero(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"v": r.random(5000)}))
    assert abs(spacing_entropy(df, "v").first()["entropy"]) < 0.1


@pytest.mark.parametrize("parts", [1, 7])
def test_bootstrap_is_seeded_and_layout_free(spark, table, parts):
    pdf, df = table
    b = bootstrap_sums(df.repartition(parts), ["id"], ["y"], 200).toPandas().sort_values("b")
    ref = bootstrap_sums(df, ["id"], ["y"], 200).toPandas().sort_values("b")
    assert np.allclose(b.s_y, ref.s_y)
    m = b.s_y / b.w
    assert m.mean() == pytest.approx(pdf.y.mean(), abs=0.03)
    assert m.std() == pytest.approx(pdf.y.std() / 20, rel=0.25)


@pytest.mark.parametrize("value", ["y", "tied"])
def test_relabellings_keep_level_sizes_and_have_the_exact_moments(spark, table, value):
    pdf, df = table
    t = cumulate(df, value, {"n": F.count(F.lit(1))}, lead=True)
    sizes = pdf.groupby("dose").size().tolist()
    n = permuted(t, value, {(): sizes}, 60, lambda part, before, k, total: k.sum(axis=0), ["s0", "s1", "s2"], rows=30).toPandas()
    assert len(n) == 60 and (n[["s0", "s1", "s2"]].to_numpy() == sizes).all()
    sums = permuted(t, value, {(): sizes}, 3000, level_sums, ["s0", "s1", "s2"], rows=30).toPandas().sort_values("_rep")
    x, big = pdf[value].to_numpy(float), len(pdf)
    assert np.allclose(sums[["s0", "s1", "s2"]].sum(axis=1), x.sum())
    for col, m in zip(["s0", "s1", "s2"], sizes):
        var = m * (big - m) / (big - 1) * x.var()
        assert abs(sums[col].mean() - m * x.mean()) < 5 * np.sqrt(var / 3000) and sums[col].var() == pytest.approx(var, rel=0.15)
    again = permuted(cumulate(df.repartition(3), value, {"n": F.count(F.lit(1))}, lead=True), value, {(): sizes}, 3000, level_sums, ["s0", "s1", "s2"], rows=30).toPandas().sort_values("_rep")
    assert np.allclose(sums[["s0", "s1", "s2"]], again[["s0", "s1", "s2"]])


def test_bucket_counts_decide_replicates_far_from_the_statistic(spark, monkeypatch):
    """Bounds from label counts per bucket enclose the statistic; where they settle the p-value no value is dealt labels."""
    rng = np.random.default_rng(3)
    x = np.sort(np.round(rng.normal(size=600), 1))
    deal = np.stack([rng.permutation(np.repeat([0, 1], [250, 350])) for _ in range(40)])
    edges = np.unique(np.searchsorted(x, x[::50]))                 # buckets begin where a value does
    counts = np.stack([np.add.reduceat(deal == g, edges, axis=1) for g in (0, 1)], axis=2).transpose(1, 0, 2)
    low, high = R._energy_bounds(counts, x[edges], np.append(x[edges[1:] - 1], x[-1]), np.array([250.0, 350.0]))
    at = np.append(np.flatnonzero(np.diff(x)), len(x) - 1)
    gap = np.cumsum(deal == 0, axis=1)[:, at] / 250 - np.cumsum(deal == 1, axis=1)[:, at] / 350
    true = np.sqrt(2 * (gap[:, :-1] ** 2 * np.diff(x[at])).sum(axis=1))
    assert (low <= true + 1e-12).all() and (true <= high + 1e-12).all() and high.max() < 0.5

    df = spark.createDataFrame([(float(v) + 9 * (i % 2), "ab"[i % 2]) for i, v in enumerate(rng.normal(size=3000))], "y double, g string")
    monkeypatch.setattr(R, "_energy_terms", lambda *a: 1 / 0)
    assert R.energy_distance(df, "y", "g", permutations=99).first()["p"] == 0.01


def test_dealt_labels_are_exact_with_and_without_ties():
    from statweave.plans.resample import _dealt
    rng, left = np.random.default_rng(2), np.repeat([[30, 0, 50]], 4000, axis=0)
    k = _dealt(rng, left, np.array([1, 40, 3, 1, 35]))
    assert (k.sum(axis=0) == left).all() and (k.sum(axis=2) == np.array([1, 40, 3, 1, 35])[:, None]).all() and (k >= 0).all()
    assert np.allclose(k[..., 0].mean(axis=1), np.array([1, 40, 3, 1, 35]) * 30 / 80, atol=0.15)
    assert k[1, :, 0].var() == pytest.approx(40 * 30 / 80 * 50 / 80 * 40 / 79, rel=0.12) and k[2, :, 0].var() == pytest.approx(3 * 30 / 80 * 50 / 80 * 77 / 79, rel=0.12)


def test_splitting_tree_deals_every_bucket_its_rows():
    counts, sizes = np.array([5, 1, 40, 7, 900]), np.array([300, 3, 650])
    parts = [_at_bucket(counts, i, sizes, 50, [9]) for i in range(5)]
    assert all((here.sum(axis=1) == n).all() for (_, here), n in zip(parts, counts)) and (sum(here for _, here in parts) == sizes).all()
    assert all((parts[i + 1][0] == parts[i][0] + parts[i][1]).all() for i in range(4)) and (parts[0][0] == 0).all()
    big = _at_bucket(np.array([3, 4]) * 10 ** 9, 0, np.array([2, 5]) * 10 ** 9, 200, [1])[1]
    assert (big.sum(axis=1) == 3 * 10 ** 9).all() and abs(big[:, 0].mean() / (6 / 7 * 10 ** 9) - 1) < 1e-4


def test_forest_of_hyperplanes_finds_the_nearest(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 2
    x = np.concatenate([centres[rng.integers(0, 40, 2400)] + rng.normal(size=(2400, 16)) * 0.6, np.ones((500, 16)), rng.normal(size=(100, 16))])     # a third are clusters' edges and copies
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9_000, None), (None, [0.0] * 16)], "id long, v array<double>").repartition(4)
    got = knn_forest(df, "id", "v", 5, trees=10, leaf=150, task_rows=300, sample=1000)
    one = got.toPandas().sort_values(["qid", "rank"])
    again = knn_forest(df.repartition(3), "id", "v", 5, trees=10, leaf=150, task_rows=300, sample=1000).toPandas().sort_values(["qid", "rank"])
    assert one.reset_index(drop=True).equals(again.reset_index(drop=True)) and set(one.groupby("qid").size()) == {5}
    assert np.allclose(one.dist, np.sqrt(((x[one.qid] - x[one.did]) ** 2).sum(1))) and (one.qid != one.did).all()
    r = knn_recall(df, "id", "v", got, 5, df.where("id % 20 = 0")).first()
    assert r["queries"] == 150 and r["recall"] >= 0.9
    small = df.where("id < 140")
    exact = knn(small, "id", "v", 5).toPandas().sort_values(["qid", "rank"])[["qid", "did"]].to_numpy()
    assert (knn_forest(small, "id", "v", 5, leaf=150).toPandas().sort_values(["qid", "rank"])[["qid", "did"]].to_numpy() == exact).all()


def test_forest_grows_its_leaves_until_the_recall_is_reached(spark):
    """Points on a sphere without structure: small leaves miss most neighbours."""
    x = np.random.default_rng(4).normal(size=(1500, 32))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "id long, v array<double>").repartition(3)
    few = knn_recall(df, "id", "v", knn_forest(df, "id", "v", 5, leaf=60, recall=0), 5, df.where("id % 5 = 0")).first()
    for task_rows in (400, 32_768):                                # the largest leaf of a task is not enough; it is
        r = knn_recall(df, "id", "v", knn_forest(df, "id", "v", 5, leaf=60, task_rows=task_rows), 5, df.where("id % 5 = 0")).first()
        assert r["queries"] == 300 and r["recall"] >= 0.9 > few["recall"]


def test_forest_draws_its_sample_without_ordering_candidates_on_the_driver(spark):
    from statweave.plans.neighbours import _drawn, _with_vectors
    df = spark.range(20_000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    some = _drawn(df, 20_000, 1000, 0)
    x, ids = _with_vectors(some)
    assert 850 < len(ids) < 1150 and (x[:, 0] == ids).all() and (ids == _with_vectors(_drawn(df.repartition(7), 20_000, 1000, 0))[1]).all()
    assert "TakeOrdered" not in some._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ["ks", "wasserstein", "tv"])
def test_subsample_distances_of_all_rows_but_one(spark, metric):
    """With one row left out each distance is one of a few known numbers, and all of them show."""
    from statweave.operators import represent as P
    x = np.array([1.0, 1.0, 1.0, 2.0, 2.0, 4.0, 7.0, 7.0, 7.0, 11.0])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
    grid = np.unique(x)
    ecdf = lambda s: np.searchsorted(np.sort(s), grid, side="right") / len(s)
    want = set()
    for i in range(len(x)):
        gap = np.abs(ecdf(np.delete(x, i)) - ecdf(x))
        share = np.array([(np.delete(x, i) == g).mean() - (x == g).mean() for g in grid])
        want.add(round({"ks": gap.max(), "wasserstein": float(np.sum(gap[:-1] * np.diff(grid))), "tv": np.abs(share).sum() / 2}[metric], 9))
    got = P.distances(df, "v", 200, [3, 9, 10, 50], metric).toPandas()
    assert sorted(got.n.unique()) == [3, 9] and got.groupby("n").r.nunique().tolist() == [200, 200]
    assert set(got[got.n == 9].d.round(9)) == want and got[got.n == 3].d.mean() > got[got.n == 9].d.mean()
    assert P.distance_curve(df.where("v is null"), "v", metric=metric).count() == 0


def test_contingency_from_observed_cells(spark):
    from statweave.operators import table_tests as T
    rng = np.random.default_rng(6)
    rows = [("wide", f"a{rng.zipf(1.5) % 30}", f"b{rng.zipf(1.4) % 40}") for _ in range(400)] + [("two", "x", "p")] * 9 + [("two", "y", "q")] * 4 + [("two", "x", "q")] * 3 + [("hole", "x", "p")] * 5 + [("hole", "y", "q")] * 7 + [("hole", None, "q"), (None, "x", "p")]
    df = spark.createDataFrame(rows, "s string, y string, g string")
    got = {r["s"]: r for r in T._summary(df, "y", "g", ["s"]).collect()}
    assert set(got) == {"wide", "two", "hole"}
    for s, r in got.items():
        t = pd.crosstab(pd.Series([y for k, y, g in rows if k == s and y]), pd.Series([g for k, y, g in rows if k == s and y]))
        o = t.to_numpy(float)
        e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
        d = np.abs(o - e)
        assert r["pearson"] == pytest.approx((d ** 2 / e).sum()) and r["g"] == pytest.approx(2 * (o[o > 0] * np.log(o[o > 0] / e[o > 0])).sum())
        assert (r["r"], r["k"], r["n"], r["small"]) == (*o.shape, o.sum(), (e < 5).sum())
        assert r["gap"] == pytest.approx(np.abs(o / o.sum(0) - o.sum(1, keepdims=True) / o.sum()).max())
        if o.shape == (2, 2):
            assert r["yates"] == pytest.approx(((d - np.minimum(0.5, d)) ** 2 / e).sum()) and [r[v] for v in "abcd"] == o.ravel().tolist()
    one = T._summary(df.where("s = 'wide'"), "y", "g", []).first()
    assert one["pearson"] == pytest.approx(got["wide"]["pearson"]) and one["small"] == got["wide"]["small"]
    plan = T._summary(df, "y", "g", [])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("query", ["outlying", "aligned", "variability"])
def test_values_of_few_groups_come_to_the_rows(spark, buckets, query):
    """Two groups: no join may send the rows of a group to one task."""
    from statweave.operators import interaction, metrics, rowops
    df = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 'a', 'b') g", "if(id % 4 < 2, 'c', 'd') h", "cast((id * 7919) % 1999 as double) + if(id = 77, 90000, 0) v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from statweave.plans import common, cumulate
        seen = []
        for m in (cumulate, rowops, interaction, metrics):
            seen.append((m, m.beside))
            m.beside = lambda rows, groups, by, names=None: joined.append(common.beside(rows, groups, by, names)) or joined[-1]
        joined = []
        out = {"outlying": lambda: rowops.outlying_points(df, "v", "id", "g"), "aligned": lambda: interaction.aligned_rank_anova(df, "v", "g", "h"),
               "variability": lambda: metrics.variability(df, "v", ["g"])}[query]()
        out.collect()
        assert joined and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p.split("BroadcastHashJoin")[0] for p in (j._jdf.queryExecution().executedPlan().toString() for j in joined))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for m, f in seen:
            m.beside = f
    if query == "outlying":
        assert [r.key for r in out.collect()] == [77]
    if query == "variability":
        import numpy as np
        p = df.toPandas()
        for r in out.collect():
            v = p.v[p.g == r.g]
            assert np.isclose(r.mad, (v - v.median()).abs().median())


def test_more_groups_than_levels_are_joined_by_key(spark, monkeypatch):
    from statweave.plans import common
    monkeypatch.setattr(common, "MAX_LEVELS", 3)
    rows = spark.createDataFrame([(k, 1) for k in (None, *range(6))] * 2, "k int, x int")
    got = common.beside(rows, spark.createDataFrame([(None, 9), *[(k, 10 * k) for k in range(5)]], "q int, v int"), ["k"], ["q"])
    assert got.columns == ["k", "x", "v"] and sorted((r.k if r.k is not None else -1, r.v) for r in got.collect()) == sorted([(-1, 9), *[(k, 10 * k) for k in range(5)]] * 2)


def test_mmd_moves_each_pair_of_blocks_once(spark):
    """Vectors travel as stored, and only to the blocks from their own on: (blocks + 1) / 2 copies to the left and (blocks - 1) / 2 to the right, not twice the blocks."""
    from statweave.operators import metrics
    df = spark.range(600).selectExpr("id", "cast(id % 2 as string) g", "array(cast(id % 17 as float), cast(id % 5 as float)) v")
    plan = metrics.mmd(df, "v", "g", ["0", "1"], 0.5, key="id", block=60)
    node = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in node.split("FlatMapCoGroupsInPandas")[-1]
    assert node.count("sequence(blk") == 1 and node.count("sequence(0, (blk") == 1, node
    both = np.array([r.v for r in df.orderBy("id").collect()])
    k = np.exp(-0.5 * ((both[:, None] - both[None]) ** 2).sum(2))
    s = np.where(np.arange(600) % 2 == 0, 1, -1) / 300
    assert plan.first()[0] == pytest.approx(s @ k @ s, abs=1e-12)


def test_a_written_table_forgets_an_estimate_that_joins_multiply(spark):
    from statweave.plans.common import cut_lineage
    t = spark.range(20).select("id", F.col("id").alias("k"))
    for _ in range(12):
        t = cut_lineage(t.join(t.select(F.col("id").alias("i"), F.col("k").alias("j")), F.col("k") == F.col("i")).select("id", F.col("j").alias("k")))
    assert t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= 1 << 63
    assert sorted(map(tuple, t.collect())) == [(i, i) for i in range(20)] and t.dtypes == [("id", "bigint"), ("k", "bigint")]


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    from statweave.operators import neighbourhood as N
    r = np.random.default_rng(3)
    name = r.permutation(900)
    edges = [(int(name[i]), int(name[i + 1])) for i in range(599) if i != 250] + [(int(name[600]), int(name[i])) for i in range(601, 800)]      # two paths, a star, single vertices
    want = {}
    for part in (range(251), range(251, 600), range(600, 800), *[[i] for i in range(800, 900)]):
        want |= dict.fromkeys((int(name[i]) for i in part), int(min(name[i] for i in part)))
    written, plain = [], N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df: written.append(1) or plain(df))
    got = N.connected_components(spark.range(900).select("id"), spark.createDataFrame([*edges, edges[0], (5, 5)], "a long, b long"))
    assert {x["id"]: x["root"] for x in got.collect()} == want and len(written) <= 2 + 3 * 12


def test_exact_neighbours_of_copies_far_points_and_stored_precision(spark):
    """Every pair in one pass over written blocks: ties by id among many copies, values far from the origin, and very large ones, as brute force finds them."""
    r = np.random.default_rng(12)
    x = np.concatenate([r.normal(size=(150, 8)), np.ones((60, 8)) * 0.5, 1e6 + r.normal(size=(60, 8)), r.normal(size=(5, 8)) * 1e16]).astype(np.float32)
    ids = r.permutation(len(x)) * 3
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(ids, x)] + [(9_000, None), (None, [0.0] * 8), (9_001, [float("nan")] * 8)]
    d = np.sqrt(((x[:, None].astype(float) - x.astype(float)) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {int(ids[i]): [(int(ids[j]), float(d[i, j])) for j in np.lexsort((ids, d[i]))[:7]] for i in range(len(x))}
    for kind in ("float", "double"):
        for block in (40, None):
            got = knn(spark.createDataFrame(rows, f"id long, v array<{kind}>").repartition(3), "id", "v", 7, block=block).toPandas().sort_values(["qid", "rank"])
            assert {int(q): [*zip(g.did, g.dist)] for q, g in got.groupby("qid")} == want
    assert knn(spark.createDataFrame(rows[:1], "id long, v array<float>"), "id", "v", 7).count() == 0 == knn(spark.createDataFrame([], "id long, v array<float>"), "id", "v", 7).count()


def test_neighbours_move_as_points_and_lists_only(spark, monkeypatch):
    """Without structure every leaf would hold the table: the exact join answers, nothing is dealt to trees and no block is copied."""
    from statweave.plans import neighbours as P
    x = np.random.default_rng(4).normal(size=(3000, 48)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<float>").repartition(3)
    moved, plain = [], P._blocks
    monkeypatch.setattr(P, "_blocks", lambda *a: moved.append(plain(*a)) or moved[-1])
    found = knn_forest(df, "id", "v", 5, leaf=60, task_rows=400)
    assert found.count() == 15_000 and len(moved) == 1 and sum(len(r["v"]) for r in moved[0].collect()) == 3000 * 48 * 4
    assert knn_recall(df, "id", "v", found, 5, df.where("id % 30 = 0")).first()["recall"] == 1


def test_forest_learns_its_leaves_from_a_sample(spark, monkeypatch):
    """Clusters: small leaves reach the recall, so the forest answers and not all pairs."""
    from statweave.plans import neighbours as P
    r = np.random.default_rng(8)
    x = (r.normal(size=(200, 16)) * 5)[r.integers(0, 200, 6000)] + r.normal(size=(6000, 16)) * 0.1
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(3)
    src = P._vectors(df, "id", "v")
    assert P._leaf_for(src, 6000, 5, 64, 400, 12, 0.9, 256, 65_536, 0) in (64, 128) and P._leaf_for(src, 6000, 5, 64, 400, 12, 0.9, 256, 2000, 0) in (64, 128, 256)
    monkeypatch.setattr(P, "knn", lambda *a, **k: 1 / 0)
    found = knn_forest(df, "id", "v", 5, leaf=64, task_rows=1000)
    assert knn_recall(df, "id", "v", found, 5, df.where("id % 30 = 0")).first()["recall"] >= 0.9
