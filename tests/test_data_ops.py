"""Sources, row edits, missing data, profiling, comparison, guardrails and audits on planted data."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statweave.operators import audit as U, compat, diff, explore, guard, labels, metrics, missing, multiple, profile, robust, rowops
from statweave.operators.run import run_test
from statweave.plans.common import natural_key
from statweave.sources import tables as S
from statweave.spec import Spec

c = F.col


def test_read_write_round_trip(spark, table, tmp_path):
    _, df = table
    small = df.select("id", "arm", "y")
    for name in ("out.parquet", "out.csv", "out.tsv"):
        p = str(tmp_path / name)
        S.export(small, p, provenance={"ops": [1, 2]})
        back = S.read_table(spark, p, ["id", "arm", "y"])
        assert back.count() == 400
        with pytest.raises(Exception):
            S.export(small, p)
    assert S.same_content(small, S.read_table(spark, str(tmp_path / "out.parquet")).repartition(7))
    assert abs(S.estimate_rows(spark, str(tmp_path / "out.csv")) - 400) < 60
    meta = S.open_meta(spark, str(tmp_path / "out.parquet")).toPandas()
    assert list(meta.column) == ["id", "arm", "y"] and set(meta.n_rows) == {400}
    with pytest.raises(ValueError):
        S.read_table(spark, "x.xlsx")


def test_transpose_refuses_repeated_header(spark, table):
    _, df = table
    with pytest.raises(ValueError):
        S.transpose(df.select("arm", "y"))


def test_block_sample_covers_front_middle_back(spark, table, buckets):
    _, df = table
    ids = sorted(r["id"] for r in S.sample_blocks(df.select("id"), ["id"], n=30).collect())
    assert ids == list(range(10)) + list(range(133, 143)) + list(range(266, 276))


def test_replay_order_and_include(spark, table):
    _, df = table
    ops = [{"op": "exclude_row", "key": "id", "keys": [1, 2, 3], "note": "bad"}, {"op": "include_row", "key": "id", "keys": [2]},
           {"op": "derive", "name": "y2", "formula": "y * 2"}, {"op": "filter_rows", "expr": "y2 > 0"}, {"op": "hold", "columns": ["x"]},
           {"op": "semantic_confirm", "column": "y2", "type": "continuous"}]
    out = rowops.apply_ops(df, ops)
    ids = {r["id"] for r in out.select("id").collect()}
    assert not ids & {1, 3} and "x" not in rowops.analysis_columns(out) and rowops.semantic_type_of(out, "y2") == "continuous"
    with pytest.raises(ValueError):
        rowops.apply_ops(df, [{"op": "exclude_row", "key": "id", "keys": [1]}])


def test_unknown_condition_keeps_row_in_drop_mode(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id int, v double")
    assert rowops.filter_rows(df, "v > 0", "drop").count() == 1
    assert rowops.filter_rows(df, "v > 0").count() == 1


def test_natural_order(spark):
    df = spark.createDataFrame([(v,) for v in ("T10", "T2", "T1", "b3")], "v string")
    assert labels.ordered_levels(df, "v") == ["b3", "T1", "T2", "T10"]
    assert [r["v"] for r in df.orderBy(labels.order_key(c("v"))).collect()] == ["b3", "T1", "T2", "T10"]
    mixed = ["3.45", "3.5", "10", "2/1/2023", "12/1/2023", "2/1/2024", "alpha 2", "ALPHA 3", "alpha 10", "x" + "9" * 25, "x1" + "0" * 25]
    shuffled = spark.createDataFrame([(v,) for v in reversed(mixed)], "v string")
    assert [r["v"] for r in shuffled.orderBy(labels.order_key(c("v"))).collect()] == mixed == sorted(mixed, key=natural_key)


def test_palette_ambiguity(spark):
    pal = spark.createDataFrame([("lung", "LUAD"), ("lung cancer", "NSCLC"), ("colon", "CRC"), ("liver", "HCC")], "keyword string, category string")
    df = spark.createDataFrame([("Lung-Cancer II",), ("colon liver",), ("x",)], "l string")
    got = {r["label"]: (r["category"], r["ambiguous"]) for r in labels.palette_match(df, "l", pal).collect()}
    assert got["Lung-Cancer II"] == ("NSCLC", False) and got["x"] == (None, False)
    assert got["colon liver"][1] is True or got["colon liver"][0] in ("CRC", "HCC")


def test_imputation(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=300)
    pdf = pd.DataFrame({"id": np.arange(300), "g": np.arange(300) % 3, "x": x, "y": 2 * x + r.normal(size=300) * 0.1})
    hole = np.arange(300) % 6 == 0
    src = pdf.assign(y=pdf.y.where(~hole))
    df = spark.createDataFrame(src).replace(float("nan"), None)
    mice = missing.impute(df, "mice", ["x", "y"], key="id").toPandas().set_index("id").y
    assert np.abs(mice[hole] - pdf.y[hole]).mean() < 0.15
    knn = missing.impute(df, "knn", ["x", "y"], key="id").toPandas().set_index("id").y
    assert np.abs(knn[hole] - pdf.y[hole]).mean() < 0.4
    rep = missing.impute_report(df, missing.impute(df, "mean", ["y"]), ["y"], "mean").first()
    assert (rep["n_filled"], rep["n_remaining"]) == (50, 0) and "mean fill" in rep["warning"]
    gap = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, None)], "g int, v double")
    assert missing.impute(gap, "group_mean", ["v"], group_by="g").where("v is null").count() == 2


def test_semantic_types_on_planted_columns(spark):
    r = np.random.default_rng(9)
    n = 400
    comp = r.dirichlet([3, 4, 5], n)
    pdf = pd.DataFrame({"sample_id": [f"s{i}" for i in range(n)], "visit_date": pd.date_range("2020-01-01", periods=n).strftime("%Y-%m-%d"), "read_count": r.poisson(200, n),
                        "prob_score": r.beta(0.3, 0.3, n).clip(1e-4, 1 - 1e-4), "pct_purity": r.uniform(5, 95, n), "frac_a": comp[:, 0], "frac_b": comp[:, 1], "frac_c": comp[:, 2],
                        "zscore_expr": r.normal(size=n), "trap_binary": r.integers(0, 2, n), "tumor_type": r.choice(["x", "y", "z"], n)})
    t = profile.infer_types(spark.createDataFrame(pdf)).where("rank = 1").toPandas().groupby("column").type.apply(set)
    want = {"sample_id": "id", "read_count": "count", "prob_score": "probability", "pct_purity": "percent", "frac_a": "proportion", "zscore_expr": "z-score", "tumor_type": "nominal code"}
    for col, kind in want.items():
        assert kind in t[col], (col, t[col])
    assert "nominal code" in t["trap_binary"]
    facts = profile.column_facts(spark.createDataFrame(pdf))
    assert facts["visit_date"]["date_share"] == 1.0
    assert profile.composition_set(spark.createDataFrame(pdf), "frac_a") == {"frac_a", "frac_b", "frac_c"}
    assert {"frac_a", "frac_b", "frac_c"} in profile.compositions(spark.createDataFrame(pdf))


def test_structure_and_shape(spark, table):
    _, df = table
    g = {r["column"]: r for r in profile.group_structure(df, ["id", "subject", "arm", "y"]).collect()}
    assert g["id"]["is_identifier"] and g["subject"]["mean_per_group"] == 4 and g["subject"]["kind"] == "subject" and "y" not in g
    heights = {"bimodal": [5, 90, 5, 90, 5], "bimodal_ends": [40, 5, 5, 5, 40], "flat": [10, 11, 10, 9], "unimodal": [2, 10, 40, 9, 1], "skewed": [50, 20, 5, 2, 1], "too_few": [3, 1]}
    bins = spark.createDataFrame([(k, float(i), n) for k, h in heights.items() for i, n in enumerate(h)], "column string, bin double, count bigint")
    facts = spark.createDataFrame([(k, sum(h), 2.0 if k == "skewed" else 0.0) for k, h in heights.items()], "column string, n bigint, skew double")
    assert all(r["column"] == r["shape"] for r in profile.shapes(bins, facts).collect())


def test_table_diff_refuses_duplicate_keys_but_compares_the_rest(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", float("nan")), (3, "z", 3.0), (3, "z", 3.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.5), (2, "y", None), (4, "w", 4.0)], "k int, s string, v double")
    d = diff.compare(a, b, "k")
    assert [(r["k"], r["n"]) for r in d.duplicates.collect()] == [("3", 2)]
    assert {(r["k"], r["side"]) for r in d.rows.collect()} == {("3", "a"), ("4", "b")}
    assert [(r["k"], r["column"]) for r in d.cells.collect()] == [("1", "v")]      # NaN beside null is not a change
    assert diff.compare(b, b, "k").summary.first()["identical"] is True
    with pytest.raises(ValueError):
        diff.compare(a, b, "nope")


def test_guard_flags_planted_problems_and_stays_quiet_otherwise(spark):
    r = np.random.default_rng(3)
    n = 2000
    clean = pd.DataFrame({"id": np.arange(n), "arm": np.where(np.arange(n) % 2, "a", "b"), "p": r.random(n) * 0.98 + 0.01, "age": r.normal(50, 10, n)})
    q = guard.run_guard(spark.createDataFrame(clean), {"p": "probability"}, "arm", ["age"], ["p"], key=["id"]).where("tier = 'gate'")
    assert q.count() == 0
    bad = clean.assign(p=clean.p.where(clean.id % 50 != 0, 1.7))
    bad = bad[(bad.arm == "a") | (bad.id % 6 != 0)]
    hits = {(x["rule"], x["check"]) for x in guard.run_guard(spark.createDataFrame(bad), {"p": "probability"}, "arm", ["age"], ["p"], before=spark.createDataFrame(clean), key=["id"]).collect()}
    assert ("GR-01", "impossible") in hits and ("GR-02", "srm") in hits and ("GR-03", "loss_by_group") in hits
    assert guard.cause_of_ratio(guard.run_guard(spark.createDataFrame(bad), {}, "arm", before=spark.createDataFrame(clean), key=["id"])).first()["candidate"] == "loss"


def test_near_duplicates_brute_force(spark):
    r = np.random.default_rng(12)
    a = r.normal(size=(300, 3))
    b = np.vstack([a[:40] + r.uniform(-0.0012, 0.0012, (40, 3)), r.normal(size=(200, 3))])
    da, db = (spark.createDataFrame(pd.DataFrame(m, columns=list("xyz"))) for m in (a, b))
    sd = a.std(axis=0)
    want = int((np.abs((b[:, None] - a) / sd).max(-1).min(1) <= 0.001).sum())
    assert 0 < want < 40
    assert U.near_duplicates(da, db, list("xyz")).count() == want


def test_audit_finds_planted_leaks(spark):
    r = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"pid": np.arange(n) // 2, "day": np.arange(n), "m": r.normal(size=n), "label": r.integers(0, 2, n)})
    pdf["proxy"] = pdf.label + r.normal(size=n) * 0.01
    tr, te = pdf.iloc[:401], pd.concat([pdf.iloc[401:], pdf.iloc[:5]])
    spec = U.ModelSpec({"train": spark.createDataFrame(tr), "test": spark.createDataFrame(te)}, "label", ("m", "proxy"), group="pid", time="day", positive="1")
    bad = {(x["check"], x["column"]) for x in U.report(spec).where("verdict = 'fail'").collect()}
    assert {"MB-C01", "MB-C02", "MB-C03", "MB-C05", "MB-C28"} <= {k for k, _ in bad} and ("MB-C05", "proxy") in bad and ("MB-C05", "m") not in bad


@pytest.mark.parametrize("method", ["holm", "bh"])
def test_p_adjust_by_hand(spark, method, buckets):
    p = np.random.default_rng(1).random(200) ** 3
    p[:60] = p[0]
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(200), "p": p}))
    got = multiple.p_adjust(df, "p", method).toPandas().sort_values("i").p_adj.to_numpy()
    o = np.argsort(p, kind="stable")
    m = len(p)
    adj = np.maximum.accumulate(p[o] * (m - np.arange(m))) if method == "holm" else np.minimum.accumulate((p[o] * m / (np.arange(m) + 1))[::-1])[::-1]
    want = np.empty(m)
    want[o] = np.minimum(adj, 1)
    if method == "holm":       # equal p share the largest step factor
        want = pd.Series(want).groupby(p).transform("max").to_numpy()
    assert np.allclose(got, want)


def test_simpson_flip_is_marked(spark):
    rows = [("s1", "t", 1)] * 80 + [("s1", "t", 0)] * 10 + [("s1", "c", 1)] * 230 + [("s1", "c", 0)] * 40 + [("s2", "t", 1)] * 190 + [("s2", "t", 0)] * 75 + [("s2", "c", 1)] * 55 + [("s2", "c", 0)] * 25
    df = spark.createDataFrame(rows, "s string, arm string, y int")
    r = {x["stratum"]: x for x in run_test(df, Spec(y="y", group="arm", by="s"), "T-201").collect()}
    assert r["s1"]["flipped"] and r["s2"]["flipped"] and not r["overall"]["flipped"]
    assert r["overall"]["effect"]["name"] == "OR"


def test_compat_rules(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [0.2, 0.3] * 20, "b": [0.5, 0.4] * 20, "k": [0.3, 0.3] * 20, "i": range(40), "n": [100, 110] * 20, "m": [10, 12] * 20}))
    t = {"a": "proportion", "b": "proportion", "k": "proportion", "i": "id", "n": "count", "m": "count"}
    rules = lambda op, cols: {r["rule"] for r in compat.judge(df, op, cols, t).collect()}
    assert rules("correlate", ["a", "b"]) == {"S-R01"} and rules("compare", ["a", "b"]) == {"S-R02"}
    assert rules("correlate", ["n", "m"]) == {"S-R03"} and "S-R10" in rules("correlate", ["i", "n"])
    assert compat.judge(df, "correlate", ["a", "zz"], t).first()["rule"] == "S-R14"
    assert "a_clr" in compat.fix(df, "S-R01", ["a", "b", "k"]).columns


def test_bootstrap_band_and_power(spark, table):
    _, df = table
    b = robust.bootstrap_effect(df, Spec(y="y", group="arm"), "T-101", ["id"], reps=60).first()
    assert b["p5"] < b["effect"] < b["p95"] and b["draws"] == 60
    assert spark.range(1).select(explore.least_correlation(F.lit(783)), explore.rows_for_correlation(F.lit(-0.1)), explore.rows_for_correlation(F.lit(0.0))).first()[:] == (pytest.approx(0.1, abs=0.002), pytest.approx(783, abs=3), 0)


def test_metrics_small_cases(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.2)], "y int, s double")
    assert U.roc_pr(d, "s", "y").first()["roc_auc"] == pytest.approx(5 / 6)
    assert metrics.partial_auc(d, "y", "s", 1.0).first()["pauc"] == pytest.approx(5 / 6)
    cat = spark.createDataFrame([(v,) for v in "aaabbc"], "v string")
    h = metrics.diversity(cat, "v").first()
    p = np.array([3, 2, 1]) / 6
    assert h["shannon"] == pytest.approx(-(p * np.log(p)).sum()) and h["chao1"] == pytest.approx(3 + 1 / 2)
    assert U.auc_power(10, 10) < 0.5 < U.auc_power(200, 200)


def test_answers_do_not_depend_on_limits(spark):
    words = ["k" * n for n in range(1, 260)]
    palette = spark.createDataFrame([(w, f"c{len(w)}") for w in words], "keyword string, category string")
    got = {r["label"]: r["category"] for r in labels.palette_match(spark.createDataFrame([(w,) for w in words], "l string"), "l", palette).collect()}
    assert got == {w: f"c{len(w)}" for w in words}
    rows = spark.range(1500).select(F.format_string("level%05d", "id").alias("y"), F.rand(1).alias("x"))
    assert U.code_direction(U.ModelSpec({"train": rows}, "y", positive="level01499")).first()["verdict"] == "pass"
    lv = labels.label_levels(spark.createDataFrame([("b",)] * 3 + [("a",)] * 3 + [("c",)], "v string"), "v").collect()
    assert {r["value"]: r["code"] for r in lv} == {"a": 0, "b": 1, "c": 2}


def test_block_sample_is_whole(spark):
    df = spark.range(1000).select("id", F.timestamp_seconds(c("id") * 60).alias("at"), F.format_string("k%06d", "id").alias("name"))
    for key in ("id", "at", "name"):
        ids = sorted(r["id"] for r in S.sample_blocks(df, [key], n=100).collect())
        assert len(ids) == 100 and ids[:34] == list(range(34)) and ids[34:67] == list(range(333, 366)) and ids[67:] == list(range(666, 699))


def test_block_sample_has_exactly_n_rows(spark, buckets, tmp_path):
    from statweave.plans.order import block_ranges
    for total in (7, 100, 10_001):
        for blocks in (1, 2, 3, 4, 5):
            for n in {1, 2, total // 2, total - 2, total - 1, total, total + 5}:
                rows = [i for lo, hi in block_ranges(total, n, blocks) for i in range(lo, hi + 1)]
                assert len(rows) == len(set(rows)) == min(n, total) and 0 <= min(rows) and max(rows) < total
    df = spark.range(301).select("id", F.timestamp_seconds(c("id") * 60).alias("at"), F.format_string("one long beginning of all keys %06d", "id").alias("name"), F.lit("same").alias("one")).repartition(5)
    for key in ("id", "at", "name", "one"):
        for blocks in (2, 3, 4, 5):
            ids = [r["id"] for r in S.sample_blocks(df, [key], n=300, blocks=blocks).collect()]
            assert len(ids) == len(set(ids)) == 300
    df.write.parquet(f"{tmp_path}/t.parquet")
    back = spark.read.parquet(f"{tmp_path}/t.parquet")
    order = [r["id"] for r in back.select("id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    got = {r["id"] for r in S.sample_rows(spark, f"{tmp_path}/t.parquet", n=30, columns=["id"]).collect()}
    assert got == set(order[:10] + order[100:110] + order[200:210]) and S.sample_rows(spark, f"{tmp_path}/t.parquet", n=300, blocks=4).count() == 300
    with pytest.raises(ValueError):
        S.sample_rows(spark, "t.csv")


def test_label_levels_that_all_occur_once(spark, buckets):
    rows = spark.range(500).select(F.format_string("level %05d", "id").alias("v")).union(spark.createDataFrame([("often",)] * 3 + [(None,)], "v string")).repartition(4)
    codes = {r["value"]: (r["code"], r["n"]) for r in labels.label_levels(rows, "v").collect()}
    assert codes == {"often": (0, 3)} | {f"level {i:05d}": (i + 1, 1) for i in range(500)}


def test_power_transform_searches_as_far_as_it_must(spark):
    z = np.random.default_rng(4).normal(30, 4, 4000)
    df = spark.createDataFrame([(float(v) ** 0.2,) for v in np.abs(z)], "v double")
    assert 3.5 < metrics.power_transform(df, "v", "t")[1] < 8


def test_count_set_by_shared_words_and_varying_totals(spark):
    df = spark.createDataFrame([(1, 4, 0.5, 7, 3, 7, "x"), (2, 0, 0.25, 7, 2, 8, "y"), (9, 1, 1.0, 7, 8, 2, "z"), (None, 3, 1.0, 7, 5, 5, "z")],
                               "cell_T int, cell_B int, cell_share double, plate int, left_side int, right_side int, name string")
    assert profile.count_set(df, "cell_T") == ["cell_B", "cell_T"]
    assert profile.count_set(df, "plate") == ["cell_B", "cell_T", "left_side", "plate", "right_side"]      # no shared word
    for name in ("cell_share", "name", "left_side"):                                                       # no counts, no number, a constant total
        with pytest.raises(ValueError):
            profile.count_set(df if name != "left_side" else df.where("left_side + right_side = 10"), name)


def test_power_transform_searches_on_logarithms(spark, monkeypatch):
    from pyspark.sql import functions as F
    from statweave.operators import metrics
    x = np.random.default_rng(5).gamma(2.0, 3.0, 400)
    df = spark.createDataFrame([(float(v), float(v) - 5) for v in x], "a double, b double")
    calls, true = [], F.pow
    monkeypatch.setattr(F, "pow", lambda *a: calls.append(a) or true(*a))
    grid = np.linspace(-1, 2, 3001)
    box = [(v - 1) * np.log(x).sum() - 200 * np.log(np.var((x ** v - 1) / v if abs(v) > 1e-9 else np.log(x))) for v in grid]
    assert abs(metrics.power_transform(df, "a", "t")[1] - grid[np.argmax(box)]) < 0.01
    y = x - 5
    j = np.sign(y) * np.log1p(abs(y))
    up = lambda v: (np.exp(v * abs(j)) - 1) / v if abs(v) > 1e-9 else abs(j)
    yeo = [(v - 1) * j.sum() - 200 * np.log(np.var(np.where(y >= 0, up(v), -up(2 - v)))) for v in grid]
    assert abs(metrics.power_transform(df, "b", "t", "yeo-johnson")[1] - grid[np.argmax(yeo)]) < 0.01 and len(calls) <= 3
