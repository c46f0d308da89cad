"""Choosing, exploring and shaking: compatibility, shortlists, scans, robustness, representativeness."""
import math

from pyspark.sql import functions as F

from statweave.operators import advise as V, compat as C, explore as E, represent as P, robust as B
from statweave.operators.run import run_test
from statweave.plans.cumulate import cumulate
from statweave.spec import Spec
from workload.registry import query

c = F.col
TYPES = {"l_orderkey": "id", "l_quantity": "count", "l_linenumber": "count", "l_discount": "proportion", "l_returnflag": "label"}


@query("compat_judge", """select 'S-R10' as rule, 'gate' verdict union all select 'S-R09', 'gate' union all
  select 'S-R03', 'red' from (select sum(l_quantity) a, sum(l_linenumber) b from lineitem) where greatest(a,b)/least(a,b) > 1.05""")
def _(t):
    return C.judge(t.lineitem, "correlate", list(TYPES), TYPES, groups=[]).select("rule", "verdict")


@query("compat_fix", """with u as (select user_id, count(*) filter (event_type='click')+.5 a, count(*) filter (event_type='error')+.5 b, count(*) filter (event_type='view')+.5 d from events group by 1)
  select user_id, round(ln(a)-(ln(a)+ln(b)+ln(d))/3, 8) click_clr from u""")
def _(t):
    from workload.model_queries import user_counts
    return C.fix(user_counts(t), "S-R01", ["click", "error", "view"], 0.5).select("user_id", F.round("click_clr", 8).alias("click_clr"))


@query("spec_build", """select o_orderpriority level, count(*) n, count(*) filter (o_totalprice is not null and o_orderstatus is not null) n_complete from orders group by 1""")
def _(t):
    return V.build_spec(t.orders, Spec(y="o_totalprice", group="o_orderpriority", by="o_orderstatus")).select("level", "n", "n_complete")


@query("shortlist_pairs", """with k as (select 'o_orderstatus' g, count(distinct o_orderstatus) k, (select min(n) from (select count(*) n from orders group by o_orderstatus)) m from orders union all
    select 'o_orderpriority', count(distinct o_orderpriority), (select min(n) from (select count(*) n from orders group by o_orderpriority)) from orders)
  select g as "group", k, m min_n, 4 tests from k""")
def _(t):
    s = V.shortlist(t.orders, "Q-01", {"o_totalprice": "continuous"}, ["o_orderstatus", "o_orderpriority"])
    return s.groupBy("group", "k", "min_n").agg(F.count(F.lit(1)).alias("tests"))


_KINDS = {"o_totalprice": "continuous", "o_custkey": "rank", "o_shippriority": "code", "days": "survival", "share": "composition", "part": "proportion", "lines": "count"}
_RULES = ", ".join(f"('{i}', '{q}', {lo}, {hi}, {str(paired).lower()}, '{kinds}', {n}, '{need}')" for i, q, lo, hi, paired, kinds, n, need in V.TESTS)


@query("shortlist_every_question", f"""with r(test_id, question, lo, hi, paired, kinds, n_from, need) as (values {_RULES}),
  o(y, kind) as (values {", ".join(f"('{y}', '{k}')" for y, k in _KINDS.items())}),
  g as (select 'o_orderstatus' g, count(*) n from orders group by o_orderstatus union all select 'o_orderpriority', count(*) from orders group by o_orderpriority),
  k as (select g, count(*) k, min(n) m from g group by 1)
  select question, paired, y, g as "group", test_id, case when not list_contains(string_split(kinds, ','), kind) then 'red' when m < n_from or need <> '' then 'yellow' else 'green' end color
  from r, o, k where k between lo and hi""")
def _(t):
    """Each outcome stands for a column of its kind that is never null."""
    frame = t.orders.select("o_orderstatus", "o_orderpriority", *[F.lit(1).alias(y) for y in _KINDS])
    parts = [V.shortlist(frame, q, _KINDS, ["o_orderstatus", "o_orderpriority"], paired=p).select(F.lit(q).alias("question"), F.lit(p).alias("paired"), "y", "group", "test_id", "color")
             for q in sorted({row[1] for row in V.TESTS}) for p in (False, True)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("metric_catalogue")
def _(t):
    return V.metric_catalogue(t.part.select("p_size", "p_retailprice", "p_brand")).select("metric", "verdict", "columns")


@query("entropy_branch", """with m as (select o_totalprice v from orders where o_totalprice is not null),
  f as (select count(*)::double n, min(v) lo, max(v) hi, avg(v) a, var_pop(v) s2, stddev_samp(v) sd, avg(v*v*v) m3, avg(v*v*v*v) m4, quantile_cont(v, .75) - quantile_cont(v, .25) iqr from m),
  g as (select count(*)::double n, avg(ln(v)) a, var_pop(ln(v)) s2, avg(pow(ln(v), 3)) m3 from m where v > 0),
  z as (select f.n, lo, hi, f.sd/a mean_ratio, f.sd*1.349/iqr iqr_ratio, (f.m3 - 3*a*f.s2 - a*a*a)/pow(f.s2, 1.5) sk, (f.m4 - 4*a*f.m3 + 6*a*a*(f.s2 + a*a) - 3*a*a*a*a)/(f.s2*f.s2) - 3 ku,
    (select (m3 - 3*a*s2 - a*a*a)/pow(s2, 1.5) from g) lsk from f),
  l as (select unnest([['SC-ENT-07', 'false'], ['SC-ENT-03', (lo >= 0 and hi <= 1)::varchar], ['SC-ENT-10', 'false'], ['SC-ENT-01', (abs(sk) < .5 and abs(ku) < 1)::varchar],
    ['SC-ENT-06', (lo > 0 and abs(sk) > 1 and abs(lsk) < .5)::varchar], ['SC-ENT-05', (lo > 0 and abs(mean_ratio - 1) < .2 and lsk < -.7)::varchar], ['SC-ENT-04', (lo > 0 and abs(sk) > 1)::varchar],
    ['SC-ENT-08', (ku > 3 and iqr_ratio > 5)::varchar], ['SC-ENT-09', (ku > 3)::varchar], ['SC-ENT-11', (n >= 100)::varchar], ['SC-ENT-12', 'true']]) r, generate_subscripts([1,2,3,4,5,6,7,8,9,10,11], 1) i from z),
  p as (select min(i) k from l where r[2] = 'true')
  select 'o_totalprice' as column, max(r[1]) filter (i = k) picked, string_agg(r[1], ',' order by i) filter (i < k) rejected from l, p""")
def _(t):
    return V.entropy_branch(t.orders, "o_totalprice").select("column", "picked", F.array_join("rejected", ",").alias("rejected"))


@query("suggest_columns", """select 'o_orderstatus' as column, count(distinct o_orderstatus) k from orders union all select 'o_orderpriority', count(distinct o_orderpriority) from orders""")
def _(t):
    return E.suggest_columns(t.orders, "color", ["o_totalprice"])


@query("power_ladder", """with n as (select count(*) n from part where p_size is not null and p_retailprice is not null)
  select 'ladder' kind, k::double n from n, unnest([n, 2*n, 4*n, 200, 500]) u(k) union select 'effect', n::double from n""")
def _(t):
    return E.power_ladder(t.part, ["p_size", "p_retailprice"], [0.05]).select("kind", "n")


@query("scan_columns", """with l as (select l_returnflag g, 'l_quantity' as column, l_quantity x from lineitem union all select l_returnflag, 'l_extendedprice', l_extendedprice from lineitem
    union all select l_returnflag, 'l_tax', l_tax from lineitem),
  m as (select "column", avg(x) filter (g='A') a, avg(x) filter (g='R') b, var_samp(x) filter (g='A') va, var_samp(x) filter (g='R') vb, count(x) filter (g='A') na, count(x) filter (g='R') nb from l group by 1)
  select "column", round((a-b)/sqrt((va+vb)/2), 8) effect, round((a-b)/sqrt(va/na+vb/nb), 6) t from m""")
def _(t):
    s = E.scan_columns(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice", "l_tax"], ["A", "R"])
    return s.select("column", F.round("effect", 8).alias("effect"), F.round("t", 6).alias("t"))


@query("scan_association", """with a as (select p_brand g, row_number() over () i, p_size::double x, p_retailprice y from part), n as (select g, count(*) n, corr(x,y) r from a group by g),
  d as (select a.g, a.i, b.i j, abs(a.x-b.x) dx, abs(a.y-b.y) dy from a join a b on a.g = b.g), m as (select g, i, avg(dx) mx, avg(dy) my from d group by all), o as (select g, avg(mx) gx, avg(my) gy from m group by g),
  u as (select d.g, dx-p.mx-q.mx+gx a, dy-p.my-q.my+gy b from d join m p on p.g=d.g and p.i=d.i join m q on q.g=d.g and q.i=d.j join o on o.g=d.g),
  z as (select max(abs(atanh(p.r)-atanh(q.r))/sqrt(1.0/(p.n-3)+1.0/(q.n-3))) z from n p join n q on p.g < q.g)
  select u.g p_brand, max(n) n, round(max(r), 8) r, round(sqrt(avg(a*b)/sqrt(avg(a*a)*avg(b*b))), 6) dcor, round(max(z), 6) z from u join n on n.g = u.g, z group by 1""")
def _(t):
    s = E.scan_association(t.part, "p_retailprice", "p_size", "p_brand")
    return s.select("p_brand", "n", F.round("r", 8).alias("r"), F.round("dcor", 6).alias("dcor"), F.round("largest_level_gap_z", 6).alias("z"))


@query("grouped_histogram", """with s as (select min(o_totalprice) a, max(o_totalprice) b from orders), q as (select o_orderstatus level, median(o_totalprice) m from orders group by 1)
  select level, least(19, floor((o_totalprice-a)/(b-a)*20))::int bin, count(*) n, round(max(m), 4) median from orders join q on level = o_orderstatus, s group by 1, 2""")
def _(t):
    return E.grouped_histogram(t.orders, "o_totalprice", "o_orderstatus").select("level", "bin", "n", F.round("median", 4).alias("median"))


@query("scatter_points")
def _(t):
    return E.scatter_points(t.lineitem, "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("companion_group_means", "select o_orderpriority level, count(*) n, round(avg(o_totalprice), 4) mean, round(stddev_samp(o_totalprice), 4) sd from orders group by 1")
def _(t):
    return E.group_means(t.orders, "o_totalprice", "o_orderpriority").select("level", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query("companion_composition_tradeoff", """with u as (select user_id % 2 g, count(*) filter (event_type='click')/count(*) a, count(*) filter (event_type='view')/count(*) b from events group by user_id)
  select 'click' member, round(avg(a) filter (g=0)-avg(a) filter (g=1), 8) difference from u union all select 'view', round(avg(b) filter (g=0)-avg(b) filter (g=1), 8) from u""")
def _(t):
    from workload.model_queries import MEMBERS, user_counts
    tot = sum((c(m) for m in MEMBERS), F.lit(0))
    u = user_counts(t).select("g", *[(c(m) / tot).alias(m) for m in MEMBERS])
    r = E.composition_tradeoff(u, "g", MEMBERS, ["even", "odd"]).where(c("member").isin("click", "view"))
    return r.select("member", F.round("difference", 8).alias("difference"))


@query("companion_censoring", "select l_linestatus level, count(*) n, count(*) filter (l_returnflag='R') events, round(avg((l_returnflag<>'R')::int), 8) censored from lineitem group by 1")
def _(t):
    s = t.lineitem.withColumn("e", (c("l_returnflag") == "R").cast("int"))
    return E.censoring(s, "e", "l_linestatus").withColumn("censored", F.round("censored", 8))


@query("companion_transformed_correlation", "select round(corr(l_quantity, l_extendedprice), 8) r, round(corr(ln(l_quantity), ln(l_extendedprice)), 8) r_log, count(*) positive_pairs from lineitem")
def _(t):
    r = E.transformed_correlation(t.lineitem, "l_extendedprice", "l_quantity")
    return r.select(F.round("r", 8).alias("r"), F.round("r_log", 8).alias("r_log"), "positive_pairs")


SPEC = Spec(y="l_extendedprice", group="l_returnflag", levels=("A", "R"))


@query("robust_bootstrap_band")
def _(t):
    return B.bootstrap_effect(t.lineitem, SPEC, "T-101", ["l_orderkey", "l_linenumber"], reps=50)


@query("robust_trims", """with q as (select quantile_cont(l_extendedprice, .01) a1, quantile_cont(l_extendedprice, .99) b1, quantile_cont(l_extendedprice, .05) a5, quantile_cont(l_extendedprice, .95) b5 from lineitem),
  r as (select 'T-101' as label, l_returnflag f, l_extendedprice y from lineitem union all select '1% each tail', l_returnflag, l_extendedprice from lineitem, q where l_extendedprice between a1 and b1 union all
    select '5% each tail', l_returnflag, l_extendedprice from lineitem, q where l_extendedprice between a5 and b5)
  select label, round((avg(y) filter (f='A') - avg(y) filter (f='R'))/sqrt(var_samp(y) filter (f='A')/count(*) filter (f='A') + var_samp(y) filter (f='R')/count(*) filter (f='R')), 6) statistic from r group by 1""")
def _(t):
    return B.robustness(t.lineitem, SPEC, "T-101").select("label", F.round("statistic", 6).alias("statistic"))


@query("robust_other_tests", """with s as (select avg(l_extendedprice) filter (l_returnflag = 'A') m1, var_samp(l_extendedprice) filter (l_returnflag = 'A') v1, count(l_extendedprice) filter (l_returnflag = 'A')::double n1,
    avg(l_extendedprice) filter (l_returnflag = 'R') m2, var_samp(l_extendedprice) filter (l_returnflag = 'R') v2, count(l_extendedprice) filter (l_returnflag = 'R')::double n2 from lineitem),
  k as (select l_returnflag g, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1)/2.0 r from lineitem where l_returnflag in ('A', 'R')),
  u as (select (sum(r) filter (g = 'A') - max(n1)*(max(n1)+1)/2)/max(n1*n2) below from k, s),
  e as (select 'T-101' label, (m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2))*(1-3/(4*(n1+n2)-9)) v, 0.0 ref from s union all
    select 'T-103', 2*below - 1, 0.0 from u union all select 'T-104', 1 - below, 0.5 from u)
  select label, round(abs(v - ref), 4) size from e""")                # how far from "no difference", whichever way a test reports it
def _(t):
    from statweave.operators.run import null_value
    r = B.robustness(t.lineitem, SPEC, "T-101", ["T-103", "T-104"], trims=())
    return r.select("label", F.round(F.abs(c("effect.value") - null_value(c("effect.name"))), 4).alias("size"))


@query("run_test_with_label_map", """select round((m1-m2)/sqrt(v1/n1+v2/n2), 6) statistic from (select avg(o_totalprice) filter (o_orderpriority < '3') m1, var_samp(o_totalprice) filter (o_orderpriority < '3') v1,
  count(*) filter (o_orderpriority < '3') n1, avg(o_totalprice) filter (o_orderpriority > '3') m2, var_samp(o_totalprice) filter (o_orderpriority > '3') v2, count(*) filter (o_orderpriority > '3') n2 from orders)""")
def _(t):
    maps = {"o_orderpriority": {"1-URGENT": "a", "2-HIGH": "a", "3-MEDIUM": "b", "4-NOT SPECIFIED": "b", "5-LOW": "b"}}
    r = run_test(t.orders, Spec(y="o_totalprice", group="o_orderpriority", levels=("a", "b")), "T-101", maps)
    return r.select(F.round("statistic", 6).alias("statistic"))


_LADDER = "z as (select count(*)::double total from orders), n as (select distinct floor(100*pow(total/100, i/9.0) + 1e-9)::int n from z, range(9) g(i) where total > 100)"


def _near(curve, total, scale, low, high):
    """Is the mean distance within these multiples of what sampling theory says: scale x sqrt((1 - n / total) / n)?"""
    want = F.lit(scale) * F.sqrt((1 - F.col("n") / total) / F.col("n"))
    return curve.select("n", "metric", (F.col("mean").between(low * want, high * want) & (F.col("lo") <= F.col("mean")) & (F.col("mean") <= F.col("hi"))).alias("as_theory"))


@query("t1201_representative_ks", f"with {_LADDER} select n, 'ks' metric, true as_theory from n")
def _(t):
    return _near(P.distance_curve(t.orders, "o_totalprice"), t.orders.count(), 0.8687, 0.6, 1.5)          # mean of the Kolmogorov law


@query("t1202_representative_tv", f"with {_LADDER} select n, 'tv' metric, true as_theory from n")
def _(t):
    total = t.orders.count()
    share = t.orders.groupBy("o_orderpriority").agg((F.count(F.lit(1)) / total).alias("q"))
    scale = share.agg(F.sum(F.sqrt(F.col("q") * (1 - F.col("q"))))).first()[0] * (2 / math.pi) ** 0.5 / 2      # mean absolute deviations of shares
    return _near(P.distance_curve(t.orders, "o_orderpriority"), total, scale, 0.5, 1.7)


@query("t1203_representative_wasserstein", f"with {_LADDER} select n, 'wasserstein' metric, true as_theory from n")
def _(t):
    total = t.orders.count()
    steps = cumulate(t.orders, "o_totalprice", {"n": F.count(F.lit(1))}, lead=True)
    f = (F.col("cum_n") + F.col("n")) / F.col("tot_n")
    scale = steps.agg(F.sum(F.sqrt(F.greatest(F.lit(0.0), f * (1 - f))) * (F.col("next_value") - F.col("o_totalprice")))).first()[0] * (2 / math.pi) ** 0.5
    return _near(P.distance_curve(t.orders, "o_totalprice", metric="wasserstein"), total, scale, 0.5, 1.9)


@query("t1204_picked_vs_rest")
def _(t):
    return P.picked_vs_rest(t.orders, "o_totalprice", ["o_orderkey"])


@query("representative_enough_rows")
def _(t):
    return P.enough_rows(P.distance_curve(t.orders, "o_orderpriority", ["o_orderkey"], repeats=10), 0.02)
