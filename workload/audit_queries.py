"""Checks, multiplicity, guardrails, table comparison, model-data audits."""
from pyspark.sql import functions as F

from statweave.operators import audit as A, checks as K, diff as X, guard as G, multiple as M
from statweave.spec import Spec
from workload.registry import query

c = F.col
r6 = lambda col, name=None: F.round(col, 6).alias(name or col)


# ---------------------------------------------------------------- assumption checks
@query("c01_normality", """select o_orderpriority as "group", count(*)::double n, round((avg(pow(o_totalprice,3)) - 3*avg(o_totalprice)*avg(pow(o_totalprice,2)) + 2*pow(avg(o_totalprice),3))
    / pow(var_pop(o_totalprice), 1.5), 5) skew, case when abs((avg(pow(o_totalprice,3)) - 3*avg(o_totalprice)*avg(pow(o_totalprice,2)) + 2*pow(avg(o_totalprice),3))
    / pow(var_pop(o_totalprice), 1.5)) >= 1 then 'caution' else 'ok' end verdict from orders group by 1""")
def _(t):
    r = K.normality(t.orders, "o_totalprice", "o_orderpriority")
    return r.select("group", c("numbers")["n"].alias("n"), F.round(c("numbers")["skew"], 5).alias("skew"), "verdict")


@query("qq_points", """with q as (select unnest(range(40)) i) select round((select quantile_cont(o_totalprice, 0.5/40) from orders), 4) first_q,
    round((select quantile_cont(o_totalprice, 39.5/40) from orders), 4) last_q, (select count(*) from q) n""")
def _(t):
    r = K.qq_points(t.orders, "o_totalprice")
    return r.agg(F.round(F.min("sample"), 4).alias("first_q"), F.round(F.max("sample"), 4).alias("last_q"), F.count(F.lit(1)).alias("n"))


@query("c02_brown_forsythe", """with m as (select o_orderpriority g, median(o_totalprice) m from orders group by 1),
  d as (select o_orderpriority g, abs(o_totalprice - m) d from orders join m on g = o_orderpriority),
  k as (select g, count(*) n, avg(d) a, var_samp(d) v from d group by g), z as (select *, sum(n*a) over () / sum(n) over () gm from k)
  select round(sum(n*(a-gm)*(a-gm))/(count(*)-1)/(sum((n-1)*v)/(sum(n)-count(*))), 6) stat from z""")
def _(t):
    return K.equal_variance(t.orders, "o_totalprice", "o_orderpriority").select(F.round(c("numbers")["stat"], 6).alias("stat"))


@query("c03_outlier_share", """with m as (select median(value) m, mad(value)*1.4826 d from events)
  select round(avg((abs(value-m) > 3*d)::int), 8) ratio, count(*) filter (abs(value-m) > 3*d)::double n, case when avg((abs(value-m) > 3*d)::int) <= 0.05 then 'ok' else 'violated' end verdict
  from events, m where value is not null""")
def _(t):
    return K.outlier_share(t.events, "value").select(F.round(c("numbers")["ratio"], 8).alias("ratio"), c("numbers")["n"].alias("n"), "verdict")


@query("c04_shape_similarity", """with s as (select event_type, count(value) n, avg(value) m, var_pop(value) v, avg(pow(value,3)) c3, avg(pow(value,2)) c2, kurtosis_pop(value) k from events group by 1),
  g as (select (c3-3*m*c2+2*m*m*m)/pow(v,1.5) s, k from s) select round(max(s)-min(s), 5) d_skew, round(max(k)-min(k), 5) d_kurt from g""")
def _(t):
    return K.shape_similarity(t.events, "value", "event_type").select(F.round(c("numbers")["d_skew"], 5).alias("d_skew"), F.round(c("numbers")["d_kurt"], 5).alias("d_kurt"))


@query("c05_independence", """select max(n)::double max_per_subject, round(avg(n), 6) mean_per_subject, case when max(n) > 1 then 'violated' else 'ok' end verdict
  from (select count(*) n from events where user_id is not null group by user_id)""")
def _(t):
    r = K.independence(t.events, subject="user_id")
    return r.select(c("numbers")["max_per_subject"].alias("max_per_subject"), F.round(c("numbers")["mean_per_subject"], 6).alias("mean_per_subject"), "verdict")


@query("c07_vif", """with s as (select corr(l_quantity, l_extendedprice) a, corr(l_quantity, l_tax) b, corr(l_extendedprice, l_tax) d from lineitem),
  v as (select 'l_quantity' g, 1/(1-(a*a+b*b-2*a*b*d)/(1-d*d)) v from s union all select 'l_extendedprice', 1/(1-(a*a+d*d-2*a*b*d)/(1-b*b)) from s
    union all select 'l_tax', 1/(1-(b*b+d*d-2*a*b*d)/(1-a*a)) from s) select g as "group", round(v, 8) vif from v""")
def _(t):
    return K.collinearity(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]).select("group", F.round(c("numbers")["vif"], 8).alias("vif"))


@query("c08_linearity", """with r as (select p_size x, p_retailprice y, rank() over (order by p_size) + (count(*) over (partition by p_size)-1)/2.0 a,
    rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice)-1)/2.0 b from part)
  select round(pow(corr(x,y),2), 8) r2, round(pow(corr(a,b),2), 8) rho2 from r""")
def _(t):
    return K.linearity(t.part, "p_retailprice", "p_size").select(F.round(c("numbers")["r2"], 8).alias("r2"), F.round(c("numbers")["rho2"], 8).alias("rho2"))


@query("c09_power")
def _(t):
    return K.power_check(t.lineitem.where("l_returnflag <> 'N'"), "l_extendedprice", "l_returnflag")


@query("c10_dispersion", """select round(var_samp(l_linenumber)/avg(l_linenumber), 8) var_mean_ratio, round(avg((l_linenumber=0)::int), 8) zero_ratio from lineitem""")
def _(t):
    n = c("numbers")
    return K.dispersion(t.lineitem, "l_linenumber").select(F.round(n["var_mean_ratio"], 8).alias("var_mean_ratio"), F.round(n["zero_ratio"], 8).alias("zero_ratio"))


@query("run_checks")
def _(t):
    return K.run_checks(t.orders, Spec(y="o_totalprice", group="o_orderstatus", n_tests=3)).select("check", "group", "verdict", "cause")


# ---------------------------------------------------------------- multiplicity
def _p_values(t):
    """A p-like number per order line, in families by supplier."""
    u = F.pmod(c("l_orderkey") * 7919 + c("l_linenumber") * 104729 + c("l_suppkey") * 31, F.lit(100003)) / 100003.0
    return t.lineitem.select("l_suppkey", (u * u).alias("p"))


_P = """p as (select l_suppkey f, pow(((l_orderkey*7919 + l_linenumber*104729 + l_suppkey*31) % 100003)/100003.0, 2) p from lineitem),
  r as (select f, p, count(*) over (partition by f) m, rank() over (partition by f order by p) r, count(*) over (partition by f order by p) k from p)"""


@query("p_adjust_holm", f"""with {_P}, a as (select f, least(1, max(p*(m-r+1)) over (partition by f order by p)) q from r) select f, round(sum(q), 6) s, count(*) filter (q < 0.05) hits from a group by f""")
def _(t):
    r = M.p_adjust(_p_values(t), "p", "holm", ["l_suppkey"])
    return r.groupBy(c("l_suppkey").alias("f")).agg(F.round(F.sum("p_adj"), 6).alias("s"), F.sum((c("p_adj") < 0.05).cast("long")).alias("hits"))


@query("p_adjust_bh", f"""with {_P}, a as (select f, least(1, min(p*m/k) over (partition by f order by p desc)) q from r) select f, round(sum(q), 6) s, count(*) filter (q < 0.05) hits from a group by f""")
def _(t):
    r = M.p_adjust(_p_values(t), "p", "bh", ["l_suppkey"])
    return r.groupBy(c("l_suppkey").alias("f")).agg(F.round(F.sum("p_adj"), 6).alias("s"), F.sum((c("p_adj") < 0.05).cast("long")).alias("hits"))


@query("p_adjust_by", f"""with {_P}, h as (select m, sum(1.0/i) h from (select distinct m, unnest(range(1, m+1)) i from r) group by m),
  a as (select f, least(1, min(p*m/k*h) over (partition by f order by p desc)) q from r join h using (m)) select f, round(sum(q), 5) s from a group by f""")
def _(t):
    r = M.p_adjust(_p_values(t), "p", "by", ["l_suppkey"])
    return r.groupBy(c("l_suppkey").alias("f")).agg(F.round(F.sum("p_adj"), 5).alias("s"))


@query("p_adjust_single_step", f"""with {_P} select f, round(sum(least(1, p*m)), 6) bonferroni, round(sum(1-pow(1-p, m)), 6) sidak from r group by f""")
def _(t):
    r = M.p_adjust(M.p_adjust(_p_values(t), "p", "bonferroni", ["l_suppkey"], "b"), "p", "sidak", ["l_suppkey"], "s")
    return r.groupBy(c("l_suppkey").alias("f")).agg(F.round(F.sum("b"), 6).alias("bonferroni"), F.round(F.sum("s"), 6).alias("sidak"))


_PM = "m as (select o_orderpriority g, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v from orders group by 1)"


@query("p211_tukey", f"""with {_PM}, e as (select sum((n-1)*v)/(sum(n)-count(*)) mse from m) select a.g a, b.g b, round(abs(a.m-b.m)/sqrt(mse/2*(1.0/a.n+1.0/b.n)), 6) q
  from m a join m b on a.g < b.g, e""")
def _(t):
    return M.tukey(t.orders, "o_totalprice", "o_orderpriority").select("a", "b", F.round("statistic", 6).alias("q"))


@query("p212_games_howell", f"""with {_PM} select a.g a, b.g b, round(abs(a.m-b.m)/sqrt((a.v/a.n+b.v/b.n)/2), 6) q,
  round(pow(a.v/a.n+b.v/b.n,2)/(pow(a.v/a.n,2)/(a.n-1)+pow(b.v/b.n,2)/(b.n-1)), 3) df from m a join m b on a.g < b.g""")
def _(t):
    return M.games_howell(t.orders, "o_totalprice", "o_orderpriority").select("a", "b", F.round("statistic", 6).alias("q"), F.round(c("numbers")["df"], 3).alias("df"))


@query("p213_dunn", """with r as (select o_orderpriority g, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice)-1)/2.0 r, count(*) over (partition by o_totalprice) t from orders),
  g as (select g, avg(r) m, count(*) n from r group by g), s as (select count(*)::double n, sum(t*t-1.0) ties from r)
  select a.g a, b.g b, round((a.m-b.m)/sqrt((s.n*(s.n+1)/12 - ties/(12*(s.n-1)))*(1.0/a.n+1.0/b.n)), 6) z from g a join g b on a.g < b.g, s""")
def _(t):
    return M.dunn(t.orders, "o_totalprice", "o_orderpriority").select("a", "b", F.round("statistic", 6).alias("z"))


# ---------------------------------------------------------------- table comparison
def _orders_v2(t):
    """Orders with a few keys gone, a few new, some prices and statuses changed, one column renamed."""
    k = c("o_orderkey")
    kept = t.orders.where(k % 50 != 7).select(
        k, "o_custkey", F.when(k % 31 == 0, "X").otherwise(c("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 17 == 0, c("o_totalprice") + k % 5).otherwise(c("o_totalprice")).alias("price_v2"), "o_orderpriority")
    new = t.orders.where(k % 200 == 9).select((k + 100000000).alias("o_orderkey"), "o_custkey", "o_orderstatus", c("o_totalprice").alias("price_v2"), "o_orderpriority")
    return kept.unionByName(new)


_V2 = """b as (select o_orderkey k, case when o_orderkey % 31 = 0 then 'X' else o_orderstatus end s, case when o_orderkey % 17 = 0 then o_totalprice + o_orderkey % 5 else o_totalprice end p
    from orders where o_orderkey % 50 <> 7),
  j as (select o_orderkey k, o_orderstatus s1, s s2, o_totalprice p1, p p2 from orders join b on k = o_orderkey)"""


def _diff(t):
    return X.compare(t.orders, _orders_v2(t), "o_orderkey", pairs={"o_totalprice": "price_v2"})


@query("table_diff_columns", f"""with {_V2}, d as (select count(*) n, count(*) filter (p1 is distinct from p2) dp, count(*) filter (s1 is distinct from s2) ds,
    median(abs(p1-p2)) filter (p1 is distinct from p2) mp, max(abs(p1-p2)) xp from j)
  select 'o_custkey' as column, 'same' status, n n_compared, 0 n_diff, null::double median_abs_diff, null::double max_abs_diff from d union all
  select 'o_orderpriority', 'same', n, 0, null, null from d union all select 'o_orderstatus', 'changed', n, ds, null, null from d union all
  select 'o_totalprice', 'changed', n, dp, round(mp, 6), round(xp, 6) from d union all select 'o_orderdate', 'only_a', null, null, null, null""")
def _(t):
    return _diff(t).columns.select("column", "status", "n_compared", "n_diff", r6("median_abs_diff"), r6("max_abs_diff"))


@query("table_diff_rows", """select o_orderkey::varchar o_orderkey, 'a' side from orders where o_orderkey % 50 = 7 union all
  select (o_orderkey + 100000000)::varchar, 'b' from orders where o_orderkey % 200 = 9""")
def _(t):
    return _diff(t).rows


@query("table_diff_cells", f"""with {_V2} select k::varchar o_orderkey, 'o_orderstatus' as column, s1 as "from", s2 as "to" from j where s1 <> s2""")
def _(t):
    return _diff(t).cells.where(c("column") == "o_orderstatus")


@query("table_diff_summary", f"""with {_V2} select count(*) filter (p1 <> p2) + count(*) filter (s1 <> s2) cells_changed, 2 columns_changed, 1 columns_unmatched,
  (select count(*) from orders where o_orderkey % 50 = 7) rows_removed, (select count(*) from orders where o_orderkey % 200 = 9) rows_added, 0 duplicate_keys, false identical from j""")
def _(t):
    return _diff(t).summary


@query("table_diff_column_view", f"""with {_V2}, u as (select 'a' s, p1 v from j union all select 'b', p2 from j),
  e as (select v, count(*) filter (s='a') n1, count(*) filter (s='b') n2 from u group by v),
  w as (select v, sum(n1) over (order by v) c1, sum(n2) over (order by v) c2, (select count(*) from j) n, lead(v) over (order by v) - v g from e)
  select round((select median(p1) from j), 4) median_a, round((select median(p2) from j), 4) median_b, (select count(*) filter (p1 <> p2) from j) n_changed,
    round(max(abs(c1-c2)/n), 8) ks, round(sum(abs(c1-c2)/n*g), 6) wasserstein from w""")
def _(t):
    r = X.column_view(t.orders, _orders_v2(t), "o_orderkey", "o_totalprice", "price_v2")
    return r.select(F.round("median_a", 4).alias("median_a"), F.round("median_b", 4).alias("median_b"), "n_changed", F.round("ks", 8).alias("ks"), r6("wasserstein"))


@query("table_diff_text_view", f"""with {_V2}, u as (select s1 level, 1 a, 0 b from j union all select s2, 0, 1 from j), g as (select level, sum(a) n_a, sum(b) n_b from u group by level)
  select level, n_a, n_b, round((select sum(abs(n_a-n_b))/2.0/(select count(*) from j) from g), 8) tv from g""")
def _(t):
    return X.column_view_text(t.orders, _orders_v2(t), "o_orderkey", "o_orderstatus").select("level", "n_a", "n_b", F.round("tv", 8).alias("tv"))


# ---------------------------------------------------------------- guardrails
@query("gr01_out_of_range", """with p as (select 'l_discount' as column, l_discount*12 v, 0.0 lo, 1.0 hi from lineitem union all select 'l_tax', l_tax, 0, 1 from lineitem)
  select "column", count(*) filter (v < lo or v > hi)::double n, round(max(v), 8) max from p group by 1 having count(*) filter (v < lo or v > hi) > 0""")
def _(t):
    s = t.lineitem.select((c("l_discount") * 12).alias("l_discount"), "l_tax")
    r = G.out_of_range(s, {"l_discount": "probability", "l_tax": "proportion"}).where("check = 'impossible' and hit")
    return r.select("column", c("numbers")["n"].alias("n"), F.round(c("numbers")["max"], 8).alias("max"))


@query("gr01_boundary_and_tail", """with p as (select 'l_discount' as column, l_discount v from lineitem union all select 'l_tax', l_tax from lineitem),
  q as (select "column", quantile_cont(v, 0.999) cut from p group by 1)
  select p.column, count(*) filter (v = 0 or v = 1)::double edge from p group by 1""")
def _(t):
    r = G.out_of_range(t.lineitem, {"l_discount": "probability", "l_tax": "proportion"}).where("check = 'boundary'")
    return r.select("column", c("numbers")["n"].alias("edge"))


@query("gr01_clip", "select round(sum(least(1, greatest(0, l_discount*12))), 4) s from lineitem")
def _(t):
    s = t.lineitem.select((c("l_discount") * 12).alias("d"))
    return G.apply_action(s, "d", "probability", "clip").agg(F.round(F.sum("d"), 4).alias("s"))


@query("gr02_srm", """with g as (select o_orderstatus g, count(*) o from orders group by 1), e as (select *, sum(o) over ()/count(*) over () e from g)
  select round(sum(pow(o-e,2)/e), 6) chi2, sum(o)::double n from e""")
def _(t):
    return G.srm(t.orders, "o_orderstatus").select(F.round(c("numbers")["chi2"], 6).alias("chi2"), c("numbers")["n"].alias("n"))


@query("gr02_srm_by_dimension", """with l as (select o_orderstatus g, o_orderpriority level from orders), k as (select level, g, count(*) o from l group by all),
  e as (select *, sum(o) over (partition by level)/count(*) over (partition by level) e from k) select level, round(sum(pow(o-e,2)/e), 6) chi2 from e group by level""")
def _(t):
    return G.srm_by_dimension(t.orders, "o_orderstatus", ["o_orderpriority"]).select("level", F.round(c("numbers")["chi2"], 6).alias("chi2"))


def _kept(t):
    return t.orders.where(~((c("o_totalprice") > 300000) & (c("o_orderkey") % 3 == 0)))


@query("gr02_counterfactual", """with g as (select o_orderstatus g, count(*) o from orders group by 1), e as (select *, sum(o) over ()/count(*) over () e from g) select sum(o)::double n from e""")
def _(t):
    lost = t.orders.where((c("o_totalprice") > 300000) & (c("o_orderkey") % 3 == 0))
    return G.srm_counterfactual(_kept(t), lost, "o_orderstatus").select(c("numbers")["n"].alias("n"))


@query("gr03_funnel", """with s as (select count(*)::double a from orders), b as (select count(*)::double b from orders where o_totalprice > 50000), d as (select count(*)::double d from orders where o_totalprice > 50000 and o_orderstatus = 'F')
  select 'big' level, a n_before, b n_after, round(b/a, 8) rate from s, b union all select 'final', b, d, round(d/b, 8) from b, d""")
def _(t):
    big = t.orders.where("o_totalprice > 50000")
    r = G.retention_funnel([("all", t.orders), ("big", big), ("final", big.where("o_orderstatus = 'F'"))])
    n = c("numbers")
    return r.select("level", n["n_before"].alias("n_before"), n["n_after"].alias("n_after"), F.round(n["rate"], 8).alias("rate"))


_LOST = "l as (select *, (o_totalprice > 300000 and o_orderkey % 3 = 0) lost from orders)"


@query("gr03_loss_by_group", f"""with {_LOST}, g as (select o_orderpriority, avg(lost::int) r, count(*) n, sum(lost::int) k from l group by 1)
  select round(sum(k)/sum(n), 8) overall, round(max(r)-min(r), 8) spread from g""")
def _(t):
    f = G.flag_lost(t.orders, _kept(t), ["o_orderkey"])
    n = c("numbers")
    return G.loss_by_group(f, "o_orderpriority").select(F.round(n["overall"], 8).alias("overall"), F.round(n["spread"], 8).alias("spread"))


@query("gr03_biased_loss", f"""with {_LOST} select 'o_totalprice' as column, round(abs(avg(o_totalprice) filter (lost) - avg(o_totalprice) filter (not lost))
  / sqrt((var_samp(o_totalprice) filter (lost) + var_samp(o_totalprice) filter (not lost))/2), 6) smd, true hit from l""")
def _(t):
    f = G.flag_lost(t.orders, _kept(t), ["o_orderkey"])
    return G.biased_loss(f, ["o_totalprice"]).select("column", F.round(c("numbers")["smd"], 6).alias("smd"), "hit")


@query("gr03_join_rate", """select count(*)::double n_left, count(*) filter (o_custkey in (select c_custkey from customer where c_mktsegment <> 'BUILDING'))::double n_matched from orders""")
def _(t):
    right = t.customer.where("c_mktsegment <> 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    n = c("numbers")
    return G.join_rate(t.orders, right, ["o_custkey"]).select(n["n_left"].alias("n_left"), n["n_matched"].alias("n_matched"))


@query("gr04_group_balance", """with g as (select c_nationkey, count(*) n from customer group by 1) select round(max(n)/min(n), 8) ratio, min(n)::double min_n, max(n)/min(n) > 1.5 hit from g""")
def _(t):
    n = c("numbers")
    return G.group_balance(t.customer, "c_nationkey").where("check = 'imbalance'").select(F.round(n["ratio"], 8).alias("ratio"), n["min_n"].alias("min_n"), "hit")


@query("gr04_coverage", """select 'a' as column, round(count(a)/count(*), 8) coverage from (select case when l_orderkey % 3 = 0 then l_tax end a from lineitem) union all
  select 'b', round(count(b)/count(*), 8) from (select l_tax b from lineitem)""")
def _(t):
    s = t.lineitem.select(F.when(c("l_orderkey") % 3 == 0, c("l_tax")).alias("a"), c("l_tax").alias("b"))
    return G.coverage(s, ["a", "b"]).select("column", F.round(c("numbers")["coverage"], 8).alias("coverage"))


@query("gr04_smd", """with l as (select * from lineitem where l_returnflag in ('A','R')), n as (
    select 'l_quantity' as column, abs(avg(l_quantity) filter (l_returnflag='A') - avg(l_quantity) filter (l_returnflag='R'))/sqrt((var_samp(l_quantity) filter (l_returnflag='A') + var_samp(l_quantity) filter (l_returnflag='R'))/2) smd from l),
  t as (select l_linestatus, count(*) filter (l_returnflag='A')/(select count(*) from l where l_returnflag='A')::double p, count(*) filter (l_returnflag='R')/(select count(*) from l where l_returnflag='R')::double q from l group by 1)
  select "column", round(smd, 8) smd from n union all select 'l_linestatus', round(sum(abs(p-q))/sqrt(sum((p+q)/2*(1-(p+q)/2))), 8) from t""")
def _(t):
    r = G.smd_imbalance(t.lineitem, "l_returnflag", ["l_quantity", "l_linestatus"], ["A", "R"])
    return r.select("column", F.round(c("numbers")["smd"], 8).alias("smd"))


@query("gr04_stability")
def _(t):
    small = t.orders.withColumn("g", F.when(c("o_orderkey") % 1999 == 0, "rare").otherwise("common"))
    return G.metric_stability(small, "g", "o_totalprice", ["o_orderkey"])


@query("guard_pipeline")
def _(t):
    return G.run_guard(_kept(t).withColumn("x", c("o_totalprice") / 300000), {"x": "probability"}, "o_orderstatus", ["o_orderpriority"], ["o_totalprice"],
                       before=t.orders, key=["o_orderkey"])


# ---------------------------------------------------------------- model-data audits: orders split by key
def model_spec(t):
    o = t.orders.join(t.customer.select(c("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment"), "o_custkey").withColumn(
        "label", (c("o_orderstatus") == "F").cast("int")).withColumn("half", c("o_totalprice") / 2 + c("o_orderkey") % 7).withColumn(
        "prob", F.pmod(c("o_orderkey") * 37 + c("o_custkey"), F.lit(1000)) / 1000.0 * 0.8 + c("label") * 0.2)
    cols = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "half", "c_acctbal", "c_mktsegment", "label", "prob"]
    k = c("o_orderkey") % 10
    test = o.where(k == 8).unionByName(o.where("o_orderkey % 400 = 3"))
    return A.ModelSpec({"train": o.where(k < 8).select(*cols), "test": test.select(*cols), "external": o.where(k == 9).select(*cols)}, "label",
                       ("o_totalprice", "half", "c_acctbal", "c_mktsegment"), group="o_custkey", time="o_orderdate", score="prob", positive="1",
                       planned={"train": 0.8, "test": 0.1})


_MS = """o as (select orders.*, c_acctbal, c_mktsegment, (o_orderstatus='F')::int label, o_totalprice/2 + o_orderkey % 7 half,
    ((o_orderkey*37+o_custkey) % 1000)/1000.0*0.8 + (o_orderstatus='F')::int*0.2 prob from orders join customer on c_custkey = o_custkey),
  tr as (select * from o where o_orderkey % 10 < 8), te as (select * from o where o_orderkey % 10 = 8 union all select * from o where o_orderkey % 400 = 3),
  ex as (select * from o where o_orderkey % 10 = 9)"""


@query("mb_c01_duplicates", f"""with {_MS}, f as (select distinct o_totalprice, half, c_acctbal, c_mktsegment from tr)
  select 'test' as role, count(*)::double exact from te semi join f using (o_totalprice, half, c_acctbal, c_mktsegment) union all
  select 'external', count(*)::double from ex semi join f using (o_totalprice, half, c_acctbal, c_mktsegment)""")
def _(t):
    return A.duplicate_audit(model_spec(t)).select("role", c("numbers")["exact"].alias("exact"))


@query("mb_c01_near_duplicates", f"""with {_MS}, s as (select stddev_pop(o_totalprice) a, stddev_pop(c_acctbal) b from tr)
  select count(*) n from te where exists (select 1 from tr, s where abs(tr.o_totalprice-te.o_totalprice)/a <= 0.001 and abs(tr.c_acctbal-te.c_acctbal)/b <= 0.001)""")
def _(t):
    s = model_spec(t).sets
    return A.near_duplicates(s["train"], s["test"], ["o_totalprice", "c_acctbal"]).agg(F.count(F.lit(1)).alias("n"))


@query("mb_c02_group_crossing", f"""with {_MS} select 'test' as role, count(distinct o_custkey)::double as groups, count(*)::double as rows from te where o_custkey in (select o_custkey from tr) union all
  select 'external', count(distinct o_custkey)::double, count(*)::double from ex where o_custkey in (select o_custkey from tr)""")
def _(t):
    n = c("numbers")
    return A.group_crossing(model_spec(t)).select("role", n["groups"].alias("groups"), n["rows"].alias("rows"))


@query("mb_c03_time_overlap", f"""with {_MS}, e as (select max(o_orderdate) m from tr) select 'test' as role, count(*) filter (o_orderdate <= m)::double rows_inside from te, e union all
  select 'external', count(*) filter (o_orderdate <= m)::double from ex, e""")
def _(t):
    return A.time_overlap(model_spec(t)).select("role", c("numbers")["rows_inside"].alias("rows_inside"))


@query("mb_c05_label_proxy", f"""with {_MS}, l as (select 'o_totalprice' as column, o_totalprice v, label from tr union all select 'half', half, label from tr union all select 'c_acctbal', c_acctbal, label from tr),
  r as (select *, rank() over (partition by "column" order by v) + (count(*) over (partition by "column", v)-1)/2.0 r from l),
  a as (select "column", (sum(r) filter (label=1) - count(*) filter (label=1)*(count(*) filter (label=1)+1)/2.0)/(count(*) filter (label=1)*count(*) filter (label=0)) a from r group by 1)
  select "column", round(greatest(a, 1-a), 8) auc from a""")
def _(t):
    return A.label_proxy(model_spec(t)).select("column", F.round(c("numbers")["auc"], 8).alias("auc"))


@query("mb_c06_split", f"""with {_MS}, u as (select 'train' as role, label from tr union all select 'test', label from te union all select 'external', label from ex),
  k as (select role, label, count(*) o from u group by all), e as (select *, sum(o) over (partition by role)*sum(o) over (partition by label)/sum(o) over () e from k),
  p as (select role, count(*) o from u where role <> 'external' group by 1), q as (select *, sum(o) over ()*case role when 'train' then 8/9.0 else 1/9.0 end e from p)
  select role, round(sum(pow(o-e,2)/e), 6) chi2 from e group by role union all select 'planned', round(sum(pow(o-e,2)/e), 6) from q""")
def _(t):
    return A.split_ratio(model_spec(t)).select("role", F.round(c("numbers")["chi2"], 6).alias("chi2"))


@query("mb_c06_class_mix", f"""with {_MS}, u as (select 'dev' as role, label from tr union all select 'dev', label from te union all select 'ext', label from ex)
  select role, label::varchar level, count(*) n, round(count(*)/sum(count(*)) over (partition by role), 8) ratio from u group by role, label""")
def _(t):
    return A.class_mix(model_spec(t), dev_external=True).withColumn("ratio", F.round("ratio", 8))


@query("mb_c07_source_coverage", f"""with {_MS}, u as (select o_orderkey from tr union select o_orderkey from te union select o_orderkey from ex)
  select count(*)::double as rows, count(*) filter (o_orderkey not in (select o_orderkey from u))::double lost from orders""")
def _(t):
    r = A.source_coverage(t.orders.withColumn("label", (c("o_orderstatus") == "F").cast("int")), model_spec(t), ["o_orderkey"]).where("role = 'source'")
    n = c("numbers")
    return r.select(n["rows"].alias("rows"), n["lost"].alias("lost"))


@query("mb_c07_before_after", f"""with {_LOST} select count(*) n_before, round(avg(o_totalprice), 4) mean_before, count(*) filter (not lost) n_after, round(avg(o_totalprice) filter (not lost), 4) mean_after from l""")
def _(t):
    r = A.before_after(G.flag_lost(t.orders, _kept(t), ["o_orderkey"]), "o_totalprice")
    return r.select("n_before", F.round("mean_before", 4).alias("mean_before"), "n_after", F.round("mean_after", 4).alias("mean_after"))


@query("mb_c08_class_balance", f"""with {_MS}, u as (select label from tr union all select label from te), g as (select label, count(*) n from u group by 1) select min(n)::double n_minority, round(max(n)/min(n), 8) ratio from g""")
def _(t):
    n = c("numbers")
    return A.class_balance(model_spec(t)).select(n["n_minority"].alias("n_minority"), F.round(n["ratio"], 8).alias("ratio"))


@query("mb_c08_shortcut", f"""with {_MS}, u as (select label, c_acctbal from tr union all select label, c_acctbal from te)
  select 'c_acctbal' as column, round(abs(avg(c_acctbal) filter (label=1) - avg(c_acctbal) filter (label=0))/sqrt((var_samp(c_acctbal) filter (label=1)+var_samp(c_acctbal) filter (label=0))/2), 8) smd from u""")
def _(t):
    return A.shortcut_risk(model_spec(t), ["c_acctbal"]).select("column", F.round(c("numbers")["smd"], 8).alias("smd"))


@query("mb_c08_external_shift", f"""with {_MS}, d as (select c_acctbal, o_totalprice from tr union all select c_acctbal, o_totalprice from te)
  select 'c_acctbal' as column, round(abs((select avg(c_acctbal) from d) - (select avg(c_acctbal) from ex))/sqrt(((select var_samp(c_acctbal) from d)+(select var_samp(c_acctbal) from ex))/2), 8) smd union all
  select 'o_totalprice', round(abs((select avg(o_totalprice) from d) - (select avg(o_totalprice) from ex))/sqrt(((select var_samp(o_totalprice) from d)+(select var_samp(o_totalprice) from ex))/2), 8)""")
def _(t):
    r = A.external_shift(model_spec(t)).where(c("column").isin("c_acctbal", "o_totalprice"))
    return r.select("column", F.round(c("numbers")["smd"], 8).alias("smd"))


@query("mb_c10_scale_spread", f"""with {_MS}, u as (select o_totalprice, half, c_acctbal from tr union all select o_totalprice, half, c_acctbal from te),
  s as (select 'o_totalprice' as column, stddev_pop(o_totalprice) sd from u union all select 'half', stddev_pop(half) from u union all select 'c_acctbal', stddev_pop(c_acctbal) from u)
  select "column", round(sd/min(sd) over (), 6) ratio, round(sd*sd/sum(sd*sd) over (), 8) variance_share from s""")
def _(t):
    n = c("numbers")
    return A.scale_spread(model_spec(t)).select("column", F.round(n["ratio"], 6).alias("ratio"), F.round(n["variance_share"], 8).alias("variance_share"))


@query("mb_c13_label_levels", f"""with {_MS}, u as (select 'train' as role, label from tr union all select 'test', label from te union all select 'external', label from ex),
  l as (select distinct role, label from u), g as (select r.role, v.label from (select distinct role from u) r cross join (select distinct label from u) v)
  select g.role, count(*) filter (l.label is not null and g.label not in (select label from tr))::double unseen, count(*) filter (l.label is null)::double absent
  from g left join l on l.role = g.role and l.label = g.label group by 1""")
def _(t):
    n = c("numbers")
    return A.label_levels(model_spec(t)).select("role", n["unseen"].alias("unseen"), n["absent"].alias("absent"))


@query("mb_c15_events_per_variable", f"""with {_MS}, g as (select label, count(*) n from tr group by 1) select min(n)::double events, round(min(n)/4.0, 6) epv from g""")
def _(t):
    n = c("numbers")
    return A.events_per_variable(model_spec(t)).select(n["events"].alias("events"), F.round(n["epv"], 6).alias("epv"))


_ROC = """v as (select prob s, count(*) n, sum(label) pos from te group by 1), w as (select *, sum(n) over (order by s desc) cn, sum(pos) over (order by s desc) cp,
    sum(n-pos) over (order by s) - (n-pos) below, sum(pos) over () tp, sum(n) over () tn from v)"""


@query("mb_c16_roc_pr", f"""with {_MS}, {_ROC} select round(sum(pos*(below+(n-pos)/2.0))/(max(tp)*(max(tn)-max(tp))), 8) roc_auc, round(sum(pos*cp/cn::double)/max(tp), 8) pr_auc,
  round(max(tp)/max(tn), 8) base_rate from w""")
def _(t):
    n = c("numbers")
    return A.metric_pair(model_spec(t)).select(*[F.round(n[k], 8).alias(k) for k in ("roc_auc", "pr_auc", "base_rate")])


@query("mb_c18_recall", f"""with {_MS} select label::varchar as column, count(*)::double n, round(avg(((prob >= 0.5)::int = label)::int), 8) recall from te group by label""")
def _(t):
    n = c("numbers")
    return A.class_recall(model_spec(t)).select("column", n["n"].alias("n"), F.round(n["recall"], 8).alias("recall"))


@query("mb_c19_calibration", f"""with {_MS}, b as (select least(9, floor(prob*10)) b, count(*) n, avg(prob) p, avg(label) a from te group by 1)
  select round(sum(n*abs(p-a))/sum(n), 8) ece, round(max(abs(p-a)) filter (n >= 10), 8) worst_gap from b""")
def _(t):
    n = c("numbers")
    return A.calibration(model_spec(t)).select(F.round(n["ece"], 8).alias("ece"), F.round(n["worst_gap"], 8).alias("worst_gap"))


@query("mb_c22_folds", f"""with {_MS}, f as (select o_orderkey % 5 k, avg(((prob >= 0.5)::int = label)::int) score from tr group by 1)
  select count(*)::double folds, round(avg(score), 8) mean, round(stddev_samp(score), 8) sd, round(min(score), 8) worst from f""")
def _(t):
    tr = model_spec(t).sets["train"]
    f = tr.groupBy((c("o_orderkey") % 5).alias("k")).agg(F.avg(((c("prob") >= 0.5).cast("int") == c("label")).cast("double")).alias("score"))
    n = c("numbers")
    return A.fold_scores(f).select(n["folds"].alias("folds"), *[F.round(n[k], 8).alias(k) for k in ("mean", "sd", "worst")])


@query("mb_c28_separation", f"""with {_MS}, u as (select * from tr union all select * from te), l as (select 'o_totalprice' as column, o_totalprice v, label from u union all select 'half', half, label from u
    union all select 'c_acctbal', c_acctbal, label from u), s as (select "column", min(v) filter (label=1) la, max(v) filter (label=1) ha, min(v) filter (label=0) lb, max(v) filter (label=0) hb, max(v)-min(v) sp from l group by 1)
  select "column", round((least(ha,hb)-greatest(la,lb))/sp, 8) overlap from s""")
def _(t):
    return A.separation(model_spec(t)).select("column", F.round(c("numbers")["overlap"], 8).alias("overlap"))


@query("mb_c31_correlated_pairs", f"""with {_MS}, u as (select * from tr union all select * from te) select 'o_totalprice|half' as column, round(corr(o_totalprice, half), 8) r, 'fail' verdict from u union all
  select 'o_totalprice|c_acctbal', round(corr(o_totalprice, c_acctbal), 8), 'pass' from u union all select 'half|c_acctbal', round(corr(half, c_acctbal), 8), 'pass' from u""")
def _(t):
    return A.correlated_pairs(model_spec(t)).select("column", F.round(c("numbers")["r"], 8).alias("r"), "verdict")


@query("mb_c29_vif")
def _(t):
    return A.collinear(model_spec(t)).select("column", "verdict")


@query("audit_report")
def _(t):
    return A.report(model_spec(t)).select("check", "role", "column", "verdict")
