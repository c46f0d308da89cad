"""Group comparisons: moments, ranks, distribution shape."""
from pyspark.sql import functions as F

from statweave.operators import group_tests as G, rank_tests as R
from statweave.plans.common import flat
from workload.registry import query

_PAIR = """c as (select l_linestatus, count(l_extendedprice) filter (l_returnflag = 'A') n1,
  avg(l_extendedprice) filter (l_returnflag = 'A') m1, var_samp(l_extendedprice) filter (l_returnflag = 'A') v1,
  count(l_extendedprice) filter (l_returnflag = 'R') n2, avg(l_extendedprice) filter (l_returnflag = 'R') m2,
  var_samp(l_extendedprice) filter (l_returnflag = 'R') v2 from lineitem group by l_linestatus)"""
_G = "(m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1+n2-2)) * (1 - 3.0 / (4*(n1+n2) - 9))"
_MOM = """m as (select o_orderpriority g, count(o_totalprice) n, avg(o_totalprice) m, var_samp(o_totalprice) v
  from orders group by 1), a as (select *, sum(n*m) over () / sum(n) over () gm from m)"""
_ETA = "sum(n*(m-gm)*(m-gm)) / (sum(n*(m-gm)*(m-gm)) + sum((n-1)*v))"


@query("t101_welch_t", f"""with {_PAIR} select l_linestatus, round((m1-m2)/sqrt(v1/n1+v2/n2), 6) statistic,
  round({_G}, 6) effect, round(m1-m2, 6) mean_diff, round(sqrt(v1/n1+v2/n2), 6) se,
  round(pow(v1/n1+v2/n2, 2) / (pow(v1/n1,2)/(n1-1) + pow(v2/n2,2)/(n2-1)), 3) df from c""")
def _(t):
    r = G.welch_t(t.lineitem, "l_extendedprice", "l_returnflag", ["A", "R"], by=["l_linestatus"])
    return flat(r, ["mean_diff", "se", "df"], ["l_linestatus"]).withColumn("df", F.round("df", 3))


@query("t102_student_t", f"""with {_PAIR} select l_linestatus, round((m1-m2) /
  sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0/n1+1.0/n2)), 6) statistic, round({_G}, 6) effect from c""")
def _(t):
    return flat(G.student_t(t.lineitem, "l_extendedprice", "l_returnflag", ["A", "R"], by=["l_linestatus"]),
                by=["l_linestatus"])


@query("t105_permutation_t")
def _(t):
    return G.permutation_t(t.orders, "o_totalprice", "o_orderstatus", levels=["F", "O"])


@query("t121_anova", f"""with {_MOM} select round(sum(n*(m-gm)*(m-gm))/(count(*)-1) / (sum((n-1)*v)/(sum(n)-count(*))), 6)
  statistic, round({_ETA}, 9) effect from a""")
def _(t):
    return flat(G.anova(t.orders, "o_totalprice", "o_orderpriority"), digits=9).withColumn("statistic", F.round("statistic", 6))


@query("t122_alexander_govern", f"""with m as (select o_orderpriority g, count(o_totalprice) n, avg(o_totalprice) m,
    var_samp(o_totalprice) v from orders group by 1),
  w as (select *, sum(n/v*m) over () / sum(n/v) over () p, sum(n*m) over () / sum(n) over () gm from m),
  s as (select *, (m-p)/sqrt(v/n) t, n-1.5 a, 48*(n-1.5)*(n-1.5) b from w),
  q as (select *, sqrt(a*ln(1+t*t/(n-1))) c from s),
  z as (select *, c + (pow(c,3)+3*c)/b - (4*pow(c,7)+33*pow(c,5)+240*pow(c,3)+855*c)/(10*b*b+8*b*pow(c,4)+1000*b) z from q)
  select round(sum(z*z), 6) statistic, round({_ETA}, 6) effect from z""")
def _(t):
    return flat(G.alexander_govern(t.orders, "o_totalprice", "o_orderpriority"))


@query("welch_anova_f", """with m as (select o_orderpriority g, count(o_totalprice) n, avg(o_totalprice) m,
    var_samp(o_totalprice) v from orders group by 1),
  w as (select *, n/v w, sum(n/v) over () sw, sum(n/v*m) over () / sum(n/v) over () gm, count(*) over () k from m)
  select round(sum(w*(m-gm)*(m-gm))/(max(k)-1) / (1 + 2*(max(k)-2)/(max(k)*max(k)-1.0)*sum(pow(1-w/sw,2)/(n-1))), 6) statistic,
    round((max(k)*max(k)-1)/(3*sum(pow(1-w/sw,2)/(n-1))), 3) df2 from w""")
def _(t):
    return G.welch_anova(t.orders, "o_totalprice", "o_orderpriority").select(
        F.round("statistic", 6).alias("statistic"), F.round(F.col("numbers")["df2"], 3).alias("df2"))


@query("t124_permutation_f")
def _(t):
    return G.permutation_f(t.orders, "o_totalprice", "o_orderpriority")


_W = """w(g, i, wt) as (values ('1-URGENT',0,2.0), ('2-HIGH',1,1.0), ('3-MEDIUM',2,0.0), ('4-NOT SPECIFIED',3,-1.0), ('5-LOW',4,-2.0))"""
_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("t1101_planned_contrast", f"""with {_MOM}, {_W}, s as (select sum(wt*m) val, sqrt(sum((n-1)*v)/(sum(n)-count(*))*sum(wt*wt/n)) se
  from m join w using (g)) select round(val/se, 6) statistic, round(val, 4) effect, round(se, 4) se from s""")
def _(t):
    r = G.planned_contrast(t.orders, "o_totalprice", "o_orderpriority", [2, 1, 0, -1, -2], _PRIO)
    return r.select(
        F.round("statistic", 6).alias("statistic"), F.round("effect.value", 4).alias("effect"),
        F.round(F.col("numbers")["se"], 4).alias("se"))


@query("t1102_dunnett", f"""with {_MOM}, e as (select sum((n-1)*v)/(sum(n)-count(*)) mse from m),
  r as (select n nc, m mc from m where g = '1-URGENT')
  select g comparison, round((m-mc)/sqrt(mse*(1.0/n+1.0/nc)), 6) statistic, round(m-mc, 4) effect
  from m, e, r where g <> '1-URGENT'""")
def _(t):
    r = G.dunnett(t.orders, "o_totalprice", "o_orderpriority", "1-URGENT", _PRIO)
    return r.select("comparison", F.round("statistic", 6).alias("statistic"), F.round("effect.value", 4).alias("effect"))


@query("t1103_helmert", f"""with {_MOM}, e as (select sum((n-1)*v)/(sum(n)-count(*)) mse from m),
  h as (select x.g contrast, y.g, case when y.g = x.g then 5 - cast(x.g[1] as int) else -1.0 end wt
        from m x join m y on y.g >= x.g where x.g < '5-LOW')
  select contrast, round(sum(wt*m)/sqrt(max(mse)*sum(wt*wt/n)), 6) statistic, round(sum(wt*m), 4) effect
  from h join m using (g), e group by contrast""")
def _(t):
    r = G.helmert(t.orders, "o_totalprice", "o_orderpriority", _PRIO)
    return r.select("contrast", F.round("statistic", 6).alias("statistic"), F.round("effect.value", 4).alias("effect"))


# ---------------------------------------------------------------- ranks
_RANKED = """r as (select l_linestatus s, l_returnflag g, l_quantity y,
    rank() over (partition by l_linestatus order by l_quantity) + (count(*) over (partition by l_linestatus, l_quantity) - 1) / 2.0 r,
    rank() over (partition by l_linestatus, l_returnflag order by l_quantity)
      + (count(*) over (partition by l_linestatus, l_returnflag, l_quantity) - 1) / 2.0 w
    from lineitem where l_returnflag in ('A', 'R'))"""


@query("t103_mann_whitney", f"""with {_RANKED}, s as (select s, sum(r) filter (g='A') ra, count(*) filter (g='A') n1, count(*) filter (g='R') n2
    from r group by s)
  select s l_linestatus, round(ra - n1*(n1+1)/2, 1) statistic, round(2*(ra - n1*(n1+1)/2)/(n1*n2) - 1, 8) effect from s""")
def _(t):
    r = R.mann_whitney(t.lineitem, "l_quantity", "l_returnflag", ["A", "R"], by=["l_linestatus"])
    return r.select("l_linestatus", F.round("statistic", 1).alias("statistic"), F.round("effect.value", 8).alias("effect"))


@query("t104_brunner_munzel", f"""with {_RANKED}, m as (select s, avg(r) filter (g='A') ma, avg(r) filter (g='R') mb,
    count(*) filter (g='A') n1, count(*) filter (g='R') n2, var_samp(r-w) filter (g='A') s1, var_samp(r-w) filter (g='R') s2
    from r group by s)
  select s l_linestatus, round(n1*n2*(mb-ma)/((n1+n2)*sqrt(n1*s1+n2*s2)), 6) statistic,
    round((ma - (n1+1)/2.0)/n2, 8) effect from m""")
def _(t):
    r = R.brunner_munzel(t.lineitem, "l_quantity", "l_returnflag", ["A", "R"], by=["l_linestatus"])
    return r.select("l_linestatus", F.round("statistic", 6).alias("statistic"), F.round("effect.value", 8).alias("effect"))


@query("t123_kruskal_wallis", """with r as (select o_orderpriority g, rank() over (order by o_totalprice)
    + (count(*) over (partition by o_totalprice)-1)/2.0 r, count(*) over (partition by o_totalprice) t from orders),
  k as (select sum(n) n, count(*) k, 12/(sum(n)*(sum(n)+1.0))*sum(s*s/n) - 3*(sum(n)+1) h from
    (select g, count(*) n, sum(r) s from r group by g)),
  c as (select 1 - sum(t*t-1.0)/(power(count(*),3)-count(*)) c from r)
  select round(h/c, 6) statistic, round(greatest(0, (h/c - k + 1)/(n-k)), 9) effect from k, c""")
def _(t):
    r = R.kruskal(t.orders, "o_totalprice", "o_orderpriority", _PRIO)
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("effect.value", 9).alias("effect"))


@query("t1104_pooled_contrast", """with r as (select case when o_orderpriority in ('1-URGENT','2-HIGH') then 1 else 2 end g,
    rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice)-1)/2.0 r
    from orders where o_orderpriority <> '3-MEDIUM'),
  s as (select sum(r) filter (g=1) ra, count(*) filter (g=1) n1, count(*) filter (g=2) n2 from r)
  select round(ra - n1*(n1+1)/2, 1) statistic, round(2*(ra - n1*(n1+1)/2)/(n1*n2)-1, 8) effect from s""")
def _(t):
    r = R.pooled_contrast(t.orders, "o_totalprice", "o_orderpriority", [2, 1, 0, -1, -2], _PRIO)
    return r.select(F.round("statistic", 1).alias("statistic"), F.round("effect.value", 8).alias("effect"))


@query("t501_jonckheere", """with g as (select o_orderpriority[1]::int g, o_totalprice y, count(*) n from orders group by all),
  c as (select *, sum(n) over (order by y range between unbounded preceding and current row) cum from g),
  p as (select g.g gj, g.y, g.n from g g),
  b as (select k.g, v.y, v.n, coalesce(sum(k2.n) filter (k2.y < v.y), 0) lo, coalesce(sum(k2.n) filter (k2.y = v.y), 0) eq
        from g v join (select distinct g from g) k on k.g = v.g left join g k2 on k2.g < v.g and k2.y <= v.y group by all),
  j as (select sum(n*(lo + eq/2.0)) jt, sum(n*lo) con, sum(n*eq) tp from b),
  z as (select g, sum(n)::double n from g group by g),
  s as (select sum(n) n, sum(n*n) q, sum(n*n*(2*n+3)) c, sum(n*(n-1)/2) tx from z),
  ty as (select sum(t*(t-1)/2) ty from (select y, sum(n)::double t from g group by y))
  select round((jt - (n*n-q)/4)/sqrt((n*n*(2*n+3)-c)/72), 6) statistic,
    round((2*con - ((n*(n-1)/2 - tx) - tp))/sqrt((n*(n-1)/2 - tx)*(n*(n-1)/2 - ty)), 8) effect from j, s, ty""")
def _(t):
    r = R.jonckheere(t.orders, "o_totalprice", "o_orderpriority", _PRIO)
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("effect.value", 8).alias("effect"))


_ECDF = """v as (select l_extendedprice y, count(*) filter (l_returnflag='A') n1, count(*) filter (l_returnflag='R') n2
    from lineitem where l_returnflag in ('A','R') group by 1),
  e as (select y, n1, n2, sum(n1) over (order by y) c1, sum(n2) over (order by y) c2, sum(n1) over () t1, sum(n2) over () t2,
    lead(y) over (order by y) nx from v)"""


@query("t701_ks", f"""with {_ECDF} select round(max(abs(c1/t1::double - c2/t2::double)), 8) statistic from e""")
def _(t):
    return R.ks_two_sample(t.lineitem, "l_extendedprice", "l_returnflag", ["A", "R"]).select(
        F.round("statistic", 8).alias("statistic"))


@query("t702_anderson_darling", """with v as (select o_totalprice y, o_orderpriority g, count(*) f from orders group by all),
  z as (select y, sum(f)::double l from v group by y), zz as (select y, l, sum(l) over (order by y) - l/2 b, sum(l) over () n from z),
  g as (select g, sum(f)::double ni from v group by g),
  x as (select zz.*, g.g, ni, coalesce(f, 0) f from zz cross join g left join v on v.y = zz.y and v.g = g.g),
  m as (select *, sum(f) over (partition by g order by y) - f/2.0 mij from x)
  select round((max(n)-1)/max(n)*sum(l/n*pow(n*mij - b*ni, 2)/(b*(n-b) - n*l/4)/ni), 6) a2 from m
  where b*(n-b) - n*l/4 > 0""")
def _(t):
    return R.anderson_darling(t.orders, "o_totalprice", "o_orderpriority", _PRIO).select(
        F.round(F.col("numbers")["a2"], 6).alias("a2"))


@query("t703_energy", f"""with {_ECDF} select round(sqrt(2*sum(pow(c1/t1::double - c2/t2::double, 2)*(nx-y))), 6) statistic,
  round(sum(abs(c1/t1::double - c2/t2::double)*(nx-y)), 5) wasserstein from e""")
def _(t):
    r = R.energy_distance(t.lineitem, "l_extendedprice", "l_returnflag", ["A", "R"], permutations=0)
    return r.select(F.round("statistic", 6).alias("statistic"), F.round(F.col("numbers")["wasserstein"], 5).alias("wasserstein"))


@query("t703_energy_permuted", """with l as (select l_extendedprice*l_discount y, l_discount > 0.05 many from lineitem),
  v as (select y, count(*) filter (many) f1, count(*) filter (not many) f2 from l group by 1),
  e as (select y, lead(y) over (order by y) nx, sum(f1) over (order by y) c1, sum(f2) over (order by y) c2, sum(f1) over () t1, sum(f2) over () t2 from v)
  select round(sqrt(2*sum(pow(c1/t1::double - c2/t2::double, 2)*(nx-y))), 6) statistic, 1/1000.0::double p from e""")      # no relabelling of 999 reaches a gap like this
def _(t):
    rows = t.lineitem.select((F.col("l_extendedprice") * F.col("l_discount")).alias("y"), (F.col("l_discount") > 0.05).alias("many"))
    return R.energy_distance(rows, "y", "many", ["true", "false"]).select(F.round("statistic", 6).alias("statistic"), "p")


@query("t704_cramer_von_mises", """with r as (select l_returnflag g, l_extendedprice y,
    rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice)-1)/2.0 r,
    row_number() over (partition by l_returnflag order by l_extendedprice) i from lineitem where l_returnflag in ('A','R')),
  s as (select sum(pow(r-i,2)) filter (g='A') q1, sum(pow(r-i,2)) filter (g='R') q2, count(*) filter (g='A')::double a,
    count(*) filter (g='R')::double b from r)
  select round((a*q1+b*q2)/(a*b*(a+b)) - (4*a*b-1)/(6*(a+b)), 6) statistic from s""")
def _(t):
    return R.cramer_von_mises(t.lineitem, "l_extendedprice", "l_returnflag", ["A", "R"]).select(
        F.round("statistic", 6).alias("statistic"))
