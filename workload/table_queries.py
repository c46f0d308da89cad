"""Contingency tables and agreement of categories."""
from pyspark.sql import functions as F

from statweave.operators import table_tests as T
from statweave.plans.common import flat
from workload.registry import query

_GRID = """c as (select o_orderstatus a, o_orderpriority b, count(*) o from orders group by all),
  m as (select x.a, y.b, coalesce(o, 0)::double o, rn::double*cn/(sum(rn) over (partition by y.b)) e, cn,
        rn, sum(rn) over (partition by y.b) n from (select a, sum(o) rn from c group by a) x
        cross join (select b, sum(o) cn from c group by b) y left join c on c.a = x.a and c.b = y.b),
  s as (select sum(pow(o-e,2)/e) chi2, sum(case when o>0 then 2*o*ln(o/e) else 0 end) g, max(n) n,
    max(abs(o/cn - rn/n)) gap, sqrt(sum(pow(o-e,2)/e)/(max(n)*(least(count(distinct a), count(distinct b))-1))) v from m)"""


@query("t201_chi_square", f"with {_GRID} select round(chi2, 6) statistic, round(v, 8) effect from s")
def _(t):
    r = T.chi_square(t.orders, "o_orderstatus", "o_orderpriority")
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("effect.value", 8).alias("effect"))


_TWO = """c as (select l_shipdate < timestamp '1995-06-17' s, l_linestatus, l_returnflag, l_quantity from lineitem),
  k as (select s, count(*) filter (l_linestatus='F' and l_returnflag<>'R')::double a, count(*) filter (l_linestatus='F' and l_returnflag='R')::double b,
    count(*) filter (l_linestatus='O' and l_returnflag<>'R')::double c, count(*) filter (l_linestatus='O' and l_returnflag='R')::double d
    from c group by s)"""


def _ar(t):
    """Lines with the flag as returned (R) or not (A), by period."""
    return t.lineitem.withColumn("l_returnflag", F.when(F.col("l_returnflag") == "R", "R").otherwise("A")).withColumn(
        "s", F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp"))


@query("t201_yates_2x2_by_stratum", f"""with {_TWO}, e as (select *, a+b+c+d n from k)
  select s, round(n*pow(abs(a*d-b*c) - least(abs(a*d-b*c), n/2), 2)/((a+b)*(c+d)*(a+c)*(b+d)), 6) statistic,
    round((a+.5)*(d+.5)/((b+.5)*(c+.5)), 8) effect from e""")
def _(t):
    r = T.chi_square(_ar(t), "l_linestatus", "l_returnflag", by=["s"])
    return r.select("s", F.round("statistic", 6).alias("statistic"), F.round("effect.value", 8).alias("effect"))


@query("t202_fisher_exact", f"""with {_TWO} select s, round(a*d/(b*c), 8) statistic,
  round(exp(ln(a*d/(b*c)) - 1.96*sqrt(1/a+1/b+1/c+1/d)), 6) ci_low,
  round(exp(ln(a*d/(b*c)) + 1.96*sqrt(1/a+1/b+1/c+1/d)), 6) ci_high from k""")
def _(t):
    r = T.fisher_exact(_ar(t), "l_linestatus", "l_returnflag", by=["s"])
    return r.select("s", F.round("statistic", 8).alias("statistic"), F.round("effect.ci_low", 6).alias("ci_low"),
                    F.round("effect.ci_high", 6).alias("ci_high"))


@query("t203_g_test", f"with {_GRID} select round(g, 6) statistic, round(v, 8) effect from s")
def _(t):
    r = T.g_test(t.orders, "o_orderstatus", "o_orderpriority")
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("effect.value", 8).alias("effect"))


@query("t1006_marginal_conditional", f"with {_GRID} select round(chi2, 6) statistic, round(gap, 8) effect from s")
def _(t):
    r = T.marginal_vs_conditional(t.orders, "o_orderstatus", "o_orderpriority")
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("effect.value", 8).alias("effect"))


_MC = """s as (select count(*) n, count(*) filter (quality=0 and toxic=1) b, count(*) filter (quality=1 and toxic=0) c
  from labels where quality is not null and toxic is not null)"""


@query("t211_mcnemar", f"""with {_MC} select round(case when b+c<25 then least(b,c)::double
  else pow(abs(b-c)-1.0,2)/(b+c) end, 6) statistic, round((b-c)/n::double, 8) effect from s""")
def _(t):
    r = T.mcnemar(t.labels, "quality", "toxic")
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("effect.value", 8).alias("effect"))


@query("t221_two_proportions", """with s as (select count(*) filter (o_orderstatus='F')::double n1, count(*) filter (o_orderstatus='O')::double n2,
    count(*) filter (o_orderstatus='F' and o_orderpriority < '3')::double x1, count(*) filter (o_orderstatus='O' and o_orderpriority < '3')::double x2 from orders),
  p as (select *, x1/n1 p1, x2/n2 p2, 1.959963985 z from s),
  w as (select *, (p1+z*z/(2*n1)-z*sqrt(p1*(1-p1)/n1+z*z/(4*n1*n1)))/(1+z*z/n1) l1, (p1+z*z/(2*n1)+z*sqrt(p1*(1-p1)/n1+z*z/(4*n1*n1)))/(1+z*z/n1) u1,
    (p2+z*z/(2*n2)-z*sqrt(p2*(1-p2)/n2+z*z/(4*n2*n2)))/(1+z*z/n2) l2, (p2+z*z/(2*n2)+z*sqrt(p2*(1-p2)/n2+z*z/(4*n2*n2)))/(1+z*z/n2) u2 from p)
  select round((p1-p2)/sqrt(p1*(1-p1)/n1+p2*(1-p2)/n2), 6) statistic, round(p1-p2, 8) effect,
    round(p1-p2-sqrt(pow(p1-l1,2)+pow(u2-p2,2)), 8) ci_low, round(p1-p2+sqrt(pow(u1-p1,2)+pow(p2-l2,2)), 8) ci_high from w""")
def _(t):
    o = t.orders.withColumn("urgent", (F.col("o_orderpriority") < "3").cast("int"))
    r = T.two_proportions(o, "urgent", "o_orderstatus", levels=["F", "O"])
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("effect.value", 8).alias("effect"),
                    F.round("effect.ci_low", 8).alias("ci_low"), F.round("effect.ci_high", 8).alias("ci_high"))


@query("t502_cochran_armitage", """with g as (select o_orderpriority[1]::int - 1 t, count(*)::double n,
    count(*) filter (o_orderstatus='F')::double x from orders group by 1),
  s as (select sum(n) n, sum(x) x, sum(t*x) tx, sum(t*n) tn, sum(t*t*n) ttn from g)
  select round((tx - tn*x/n)/sqrt(x/n*(1-x/n)*(ttn-tn*tn/n)), 6) statistic, round((tx - tn*x/n)/(ttn-tn*tn/n), 8) effect from s""")
def _(t):
    o = t.orders.withColumn("final", (F.col("o_orderstatus") == "F").cast("int"))
    r = T.cochran_armitage(o, "final", "o_orderpriority")
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("effect.value", 8).alias("effect"))


_KAPPA = """p as (select l_linenumber % 3 a, (l_linenumber + (l_orderkey % 4 = 0)::int) % 3 b from lineitem),
  n as (select count(*)::double n, avg((a=b)::int) po, avg(abs(a-b)/2.0) wo from p),
  c as (select v, count(*) filter (w=1)/max(n) r, count(*) filter (w=2)/max(n) c from
    (select a v, 1 w from p union all select b, 2 from p), n group by v),
  e as (select sum(r*c) pe, sum(pow((r+c)/2, 2)) pf from c),
  w as (select sum(abs(x.v-y.v)/2.0*x.r*y.c) we from c x cross join c y)"""


def _raters(t):
    a = F.col("l_linenumber") % 3
    b = (F.col("l_linenumber") + (F.col("l_orderkey") % 4 == 0).cast("int")) % 3
    return t.lineitem.select(a.alias("a"), b.alias("b"))


@query("t604_cohen_kappa", f"""with {_KAPPA} select round((po-pe)/(1-pe)/sqrt(po*(1-po)/(n*pow(1-pe,2))), 5) statistic,
  round((po-pe)/(1-pe), 8) effect, round(1-wo/we, 8) weighted_kappa from n, e, w""")
def _(t):
    r = T.cohen_kappa(_raters(t), "a", "b")
    return r.select(F.round("statistic", 5).alias("statistic"), F.round("effect.value", 8).alias("effect"),
                    F.round(F.col("numbers")["weighted_kappa"], 8).alias("weighted_kappa"))


@query("t605_fleiss_kappa", f"with {_KAPPA} select round((po-pf)/(1-pf), 8) effect from n, e")
def _(t):
    return T.fleiss_kappa(_raters(t), "a", "b").select(F.round("effect.value", 8).alias("effect"))
