"""Association, trend and agreement between two columns."""
from pyspark.sql import functions as F

from statweave.operators import association as A
from statweave.plans.common import flat
from workload.registry import query



def _ci(r):
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("effect.value", 6).alias("effect"),
                    F.round("effect.ci_low", 6).alias("ci_low"), F.round("effect.ci_high", 6).alias("ci_high"))


@query("t301_pearson", """with s as (select corr(l_quantity, l_extendedprice) r, count(*) n from lineitem)
  select round(r, 6) statistic, round(r, 6) effect, round(tanh(atanh(r) - 1.96/sqrt(n-3)), 6) ci_low,
    round(tanh(atanh(r) + 1.96/sqrt(n-3)), 6) ci_high from s""")
def _(t):
    return _ci(A.pearson(t.lineitem, "l_quantity", "l_extendedprice"))


_RK = """r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity)-1)/2.0 a,
    rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice)-1)/2.0 b from lineitem),
  s as (select corr(a, b) r, count(*) n from r)"""


@query("t302_spearman", f"""with {_RK} select round(r, 6) statistic, round(r, 6) effect,
  round(tanh(atanh(r) - 1.96/sqrt(n-3)), 6) ci_low, round(tanh(atanh(r) + 1.96/sqrt(n-3)), 6) ci_high from s""")
def _(t):
    return _ci(A.spearman(t.lineitem, "l_quantity", "l_extendedprice"))


_KEN = """a as (select row_number() over () i, p_size x, p_retailprice y from part),
  p as (select sum(sign(a.x-b.x)*sign(a.y-b.y)) s, sum(abs(sign(a.x-b.x))) nx, sum(abs(sign(a.y-b.y))) ny
        from a join a b on a.i < b.i)"""


@query("t303_kendall", f"with {_KEN} select round(s/sqrt(nx::double*ny), 8) statistic, s::double s from p")
def _(t):
    r = A.kendall(t.part, "p_retailprice", "p_size")
    return r.select(F.round("statistic", 8).alias("statistic"), F.col("numbers")["s"].alias("s"))


@query("t304_distance_correlation", """with a as (select row_number() over () i, p_size::double x, p_retailprice y from part),
  d as (select a.i, b.i j, abs(a.x-b.x) dx, abs(a.y-b.y) dy from a cross join a b),
  m as (select i, avg(dx) mx, avg(dy) my from d group by i), g as (select avg(mx) gx, avg(my) gy from m),
  u as (select dx - p.mx - q.mx + gx a, dy - p.my - q.my + gy b from d join m p on p.i = d.i join m q on q.i = d.j, g)
  select round(sqrt(avg(a*b)/sqrt(avg(a*a)*avg(b*b))), 6) statistic from u""")
def _(t):
    return A.distance_correlation(t.part, "p_retailprice", "p_size").select(F.round("statistic", 6).alias("statistic"))


@query("t305_bicor", """with m as (select median(l_quantity) mq, median(l_extendedprice) mp from lineitem),
  d as (select median(abs(l_quantity-mq)) dq, median(abs(l_extendedprice-mp)) dp from lineitem, m),
  w as (select (l_quantity-mq)*case when abs((l_quantity-mq)/(9*dq))<1 then pow(1-pow((l_quantity-mq)/(9*dq),2),2) else 0 end a,
    (l_extendedprice-mp)*case when abs((l_extendedprice-mp)/(9*dp))<1 then pow(1-pow((l_extendedprice-mp)/(9*dp),2),2) else 0 end b
    from lineitem, m, d),
  s as (select sum(a*b)/(sqrt(sum(a*a))*sqrt(sum(b*b))) r, count(*) n from w)
  select round(r*sqrt((n-2)/(1-r*r)), 4) statistic, round(r, 8) effect from s""")
def _(t):
    r = A.bicor(t.lineitem, "l_quantity", "l_extendedprice")
    return r.select(F.round("statistic", 4).alias("statistic"), F.round("effect.value", 8).alias("effect"))


@query("t311_partial_correlation", """with s as (select corr(l_quantity, l_extendedprice) ab, corr(l_quantity, l_tax) az,
    corr(l_extendedprice, l_tax) bz from lineitem)
  select round((ab-az*bz)/sqrt((1-az*az)*(1-bz*bz)), 8) statistic, round(ab, 8) raw_r from s""")
def _(t):
    r = A.partial_correlation(t.lineitem, "l_extendedprice", "l_quantity", "l_tax")
    return flat(r, ["raw_r"], digits=8).drop("effect")


@query("t321_proportionality", """with s as (select var_samp(ln(l_extendedprice)) vx, var_samp(ln(l_quantity)) vz,
    var_samp(ln(l_extendedprice)-ln(l_quantity)) vr from lineitem where l_extendedprice > 0 and l_quantity > 0)
  select round(vr/vx, 8) statistic, round(1-vr/(vx+vz), 8) effect from s""")
def _(t):
    return flat(A.proportionality(t.lineitem, "l_extendedprice", "l_quantity"), digits=8)


@query("t503_mann_kendall", """with a as (select epoch(date_trunc('day', ts)) x, avg(value) y from events group by 1),
  p as (select sign(b.y-a.y) s, case when b.y <> a.y then 1 else 0 end ny, (b.y-a.y)/(b.x-a.x) sl from a join a b on a.x < b.x)
  select round(sum(s), 0) statistic, round(sum(s)/sqrt(count(*)::double*sum(ny)), 8) tau, round(median(sl)*1e6, 8) effect from p""")
def _(t):
    day = F.date_trunc("day", "ts").cast("long").alias("x")
    daily = t.events.groupBy(day).agg(F.avg("value").alias("y"))
    r = A.mann_kendall(daily, "y", "x")
    return r.select(F.round("statistic", 0).alias("statistic"), F.round(F.col("numbers")["tau"], 8).alias("tau"),
                    F.round(F.col("effect.value") * 1e6, 8).alias("effect"))


@query("t503_sen_slope_of_events", """with e as (select epoch(ts)/86400.0 x, value y from events where value is not null and ts is not null),
  tx as (select sum(n*(n-1)/2.0) a, sum(n*(n-1.0)*(n-2)) b, sum(n*(n-1.0)*(2*n+5)) c from (select count(*) n from e group by x)),
  ty as (select sum(n*(n-1)/2.0) a, sum(n*(n-1.0)*(n-2)) b, sum(n*(n-1.0)*(2*n+5)) c from (select count(*) n from e group by y)),
  z as (select count(*)::double n, n*(n-1) m from e),
  v as (select 1.959963984540054*sqrt((m*(2*n+5)-tx.c-ty.c)/18 + 2*tx.a*ty.a/m + tx.b*ty.b/(9*m*(n-2))) half, m/2-tx.a np from z, tx, ty),
  k as (select greatest(round_even((np-half)/2, 0)-1, 0) lo, least(round_even((np+half)/2, 0), np-1) hi, floor((np-1)/2) a, floor(np/2) b from v),
  p as (select (b.y-a.y)/(b.x-a.x) sl from e a join e b on a.x < b.x),
  s as (select sl, row_number() over (order by sl) - 1 r from p)
  select round(avg(case when r = a or r = b then sl end), 6) effect, round(max(case when r = lo then sl end), 6) ci_low, round(max(case when r = hi then sl end), 6) ci_high
  from s, k where r in (a, b, lo, hi)""")
def _(t):
    r = A.mann_kendall(t.events.select("value", (F.col("ts").cast("timestamp").cast("double") / 86400.0).alias("day")), "value", "day")
    return r.select(*[F.round(F.col("effect")[k], 6).alias(n) for k, n in (("value", "effect"), ("ci_low", "ci_low"), ("ci_high", "ci_high"))])


@query("t504_trend_ols", """with s as (select regr_slope(value, epoch(ts)/86400.0) b, regr_r2(value, epoch(ts)/86400.0) r2,
    regr_sxx(value, epoch(ts)/86400.0) sxx, regr_syy(value, epoch(ts)/86400.0) syy, count(*) n from events where value is not null)
  select round(b/sqrt(syy*(1-r2)/((n-2)*sxx)), 5) statistic, round(b, 6) effect, round(r2, 7) r2 from s""")
def _(t):
    ev = t.events.select("value", (F.col("ts").cast("timestamp").cast("double") / 86400.0).alias("day"))
    r = A.trend_ols(ev, "value", "day")
    return r.select(F.round("statistic", 5).alias("statistic"), F.round("effect.value", 6).alias("effect"),
                    F.round(F.col("numbers")["r2"], 7).alias("r2"))


def _remeasured(t):
    """Extended price beside quantity x 900 x (1 + discount): two ways to measure one thing."""
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"),
                             (F.col("l_quantity") * 900 * (1 + F.col("l_discount"))).alias("x"))


_PAIR = "p as (select l_extendedprice y, l_quantity*900*(1+l_discount) x from lineitem)"


@query("t601_icc", f"""with {_PAIR}, s as (select count(*) n, avg(y) my, avg(x) mx, var_pop(y) vy, var_pop(x) vx, covar_pop(y, x) c from p),
  m as (select *, n*(vy+vx+2*c)/2/(n-1) r, n*pow(my-mx,2)/2 k, n*(vy+vx-2*c)/2/(n-1) e from s)
  select round(r/e, 6) statistic, round((r-e)/(r+e+2*(k-e)/n), 8) effect from m""")
def _(t):
    r = A.icc(_remeasured(t), "y", "x", key=["l_orderkey", "l_linenumber"])
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("effect.value", 8).alias("effect"))


@query("t601_icc_bootstrap_interval")
def _(t):
    return A.icc(_remeasured(t), "y", "x", key=["l_orderkey", "l_linenumber"], reps=200).select("effect", "n")


@query("t602_bland_altman", f"""with {_PAIR}, s as (select avg(y-x) b, stddev_samp(y-x) sd, count(*) n, corr((y+x)/2, y-x) pr from p)
  select round(b/(sd/sqrt(n)), 5) statistic, round(b, 4) effect, round(b-1.96*sd, 4) loa_low, round(b+1.96*sd, 4) loa_high,
    round(pr, 6) proportional_r from s""")
def _(t):
    r = A.bland_altman(_remeasured(t), "y", "x")
    n = F.col("numbers")
    return r.select(F.round("statistic", 5).alias("statistic"), F.round("effect.value", 4).alias("effect"),
                    F.round(n["loa_low"], 4).alias("loa_low"), F.round(n["loa_high"], 4).alias("loa_high"),
                    F.round(n["proportional_r"], 6).alias("proportional_r"))


@query("t603_lins_ccc", f"""with {_PAIR}, s as (select 2*covar_pop(y,x)/(var_pop(y)+var_pop(x)+pow(avg(y)-avg(x),2)) k, corr(y,x) r from p)
  select round(k, 8) effect, round(k/r, 8) bias_factor from s""")
def _(t):
    r = A.lins_ccc(_remeasured(t), "y", "x")
    return r.select(F.round("effect.value", 8).alias("effect"), F.round(F.col("numbers")["bias_factor"], 8).alias("bias_factor"))


@query("conditional_rates", """with n as (select count(*)::double n from orders), y as (select o_orderstatus y, count(*) k from orders group by 1), z as (select o_orderpriority z, count(*) k from orders group by 1),
  o as (select o_orderstatus y, o_orderpriority z, count(*) o from orders group by 1, 2)
  select y.y, z.z, round(y.k/n, 8) marginal, round(coalesce(o, 0)/z.k::double, 8) conditional from y cross join z cross join n left join o on o.y = y.y and o.z = z.z""")
def _(t):
    from statweave.operators import table_tests as T
    return rd_rates(T.conditional_rates(t.orders, "o_orderstatus", "o_orderpriority"))


def rd_rates(r):
    return r.select("y", "z", F.round("marginal", 8).alias("marginal"), F.round("conditional", 8).alias("conditional"))
