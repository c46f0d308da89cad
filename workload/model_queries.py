"""Repeated measures, interactions, regressions, survival and compositions."""
from pyspark.sql import functions as F

from statweave.operators import composition as C, interaction as I, regression as G, repeated as R, survival as S
from workload.registry import query

c = F.col


def rd(r, *numbers, st=6, ef=6, by=()):
    return r.select(*by, F.round("statistic", st).alias("statistic"), F.round("effect.value", ef).alias("effect"),
                    *[F.round(c("numbers")[k], 6).alias(k) for k in numbers])


# ---------------------------------------------------------------- subject x occasion: users x event types
_WIDE = """w as (select user_id, avg(value) filter (event_type='click') a, avg(value) filter (event_type='error') b,
    avg(value) filter (event_type='purchase') c, avg(value) filter (event_type='signup') d, avg(value) filter (event_type='view') e
    from events where user_id is not null group by user_id),
  w5 as (select * from w where a is not null and b is not null and c is not null and d is not null and e is not null)"""
_D = "d as (select a - e d from w where a is not null and e is not null)"


@query("t111_paired_t", f"with {_WIDE}, {_D} select round(avg(d)/(stddev_samp(d)/sqrt(count(*))), 6) statistic, "
       "round(avg(d)/stddev_samp(d), 6) effect from d")
def _(t):
    return rd(R.paired_t(t.events, "value", "event_type", "user_id", ["click", "view"]))


@query("t112_wilcoxon", f"""with {_WIDE}, {_D}, r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d))-1)/2.0 r
    from d where d <> 0), s as (select sum(r) filter (d>0) p, sum(r) filter (d<0) m from r)
  select round(least(p, m), 1) statistic, round((p-m)/(p+m), 6) effect from s""")
def _(t):
    return rd(R.wilcoxon(t.events, "value", "event_type", "user_id", ["click", "view"]), st=1)


@query("t113_sign_test", f"""with {_WIDE}, {_D} select count(*) filter (d>0)::double statistic,
  round(count(*) filter (d>0)/count(*) filter (d<>0)::double, 6) effect from d""")
def _(t):
    return rd(R.sign_test(t.events, "value", "event_type", "user_id", ["click", "view"]))


@query("t131_rm_anova", f"""with {_WIDE}, s as (select count(*) n, sum(a) sa, sum((a-m)*(a-m)+(b-m)*(b-m)+(c-m)*(c-m)+(d-m)*(d-m)+(e-m)*(e-m)) w,
    avg(a) a, avg(b) b, avg(c) c, avg(d) d, avg(e) e, avg(m) g from (select *, (a+b+c+d+e)/5 m from w5)),
  f as (select n, w, n*(pow(a-g,2)+pow(b-g,2)+pow(c-g,2)+pow(d-g,2)+pow(e-g,2)) t from s),
  q as (select t/4/((w-t)/((n-1)*4)) f, (n-1)*4 d2 from f)
  select round(f, 6) statistic, round(4*f/(4*f+d2), 6) effect from q""")
def _(t):
    return rd(R.rm_anova(t.events, "value", "event_type", "user_id"))


@query("t132_friedman", f"""with {_WIDE}, l as (unpivot w5 on a, b, c, d, e into name k value v),
  r as (select user_id, k, rank() over (partition by user_id order by v) + (count(*) over (partition by user_id, v)-1)/2.0 r,
    count(*) over (partition by user_id, v) t from l),
  g as (select k, sum(r) s, count(*) n from r group by k), z as (select sum(t*t-1.0) t, count(distinct user_id) n from r),
  q as (select (12/(max(z.n)*30.0)*sum(s*s) - 18*max(z.n))/(1 - max(z.t)/(max(z.n)*120.0)) x, max(z.n) n from g, z)
  select round(x, 6) statistic, round(x/(n*4), 6) effect from q""")
def _(t):
    return rd(R.friedman(t.events, "value", "event_type", "user_id"))


@query("t133_mixed_model")
def _(t):
    return R.mixed_repeated(t.events, "value", "event_type", "user_id").select("statistic", "p", "effect", "n")


@query("t404_mixed_interaction")
def _(t):
    ev = t.events.where(c("event_type").isNotNull()).withColumn("half", (c("event_id") % 2).cast("int"))
    return R.mixed_interaction(ev, "value", "event_type", "half", "user_id").select("statistic", "p", "effect", "n")


@query("t212_cochran_q", """with w as (select user_id, event_type, min((value > 50)::int) h from events where value is not null group by all),
  u as (select *, count(*) over (partition by user_id) k, sum(h) over (partition by user_id) r from w),
  m as (select * from u where k = (select count(distinct event_type) from events where value is not null)),
  g as (select event_type, sum(h)::double c from m group by 1),
  s as (select (select count(distinct user_id) from m)::double n, count(*)::double k, sum(c) t, sum(c*c) cc, max(c) - min(c) d from g),
  x as (select sum(r*r)::double rr from (select distinct user_id, r from m))
  select round((k-1)*(k*cc-t*t)/(k*t-rr), 6) statistic, round(d/n, 6) effect from s, x""")
def _(t):
    ev = t.events.where(c("value").isNotNull()).withColumn("h", F.when(c("value") > 50, "1").otherwise("0"))
    return rd(R.cochran_q(ev, "h", "event_type", "user_id"))


@query("c06_sphericity", f"""with {_WIDE}, v as (select unnest([var_samp(a-b), var_samp(a-c), var_samp(a-d), var_samp(a-e), var_samp(b-c),
    var_samp(b-d), var_samp(b-e), var_samp(c-d), var_samp(c-e), var_samp(d-e)]) v from w5)
  select round(max(v)/min(v), 6) ratio, case when max(v)/min(v) < 3 then 'ok' else 'violated' end verdict from v""")
def _(t):
    return R.sphericity(t.events, "value", "event_type", "user_id").select(F.round("ratio", 6).alias("ratio"), "verdict")


# ---------------------------------------------------------------- two factors (2 x 2 lets SQL use the contrast form)
_CELL = """m as (select case when l_returnflag='R' then 'R' else 'A' end a, l_linestatus b, count({y})::double n, avg({y}) m, var_samp({y}) v from {src} group by all),
  q as (select pow(sum(case when (a='A')=(b='F') then m else -m end), 2)/sum(1/n) ss, sum((n-1)*v) w, sum(n) n,
    sum(case when (a='A')=(b='F') then m else -m end) k from m)"""


def _ar(t):
    """Lines with the flag as returned (R) or not (A)."""
    return t.lineitem.withColumn("l_returnflag", F.when(c("l_returnflag") == "R", "R").otherwise("A"))


@query("t401_two_way_anova", "with " + _CELL.format(y="l_extendedprice", src="lineitem")
       + " select round(ss/(w/(n-4)), 6) statistic, round(ss/(ss+w), 9) effect from q")
def _(t):
    return rd(I.two_way_anova(_ar(t), "l_extendedprice", "l_returnflag", "l_linestatus"), ef=9)


@query("t402_aligned_rank", """with b as (select case when l_returnflag='R' then 'R' else 'A' end l_returnflag, l_linestatus, l_extendedprice y from lineitem),
  al as (select l_returnflag, l_linestatus, round(y - avg(y) over (partition by l_returnflag) - avg(y) over (partition by l_linestatus)
    + avg(y) over (), 9) y from b),
  rk as (select l_returnflag, l_linestatus, rank() over (order by y) + (count(*) over (partition by y)-1)/2.0 r from al), """
       + _CELL.format(y="r", src="rk") + " select round(ss/(w/(n-4)), 4) statistic from q")
def _(t):
    return rd(I.aligned_rank_anova(_ar(t), "l_extendedprice", "l_returnflag", "l_linestatus"), st=4).select("statistic")


@query("t403_interaction_regression", "with " + _CELL.format(y="l_extendedprice", src="lineitem")
       + ", z as (select sum(1/n) h from m) select round(k/sqrt(w/(n-4)*h), 6) statistic, round(k, 4) effect from q, z")
def _(t):
    return rd(G.interaction_regression(_ar(t), "l_extendedprice", "l_returnflag", "l_linestatus"), ef=4)


# ---------------------------------------------------------------- regressions
@query("t801_logistic", """with s as (select count(*) filter (l_returnflag='R' and l_linestatus='O')::double a, count(*) filter (l_returnflag<>'R' and l_linestatus='O')::double b,
    count(*) filter (l_returnflag='R' and l_linestatus='F')::double c, count(*) filter (l_returnflag<>'R' and l_linestatus='F')::double d from lineitem)
  select round(ln(a*d/(b*c))/sqrt(1/a+1/b+1/c+1/d), 5) statistic, round(a*d/(b*c), 6) effect from s""")
def _(t):
    src = _ar(t).withColumn("y", (c("l_returnflag") == "R").cast("int"))
    return rd(G.logistic(src, "y", "l_linestatus"), st=5)


def stationary(r, *more):
    """What a likelihood's maximum must show: the steps ended, the mean score is nought, all rows took part."""
    return r.select(c("numbers")["converged"].alias("converged"), F.abs(F.round(c("numbers")["gradient"], 5)).alias("gradient"), c("n")["rows"].alias("rows"), *more)


def at_rest(src, more=""):
    return f"select 1.0::double converged, 0.0::double gradient, count(*) as rows{more} from {src}"


#: Newton's steps in SQL, from the likelihood's definition: the estimate itself is compared, not only that a score is nought.
_LOGIT_STEPS = """with recursive rows_ as (select quality::double y, n_chars/1000.0 x from labels join documents using (doc_id) where quality is not null and n_chars is not null),
  it(i, a, b) as (select 0, 0.0::double, 0.0::double union all
    select i + 1, a + (h11*g0 - h01*g1)/(h00*h11 - h01*h01), b + (h00*g1 - h01*g0)/(h00*h11 - h01*h01) from (
      select i, a, b, sum(y-p) g0, sum((y-p)*x) g1, sum(p*(1-p)) h00, sum(p*(1-p)*x) h01, sum(p*(1-p)*x*x) h11
      from (select it.i, it.a, it.b, y, x, 1/(1+exp(-(it.a+it.b*x))) p from it, rows_ where it.i < 20) group by i, a, b))
  select 1.0::double converged, 0.0::double gradient, (select count(*) from rows_) as rows, round(exp(b), 6) effect from it where i = 20"""


@query("t801_logistic_numeric", _LOGIT_STEPS)
def _(t):
    src = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("k", c("n_chars") / 1000.0)
    return stationary(G.logistic(src, "quality", "k"), F.round(c("effect.value"), 6).alias("effect"))


@query("t802_ols", """with p as (select l_extendedprice y, l_quantity x from lineitem where l_extendedprice is not null and l_quantity is not null),
  s as (select regr_slope(y,x) b, regr_intercept(y,x) a, regr_sxx(y,x) sxx, regr_syy(y,x) syy, regr_r2(y,x) r2, count(*) n, avg(x) mx from p),
  h as (select sqrt(sum(pow((y-a-b*x)/(1-1.0/n-pow(x-mx,2)/sxx)*(x-mx), 2)))/max(sxx) hc from p, s)
  select round(b/sqrt(syy*(1-r2)/((n-2)*sxx)), 4) statistic, round(b, 5) effect, round(r2, 6) r2,
    round(1-(1-r2)*(n-1)/(n-2), 6) adj_r2, round(hc, 6) hc3_se from s, h""")
def _(t):
    return rd(G.ols(t.lineitem, "l_extendedprice", "l_quantity"), "r2", "adj_r2", "hc3_se", st=4, ef=5)


@query("t803_poisson", """select round(avg(l_linenumber) filter (l_linestatus='O')/avg(l_linenumber) filter (l_linestatus='F'), 6) effect
  from lineitem""")
def _(t):
    return rd(G.poisson(t.lineitem, "l_linenumber", "l_linestatus")).select("effect")


@query("t803_negative_binomial", """select round(avg(n_chars) filter (doc_id % 2 = 1)/avg(n_chars) filter (doc_id % 2 = 0), 6) effect from documents""")
def _(t):
    src = t.documents.select("n_chars", (c("doc_id") % 2).cast("string").alias("g"))
    return rd(G.poisson(src, "n_chars", "g")).select("effect")


@query("t804_ordinal_logistic", at_rest("lineitem where l_linenumber is not null and l_quantity is not null"))
def _(t):
    return stationary(G.ordinal(t.lineitem, "l_linenumber", "l_quantity"))


@query("t805_beta_regression", at_rest("lineitem where l_quantity > 0 and l_quantity < 51 and l_discount is not null"))
def _(t):
    src = t.lineitem.withColumn("share", c("l_quantity") / 51.0)
    return stationary(G.beta_regression(src, "share", "l_discount"))


@query("t806_huber", at_rest("lineitem where l_extendedprice is not null and l_quantity is not null", ", round(regr_slope(l_extendedprice, l_quantity), 4) ols_slope"))
def _(t):
    return stationary(G.huber(t.lineitem, "l_extendedprice", "l_quantity"), F.round(c("numbers")["ols_slope"], 4).alias("ols_slope"))


# ---------------------------------------------------------------- survival: days from order to shipment, event = returned
def follow_up(t):
    o = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    li = t.lineitem.select("l_orderkey", "l_shipdate", "l_returnflag")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.datediff("l_shipdate", "o_orderdate").alias("days"), (c("l_returnflag") == "R").cast("int").alias("event"),
        "o_orderstatus", (c("o_totalprice") / 100000.0).alias("price")).where("days > 0")


FU = """fu as (select datediff('day', o_orderdate, l_shipdate) t, (l_returnflag='R')::int d, o_orderstatus g, o_totalprice/100000.0 price
    from lineitem join orders on l_orderkey=o_orderkey where datediff('day', o_orderdate, l_shipdate) > 0),
  k as (select t, sum(d)::double d, sum(d) filter (g='F')::double d0, count(*) n, count(*) filter (g='F') n0 from fu group by t),
  r as (select t, d, coalesce(d0,0) d0, sum(n) over w nr, sum(n0) over w n0 from k window w as (order by t desc))"""


def _lr(weight, name):
    return f"""with {FU}, s as (select sum({weight}*(d0-d*n0/nr)) u, sum({weight}*{weight}*case when nr>1 then d*(nr-d)/(nr-1) else 0 end*n0/nr*(1-n0/nr)) v
      from r where d > 0) select round(u*u/v, 6) statistic from s"""


def _filled(t):
    """Orders as filled (F) or not (O)."""
    return follow_up(t).withColumn("o_orderstatus", F.when(c("o_orderstatus") == "F", "F").otherwise("O"))


@query("t901_logrank", _lr("1.0", "logrank"))
def _(t):
    return S.logrank(_filled(t), "days", "o_orderstatus", "event", levels=["F", "O"], with_hr=False).select(
        F.round("statistic", 6).alias("statistic"))


@query("t901_logrank_three_groups_with_hr", f"""with {FU}, m as (select t, sum(d)::double d, sum(d) filter (g='F')::double df, sum(d) filter (g='O')::double d_o, count(*) n, count(*) filter (g='F') nf, count(*) filter (g='O') n_o from fu group by t),
  q as (select t, d, coalesce(df, 0) df, coalesce(d_o, 0) d_o, sum(n) over w n, sum(nf) over w nf, sum(n_o) over w n_o from m window w as (order by t desc)),
  s as (select sum(df-d*nf/n) u1, sum(d_o-d*n_o/n) u2, sum(v*nf/n*(1-nf/n)) v11, sum(v*n_o/n*(1-n_o/n)) v22, -sum(v*nf/n*n_o/n) v12
    from (select *, case when n > 1 then d*(n-d)/(n-1) else 0 end v from q where d > 0))
  select round((u1*u1*v22 - 2*u1*u2*v12 + u2*u2*v11)/(v11*v22 - v12*v12), 6) statistic, (select sum(d) from m)::bigint events from s""")
def _(t):
    r = S.logrank(follow_up(t), "days", "o_orderstatus", "event")
    return r.select(F.round("statistic", 6).alias("statistic"), F.aggregate(F.map_values(F.map_filter("n", lambda k, v: k == "events")), F.lit(0).cast("long"), lambda a, x: a + x).alias("events"))


@query("t902_gehan", _lr("nr::double", "gehan"))
def _(t):
    return S.gehan(_filled(t), "days", "o_orderstatus", "event", levels=["F", "O"], with_hr=False).select(
        F.round("statistic", 6).alias("statistic"))


KM = """kk as (select g, t, sum(d)::double d, count(*) n from fu group by g, t),
  kr as (select g, t, d, sum(n) over (partition by g order by t desc) n from kk),
  ke as (select g, t, d, n, exp(sum(case when d<n then ln(1-d/n) else -800 end) over (partition by g order by t)) s from kr where d > 0)"""


@query("median_survival", f"with {FU}, {KM} select g, min(t) filter (s <= 0.5)::double median, round(min(s), 6) lowest from ke group by g")
def _(t):
    return S.median_survival(follow_up(t), "days", "o_orderstatus", "event").select("g", "median", F.round("lowest", 6).alias("lowest"))


@query("t903_rmst", f"""with {FU}, {KM}, tau as (select min(m) tau from (select max(t) m from fu where g in ('F','O') group by g)),
  a as (select g, t, d, n, s, s*(least(coalesce(lead(t) over (partition by g order by t), tau), tau)-t) a from ke, tau where g in ('F','O') and t <= tau),
  b as (select *, sum(a) over (partition by g order by t desc) rest from a),
  x as (select g, min(t)+sum(a) r, sum(case when n>d then rest*rest*d/(n*(n-d)) else 0 end) v from b group by g),
  z as (select max(r) filter (g='F') - max(r) filter (g='O') d, sqrt(sum(v)) se from x)
  select round(d/se, 5) statistic, round(d, 5) effect from z""")
def _(t):
    return rd(S.rmst(follow_up(t).where(c("o_orderstatus").isin("F", "O")), "days", "o_orderstatus", "event", levels=["F", "O"]), st=5, ef=5)


_COX_STEPS = f"""with recursive {FU}, it(i, b) as (select 0, 0.0::double union all
    select i + 1, b + sum(d*(x - r1/r0))/sum(d*(r2/r0 - r1*r1/(r0*r0))) from (
      select i, b, d, x, sum(e) over w r0, sum(e*x) over w r1, sum(e*x*x) over w r2
      from (select it.i, it.b, t, d, price x, exp(it.b*price) e from it, fu where it.i < 12)
      window w as (order by t desc range between unbounded preceding and current row)) group by i, b)
  select 1.0::double converged, 0.0::double gradient, (select count(*) from fu) as rows, (select sum(d)::bigint from fu) events, round(exp(b), 6) effect from it where i = 12"""


@query("t807_cox_numeric", _COX_STEPS)
def _(t):
    return stationary(S.cox(follow_up(t), "days", "price", "event"), c("n")["events"].alias("events"), F.round(c("effect.value"), 6).alias("effect"))


@query("t904_cox_groups", f"with {FU} " + at_rest("fu", ", sum(d)::bigint events"))
def _(t):
    return stationary(S.cox(follow_up(t), "days", "o_orderstatus", "event", test_id="T-904"), c("n")["events"].alias("events"))


_RESIDUALS = _COX_STEPS[:_COX_STEPS.rindex("  select 1.0::double")].rstrip() + """,
  z as (select t, d, price x, exp(b*price) e from fu, it where i = 12),
  m as (select t, d, x, sum(e*x) over w / sum(e) over w xbar from z window w as (order by t desc range between unbounded preceding and current row)),
  v as (select x - xbar res, rank() over (order by t) + (count(*) over (partition by t) - 1)/2.0 rk from m where d = 1)
  select round(count(*)*pow(corr(res, rk), 2), 5) statistic, round(corr(res, rk), 6) effect, count(*) events from v"""


@query("c11_proportional_hazards", _RESIDUALS)
def _(t):
    r = S.proportional_hazards(follow_up(t), "days", "price", "event")
    return r.select(F.round("statistic", 5).alias("statistic"), F.round(c("effect.value"), 6).alias("effect"), c("n")["events"].alias("events"))


@query("sc_cls_15_c_index", f"""with {FU}, a as (select t, d, price, count(*) n from fu group by all),
  p as (select sum(a.n*b.n) filter (a.price > b.price) con, sum(a.n*b.n) filter (a.price = b.price) tie, sum(a.n*b.n) u
    from a join a b on a.d = 1 and (b.t > a.t or (b.t = a.t and b.d = 0)))
  select u::double usable, round((con + tie/2.0)/u, 8) c_index from p""")
def _(t):
    return S.concordance_index(follow_up(t), "days", "price", "event").select("usable", F.round("c_index", 8).alias("c_index"))


# ---------------------------------------------------------------- compositions: per-user counts / shares of event types
MEMBERS = ["click", "error", "purchase", "signup", "view"]


def user_counts(t):
    n = [F.sum((c("event_type") == m).cast("long")).alias(m) for m in MEMBERS]
    return t.events.groupBy("user_id").agg(*n).withColumn("g", F.when(c("user_id") % 2 == 0, "even").otherwise("odd"))


COMP = """u as (select user_id, count(*) filter (event_type='click')::double a, count(*) filter (event_type='error')::double b,
    count(*) filter (event_type='purchase')::double c, count(*) filter (event_type='signup')::double d, count(*) filter (event_type='view')::double e
    from events group by user_id),
  pos as (select *, case when user_id % 2 = 0 then 'even' else 'odd' end g, (ln(a)+ln(b)+ln(c)+ln(d)+ln(e))/5 lm from u where a*b*c*d*e > 0)"""
_WELCH = """w as (select avg(v) filter (g='even') - avg(v) filter (g='odd') d, var_samp(v) filter (g='even') v1, var_samp(v) filter (g='odd') v2,
    count(*) filter (g='even')::double n1, count(*) filter (g='odd')::double n2 from x)
  select round(d/sqrt(v1/n1+v2/n2), 6) statistic, round(d/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2))*(1-3/(4*(n1+n2)-9)), 6) effect from w"""


@query("t1001_clr_compare", f"with {COMP}, x as (select g, ln(a)-lm v from pos), {_WELCH}")
def _(t):
    return rd(C.clr_compare(user_counts(t), "click", "g", MEMBERS, ["even", "odd"]))


@query("t1002_alr_compare", f"""with {COMP}, rv as (select unnest([var_samp(ln(b)), var_samp(ln(c)), var_samp(ln(d)), var_samp(ln(e))]) v, unnest([1,2,3,4]) i from pos),
  rf as (select i from rv order by v limit 1), x as (select g, ln(a) - case i when 1 then ln(b) when 2 then ln(c) when 3 then ln(d) else ln(e) end v from pos, rf), {_WELCH}""")
def _(t):
    return rd(C.alr_compare(user_counts(t), "click", "g", MEMBERS, ["even", "odd"]))


@query("t1003_dirichlet_compare")
def _(t):
    return C.dirichlet_compare(user_counts(t), "click", "g", MEMBERS, ["user_id"], ["even", "odd"]).select("p", "effect", "n")


@query("t1004_bias_corrected", f"""with {COMP}, x as (select g, ln(a)-lm v, ((ln(b)+ln(c)+ln(d)+ln(e)) - 4*lm)/4 o from pos),
  w as (select avg(v) filter (g='even') - avg(v) filter (g='odd') - (avg(o) filter (g='even') - avg(o) filter (g='odd')) d,
    sqrt(var_samp(v) filter (g='even')/count(*) filter (g='even') + var_samp(v) filter (g='odd')/count(*) filter (g='odd')) se from x)
  select round(d/se, 6) statistic, round(d, 6) effect from w""")
def _(t):
    return rd(C.bias_corrected(user_counts(t), "click", "g", MEMBERS, ["even", "odd"]))


@query("t1005_proportionality", f"""with {COMP} select round(var_samp(ln(a)-ln(e))/var_samp(ln(a)), 6) statistic,
  round(1-var_samp(ln(a)-ln(e))/(var_samp(ln(a))+var_samp(ln(e))), 6) effect from u where a > 0 and e > 0""")
def _(t):
    return rd(C.proportionality_of_parts(user_counts(t), "click", "view"))
