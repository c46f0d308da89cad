"""Scans, row edits, derived columns, missing values, profiling."""
from pyspark.sql import functions as F

from statweave.functions import derive as V
from statweave.operators import labels as L, missing as M, profile as P, rowops as O
from statweave.sources import tables as S
from workload.registry import query

c = F.col


# ---------------------------------------------------------------- sources
@query("open_meta", """with d as (select * from (describe select * from lineitem)), p as (select column_name, column_type, row_number() over () - 1 i from d)
  select 'parquet' format, i::int "position", column_name "column", case when column_type = 'BIGINT' then 'bigint' when column_type = 'INTEGER' then 'int' when column_type = 'DOUBLE' then 'double'
    when column_type = 'VARCHAR' then 'string' else 'time' end dtype, (select count(*) from lineitem) n_rows from p""")
def _(t):
    return S.open_meta(t.spark, f"{t.dir}/lineitem.parquet").withColumn("dtype", F.when(c("dtype").startswith("timestamp"), "time").otherwise(c("dtype")))


@query("profile_columns", """with p as (
  select 'o_orderkey' as column, count(*) - count(o_orderkey) m, count(distinct o_orderkey) u, count(*) n from orders union all
  select 'o_custkey', count(*) - count(o_custkey), count(distinct o_custkey), count(*) from orders union all
  select 'o_orderstatus', count(*) - count(o_orderstatus), count(distinct o_orderstatus), count(*) from orders union all
  select 'o_totalprice', count(*) - count(o_totalprice), count(distinct o_totalprice), count(*) from orders union all
  select 'o_orderdate', count(*) - count(o_orderdate), count(distinct o_orderdate), count(*) from orders union all
  select 'o_orderpriority', count(*) - count(o_orderpriority), count(distinct o_orderpriority), count(*) from orders)
  select "column", round(m/n, 6) missing_rate, u n_unique from p""")
def _(t):
    return P.profile_columns(t.orders).select("column", F.round("missing_rate", 6).alias("missing_rate"), "n_unique")


@query("sample_three_blocks", """with o as (select *, row_number() over (order by o_orderkey) - 1 i, count(*) over () n from orders)
  select o_orderkey, o_totalprice from o where (i >= 0 and i < 300) or (i >= n // 3 and i < n // 3 + 300) or (i >= n * 2 // 3 and i < n * 2 // 3 + 300)""")
def _(t):
    return S.sample_blocks(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], n=900)


@query("sample_rows_near_all", """with o as (select o_orderkey, row_number() over (order by o_orderpriority, o_orderkey) - 1 i, count(*) over () n from orders)
  select o_orderkey from o where i <> n - 1""")                                   # all rows but one in two runs, by a text key with few values
def _(t):
    return S.sample_blocks(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority", "o_orderkey"], n=t.orders.count() - 1, blocks=2).select("o_orderkey")


@query("sample_rows_of_file", """with o as (select o_orderkey, o_totalprice, row_number() over () - 1 i, count(*) over () n from orders)
  select o_orderkey, o_totalprice from o where (i >= 0 and i < 300) or (i >= n // 3 and i < n // 3 + 300) or (i >= n * 2 // 3 and i < n * 2 // 3 + 300)""")
def _(t):
    return S.sample_rows(t.spark, f"{t.dir}/orders.parquet", n=900, columns=["o_orderkey", "o_totalprice"])


@query("transpose", """with g as (select o_orderpriority k, count(*) n, sum(o_custkey) s from orders group by 1),
  l as (select k, 'n' as column, n::varchar v from g union all select k, 's', s::varchar from g)
  select "column", max(v) filter (k='1-URGENT') "1-URGENT", max(v) filter (k='2-HIGH') "2-HIGH", max(v) filter (k='3-MEDIUM') "3-MEDIUM",
    max(v) filter (k='4-NOT SPECIFIED') "4-NOT SPECIFIED", max(v) filter (k='5-LOW') "5-LOW" from l group by 1""")
def _(t):
    g = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))
    return S.transpose(g)


@query("transpose_cost", "select count(*) n_rows, 6 n_columns, count(*)*6*64 bytes, count(*)*6*64 > 4294967296 warn from orders")
def _(t):
    return S.transpose_cost(t.orders)


@query("table_fingerprint", """select count(*) n_rows, true reordered_equal, false changed_equal from orders""")
def _(t):
    own, other = S.fingerprint(t.orders), S.fingerprint(t.orders.repartition(7, "o_custkey").sort(c("o_totalprice").desc()))
    changed = S.fingerprint(t.orders.withColumn("o_orderstatus", F.when(c("o_orderkey") == t.orders.agg(F.min("o_orderkey")).scalar(), "?").otherwise(c("o_orderstatus"))))
    same = lambda d, name: (c("hash_sum") == d.select("hash_sum").scalar()).alias(name)
    return own.select("n_rows", same(other, "reordered_equal"), same(changed, "changed_equal"))


@query("compose_summary", """select count(*) n_rows, 6 n_selected, 5 n_analysis, 1 n_held, 2 n_numeric, 2 n_categorical, 1 n_datetime,
  count(*) filter (o_custkey is not null and o_totalprice is not null and o_orderstatus is not null and o_orderpriority is not null and o_orderdate is not null) complete_rows,
  count(*) filter (o_custkey is null or o_totalprice is null or o_orderstatus is null or o_orderpriority is null or o_orderdate is null) any_missing from orders""")
def _(t):
    return P.compose(t.orders, held=["o_orderkey"])


# ---------------------------------------------------------------- recorded operations
@query("apply_ops_replay", """with b as (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, case when l_orderkey % 11 = 0 then null else l_discount end l_discount, l_returnflag from lineitem
    where l_orderkey % 1000 <> 3),
  d as (select *, ln(l_extendedprice) lp from b where not (l_quantity > 49)),
  m as (select avg(l_discount) a from d),
  f as (select case l_returnflag when 'A' then 'kept' when 'N' then 'kept' else l_returnflag end flag, lp, coalesce(l_discount, a) disc from d, m)
  select flag, count(*) n, round(avg(lp), 8) lp, round(avg(disc), 8) disc from f group by flag""")
def _(t):
    src = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                            F.when(c("l_orderkey") % 11 != 0, c("l_discount")).alias("l_discount"), "l_returnflag")
    df = O.apply_ops(src, [
        {"op": "filter_rows", "expr": "l_orderkey % 1000 <> 3"},
        {"op": "filter_rows", "expr": "l_quantity > 49", "mode": "drop"},
        {"op": "derive", "name": "lp", "formula": "ln(l_extendedprice)"},
        {"op": "impute", "method": "mean", "columns": ["l_discount"]},
        {"op": "label_map", "column": "l_returnflag", "map": {"A": "kept", "N": "kept"}},
        {"op": "deselect", "columns": ["l_quantity"]}])
    return df.groupBy(c("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lp"), 8).alias("lp"),
                                                           F.round(F.avg("l_discount"), 8).alias("disc"))


@query("filter_preview", """select count(*) filter (l_quantity > 25 and l_discount < 0.05) kept,
  count(*) - count(*) filter (l_quantity > 25 and l_discount < 0.05) removed, count(*) total,
  round(1 - count(*) filter (l_quantity > 25 and l_discount < 0.05)/count(*), 8) ratio from lineitem""")
def _(t):
    return O.filter_preview(t.lineitem, "l_quantity > 25 and l_discount < 0.05").withColumn("ratio", F.round("ratio", 8))


def _edits(t):
    return t.orders.where("o_orderkey % 97 = 0").select(c("o_orderkey").alias("key"), F.lit("X").alias("value"), F.lit("audit").alias("note"))


@query("relabel_cells", """select case when o_orderkey % 97 = 0 then 'X' else o_orderstatus end s,
  case when o_orderkey % 97 = 0 then o_orderstatus end was, count(*) n from orders group by all""")
def _(t):
    r = L.relabel(t.orders, "o_orderkey", "o_orderstatus", _edits(t))
    return r.groupBy(c("o_orderstatus").alias("s"), c("_relabel_from").alias("was")).agg(F.count(F.lit(1)).alias("n"))


@query("relabel_ratio", """select count(*) filter (o_orderkey % 97 = 0) relabeled, count(*) total,
  round(count(*) filter (o_orderkey % 97 = 0)/count(*), 8) ratio, count(*) filter (o_orderkey % 97 = 0) > 0.01*count(*) over_limit from orders""")
def _(t):
    return L.relabel_ratio(L.relabel(t.orders, "o_orderkey", "o_orderstatus", _edits(t))).withColumn("ratio", F.round("ratio", 8))


@query("find_row", "select o_orderkey, o_orderstatus from orders where o_orderkey = (select max(o_orderkey) from orders)")
def _(t):
    top = t.orders.agg(F.max("o_orderkey")).first()[0]
    return L.find_row(t.orders, "o_orderkey", top, "o_orderstatus")


def _excluded(t):
    return t.customer.where("c_acctbal < -900").select(c("c_custkey").alias("key"), F.lit("debt").alias("note"))


@query("exclude_rows", "select count(*) n, round(sum(o_totalprice), 2) total from orders where o_custkey not in (select c_custkey from customer where c_acctbal < -900)")
def _(t):
    return O.exclude_rows(t.orders, "o_custkey", _excluded(t)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("exclusion_status", """with e as (select o_custkey in (select c_custkey from customer where c_acctbal < -900) x from orders)
  select count(*) filter (x) n_excluded, count(*) n_total, round(count(*) filter (x)/count(*), 8) ratio,
  case when count(*) filter (x)/count(*) > 0.1 then 'red' when count(*) filter (x) > 0 then 'yellow' else 'green' end verdict from e""")
def _(t):
    return O.exclusion_status(t.orders, "o_custkey", _excluded(t)).withColumn("ratio", F.round("ratio", 8))


@query("both_ways", """with x as (select 'all' rows_used, * from orders union all select 'after exclusion', * from orders where o_custkey not in (select c_custkey from customer where c_acctbal < -900)),
  s as (select rows_used, avg(o_totalprice) filter (o_orderstatus = 'F') m1, var_samp(o_totalprice) filter (o_orderstatus = 'F') v1, count(*) filter (o_orderstatus = 'F') n1,
    avg(o_totalprice) filter (o_orderstatus = 'O') m2, var_samp(o_totalprice) filter (o_orderstatus = 'O') v2, count(*) filter (o_orderstatus = 'O') n2 from x group by 1),
  z as (select rows_used, (m1-m2)/sqrt(v1/n1+v2/n2) t from s)
  select rows_used, round(t, 6) statistic, (select bool_or(abs(t) > 1.96) <> bool_and(abs(t) > 1.96) from z) flips from z""")
def _(t):
    from statweave.spec import Spec
    r = O.both_ways(t.orders, Spec(y="o_totalprice", group="o_orderstatus", levels=("F", "O")), "T-101", "o_custkey", _excluded(t))
    return r.select("rows_used", F.round("statistic", 6).alias("statistic"), "flips")


@query("outlying_points", """with f as (select l_returnflag g, quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b from
    (select l_returnflag, l_extendedprice * case when l_orderkey % 500 = 0 then 5 else 1 end l_extendedprice from lineitem) group by 1),
  p as (select l_orderkey*10+l_linenumber key, l_returnflag x, l_extendedprice * case when l_orderkey % 500 = 0 then 5 else 1 end y from lineitem),
  o as (select key, x, y, greatest(a-1.5*(b-a)-y, y-b-1.5*(b-a)) d from p join f on g = x where y < a-1.5*(b-a) or y > b+1.5*(b-a)),
  r as (select *, row_number() over (partition by x order by d desc, key) r from o)
  select key, x, round(y, 4) y, round(d, 4) distance from r where r <= 8""")
def _(t):
    src = t.lineitem.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("k"), "l_returnflag",
                            (c("l_extendedprice") * F.when(c("l_orderkey") % 500 == 0, 5).otherwise(1)).alias("y"))
    return O.outlying_points(src, "y", "k", "l_returnflag").select("key", "x", F.round("y", 4).alias("y"), F.round("distance", 4).alias("distance"))


@query("label_levels", """select o_orderpriority as value, count(*) n, round(count(*)/sum(count(*)) over (), 8) ratio,
  row_number() over (order by count(*) desc, o_orderpriority) - 1 code from orders group by 1""")
def _(t):
    return L.label_levels(t.orders, "o_orderpriority").withColumn("ratio", F.round("ratio", 8))


@query("merged_groups", """select case when o_orderpriority in ('1-URGENT','2-HIGH') then 'fast' when o_orderpriority = '5-LOW' then 'slow' else o_orderpriority end code,
  string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as values, count(*) n from orders group by 1""")
def _(t):
    return L.merged_groups(t.orders, "o_orderpriority", {"1-URGENT": "fast", "2-HIGH": "fast", "5-LOW": "slow"})


@query("palette_match", """with k as (select distinct regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]', '', 'g') w, p_brand category from part),
  l as (select p_name label, count(*) n, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') t from (select p_name || ' ' || p_brand || ' ' || p_type p_name from part) group by 1),
  h as (select label, category, length(w) ln, max(length(w)) over (partition by label) m from l join k on contains(t, w))
  select l.label, l.n, min(category) category, count(distinct category) > 1 ambiguous from l left join (select * from h where ln = m) h using (label) group by 1, 2""")
def _(t):
    words = t.part.select(c("p_brand").alias("keyword"), c("p_brand").alias("category")).distinct()
    return L.palette_match(t.part.select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("label")), "label", words)


@query("natural_order", """select o_custkey::varchar v from (select distinct o_custkey % 120 o_custkey from orders) order by o_custkey""")
def _(t):
    d = t.orders.select((c("o_custkey") % 120).cast("string").alias("v")).distinct()
    return d.orderBy(L.order_key(c("v")))


# ---------------------------------------------------------------- derived columns
@query("derive_row_functions", """with p as (select l_extendedprice x, l_quantity q, l_discount d, l_tax z from lineitem)
  select round(sum(ln(x)), 4) a, round(sum(log2(x)), 4) b, round(sum(log10(x)), 4) e, round(sum(exp(d)), 6) f, round(sum(sqrt(q)), 4) g,
    round(sum(asinh(x)), 4) h, round(sum(floor(x/10)*10), 2) floor_to, round(sum(ceil(x/10)*10), 2) ceil_to, round(sum(round_even(x/10, 0)*10), 2) round_to,
    round(sum(case when q >= 30 then 30 when q >= 20 then 20 when q >= 10 then 10 else 0 end), 0) bin,
    round(sum(ln(least(1-1e-12, greatest(1e-12, d))/(1-least(1-1e-12, greatest(1e-12, d))))), 3) logit, round(sum(d*(1-d)), 6) pq,
    round(sum(sign(x-30000)*floor(abs(x-30000)/1000)), 0) trunc, round(sum(q + d + z), 4) setsum, round(sum(pi()*q + exp(1.0)), 4) consts from p""")
def _(t):
    s = lambda col, nd=4: F.round(F.sum(col), nd)
    x, q, d = "l_extendedprice", "l_quantity", "l_discount"
    return t.lineitem.agg(
        s(F.ln(x)).alias("a"), s(F.log2(x)).alias("b"), s(F.log10(x)).alias("e"), s(F.exp(d), 6).alias("f"), s(F.sqrt(q)).alias("g"),
        s(V.arcsinh(x)).alias("h"), s(V.floor_to(x, 10), 2).alias("floor_to"), s(V.ceil_to(x, 10), 2).alias("ceil_to"), s(V.round_to(x, 10), 2).alias("round_to"),
        s(V.bin_left(q, [0, 10, 20, 30, 40]), 0).alias("bin"), s(V.logit(d), 3).alias("logit"), s(V.bernoulli_variance(d), 6).alias("pq"),
        s(V.trunc_at((c(x) - 30000) / 1000), 0).alias("trunc"), s(V.set_sum([q, d, "l_tax"])).alias("setsum"), s(F.pi() * c(q) + F.e()).alias("consts"))


@query("derive_column_statistics", """with p as (select p_partkey k, p_retailprice x, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice)-1)/2.0 r from part)
  select k, round(x/sum(x) over (), 10) share, round((x-avg(x) over ())/stddev_samp(x) over (), 8) z, r from p""")
def _(t):
    d = t.part.select(c("p_partkey").alias("k"), c("p_retailprice").alias("x"))
    d = V.with_rank(V.with_zscore(V.with_share(d, "x", "share"), "x", "z"), "x", "r")
    return d.select("k", F.round("share", 10).alias("share"), F.round("z", 8).alias("z"), "r")


@query("derive_log_ratios", """with u as (select user_id, count(*) filter (event_type='click')::double a, count(*) filter (event_type='error')::double b,
    count(*) filter (event_type='view')::double d from events group by 1)
  select user_id, round(ln(a+.5)-(ln(a+.5)+ln(b+.5)+ln(d+.5))/3, 8) clr, round(ln((a+.5)/(b+.5)), 8) alr,
    round((ln(a+.5)-(ln(a+.5)+ln(b+.5)+ln(d+.5))/3)*sqrt(1.5), 8) ilr, round(sqrt(0.5)*(ln(b+.5)-ln(d+.5)), 8) ilr2 from u""")
def _(t):
    from workload.model_queries import user_counts
    m = ["click", "error", "view"]
    return user_counts(t).select("user_id", F.round(V.clr(m, "click", .5), 8).alias("clr"), F.round(V.alr("click", "error", .5), 8).alias("alr"),
                                 F.round(V.ilr_first(m, .5), 8).alias("ilr"), F.round(V.ilr_basis(m, .5)[1], 8).alias("ilr2"))


@query("derive_delta", """select user_id, round(avg(value) filter (event_type='view') - avg(value) filter (event_type='click'), 8) delta from events
  where user_id is not null group by 1 having delta is not null""")
def _(t):
    return V.delta(t.events, "value", "event_type", "user_id", ["click", "view"]).withColumn("delta", F.round("delta", 8))


@query("derive_preview", """select count(*) n, 0::bigint n_inf, count(*) filter (l_discount = 0) n_nan, count(*) filter (l_discount <> 0) n_finite,
  round(min(l_tax/nullif(l_discount,0)), 8) min, round(max(l_tax/nullif(l_discount,0)), 8) max, round(avg(l_tax/nullif(l_discount,0)), 8) mean from lineitem""")
def _(t):
    r = V.preview(t.lineitem, V.divide(c("l_tax"), c("l_discount")))
    return r.select("n", "n_inf", "n_nan", "n_finite", *[F.round(k, 8).alias(k) for k in ("min", "max", "mean")])


@query("derive_preview_lossy", "select count(distinct p_retailprice) distinct_before, count(distinct floor(p_retailprice/100)*100) distinct_after from part")
def _(t):
    return V.preview(t.part, V.floor_to("p_retailprice", 100), "p_retailprice").select("distinct_before", "distinct_after")


@query("eps_advice", """with s as (select min(l_discount) filter (l_discount > 0) m, count(*) filter (l_discount = 0) z, count(*) filter (l_discount < 0) g from lineitem)
  select z > 0 needed, m min_positive, round(power(10, floor(log10(m))-2), 10) recommended, z n_zeros, g n_negative from s""")
def _(t):
    return V.eps_advice(t.lineitem, "l_discount").select("needed", "min_positive", F.round("recommended", 10).alias("recommended"), "n_zeros", "n_negative")


# ---------------------------------------------------------------- missing values
def holes(t):
    k = c("l_orderkey") * 7 + c("l_linenumber")
    return t.lineitem.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_linenumber").alias("g"),
                             F.when(k % 9 != 0, c("l_quantity")).alias("a"), F.when((k % 9 != 0) & (k % 4 != 0), c("l_extendedprice")).alias("b"),
                             F.when(k % 3 == 0, c("l_tax")).alias("d"))


HOLES = """h as (select l_orderkey*10+l_linenumber id, l_linenumber g, case when (l_orderkey*7+l_linenumber) % 9 <> 0 then l_quantity end a,
    case when (l_orderkey*7+l_linenumber) % 9 <> 0 and (l_orderkey*7+l_linenumber) % 4 <> 0 then l_extendedprice end b,
    case when (l_orderkey*7+l_linenumber) % 3 = 0 then l_tax end d from lineitem)"""


@query("missing_report", f"""with {HOLES}, r as (select 'id' c, count(*) n, count(*)-count(id) m, count(*) filter (id=0) z from h union all
    select 'g', count(*), count(*)-count(g), count(*) filter (g=0) from h union all select 'a', count(*), count(*)-count(a), count(*) filter (a=0) from h union all
    select 'b', count(*), count(*)-count(b), count(*) filter (b=0) from h union all select 'd', count(*), count(*)-count(d), count(*) filter (d=0) from h)
  select c as column, m n_missing, round(m/n, 8) ratio, m/n > 0.3 high, round(z/(n-m), 8) zero_ratio,
    (z/(n-m) > 0.5 and m > 0 and m/n < 0.5) suspect_zero_filled from r""")
def _(t):
    return M.missing_report(holes(t)).withColumns({"ratio": F.round("ratio", 8), "zero_ratio": F.round("zero_ratio", 8)})


@query("missing_patterns", f"""with {HOLES} select concat_ws(',', case when a is null then 'a' end, case when b is null then 'b' end, case when d is null then 'd' end) as columns,
  count(*) n, round(count(*)/(select count(*) from h), 8) ratio from h group by 1 having columns <> '' order by n desc, 1 limit 5""")
def _(t):
    return M.missing_patterns(holes(t)).withColumn("ratio", F.round("ratio", 8))


@query("drop_na_rows", f"with {HOLES} select count(*) n, round(sum(b), 2) b from h where a is not null and b is not null")
def _(t):
    return M.drop_na(holes(t), ["a", "b"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("b"), 2).alias("b"))


@query("impute_constants", f"""with {HOLES}, s as (select avg(b) mb, median(b) db, (select a from h where a is not null group by a order by count(*) desc, a limit 1) ma from h)
  select round(sum(coalesce(a, 0)), 2) zero, round(sum(coalesce(b, mb)), 2) mean, round(sum(coalesce(b, db)), 2) median, round(sum(coalesce(a, ma)), 2) as mode from h, s""")
def _(t):
    h = holes(t).select(c("a").alias("zero"), c("b").alias("mean"), c("b").alias("median"), c("a").alias("mode"))
    for k in ("zero", "mean", "median", "mode"):
        h = M.impute(h, k, [k])
    return h.agg(*[F.round(F.sum(k), 2).alias(k) for k in ("zero", "mean", "median", "mode")])


@query("impute_by_group", f"""with {HOLES}, s as (select g, avg(b) mb, median(b) db from h group by g)
  select h.g, round(sum(coalesce(b, mb)), 2) mean, round(sum(coalesce(b, db)), 2) median from h join s using (g) group by h.g""")
def _(t):
    h = holes(t).select("g", c("b").alias("mean"), c("b").alias("median"))
    h = M.impute(M.impute(h, "group_mean", ["mean"], group_by="g"), "group_median", ["median"], group_by="g")
    return h.groupBy("g").agg(F.round(F.sum("mean"), 2).alias("mean"), F.round(F.sum("median"), 2).alias("median"))


@query("impute_mice")
def _(t):
    p = t.part.select("p_partkey", c("p_size").cast("double").alias("a"), F.when(c("p_partkey") % 5 != 0, c("p_retailprice")).alias("b"),
                      F.when(c("p_partkey") % 7 != 0, c("p_retailprice") * 2 + c("p_size")).alias("d"))
    f = M.impute(p, "mice", ["a", "b", "d"], key="p_partkey")
    return f.agg(F.count("b").alias("b"), F.count("d").alias("d"), F.avg("b").alias("mean_b"))


# ---------------------------------------------------------------- distributions and structure
@query("numeric_distribution", """with l as (select 'l_extendedprice' as column, l_extendedprice v from lineitem union all select 'l_quantity', l_quantity from lineitem
    union all select 'l_discount', l_discount from lineitem),
  q as (select "column", count(*) n, avg(v) mean, stddev_samp(v) sd, skewness(v) sk, quantile_cont(v, .25) q1, median(v) q2, quantile_cont(v, .75) q3, mad(v) mad from l group by 1)
  select q.column, max(n) n, round(max(mean), 6) mean, round(max(sd), 6) sd, round(max(sk), 6) skewness, round(max(q1), 6) q1, round(max(q2), 6) median, round(max(q3), 6) q3,
    round(avg((v < q1-1.5*(q3-q1) or v > q3+1.5*(q3-q1))::int), 8) outlier_rate_iqr, round(avg((mad > 0 and abs(v-q2) > 3*mad)::int), 8) outlier_rate_mad,
    round(avg((v = 0)::int), 8) zeros_rate from l join q using ("column") group by 1""")
def _(t):
    r = P.numeric_summary(t.lineitem, ["l_extendedprice", "l_quantity", "l_discount"])
    return r.select("column", "n", *[F.round(k, 6).alias(k) for k in ("mean", "sd", "skewness", "q1", "median", "q3")],
                    *[F.round(k, 8).alias(k) for k in ("outlier_rate_iqr", "outlier_rate_mad", "zeros_rate")])


@query("histogram", """with s as (select min(l_extendedprice) a, max(l_extendedprice) b, least(20, greatest(5, floor(sqrt(count(*)))))::int k from lineitem),
  h as (select least(k-1, floor((l_extendedprice-a)/(b-a)*k))::int bin, count(*) c from lineitem, s group by 1)
  select i as bin, round(a+i*(b-a)/k, 6) as left, round(a+(i+1)*(b-a)/k, 6) as right, coalesce(c, 0) count from (select unnest(range(k))::int i, a, b, k from s) left join h on bin = i""")
def _(t):
    return P.histogram(t.lineitem, ["l_extendedprice"]).select("bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "count")


@query("category_distribution", """with r as (select c_nationkey::varchar v, count(*) n, row_number() over (order by count(*) desc, c_nationkey::varchar) r, count(*) over () k from customer group by 1)
  select least(r, 13) as rank, case when r <= 12 then v end as value, sum(n) n, max(k) n_levels from r group by 1, 2""")
def _(t):
    return P.category_summary(t.customer, ["c_nationkey"]).select("rank", "value", "n", "n_levels")


@query("semantic_types")
def _(t):
    return P.infer_types(t.lineitem).select("column", "type", "rank", "shape", "needs_confirm")


@query("composition_set", """select unnest(['click', 'error', 'purchase', 'signup', 'view']) member""")
def _(t):
    from workload.model_queries import MEMBERS, user_counts
    u = user_counts(t)
    total = sum((c(m) for m in MEMBERS), F.lit(0))
    shares = u.select("user_id", *[(c(m) / total).alias(m) for m in MEMBERS], (c("user_id") % 7 / 100.0).alias("other"))
    found = P.composition_set(shares, "click")
    return t.spark.createDataFrame([(m,) for m in sorted(found)], "member string")


@query("group_structure", """with v as (select 'o_orderkey' as column, o_orderkey::varchar v from orders union all select 'o_custkey', o_custkey::varchar from orders union all
    select 'o_orderstatus', o_orderstatus from orders union all select 'o_orderpriority', o_orderpriority from orders union all select 'o_orderdate', o_orderdate::varchar from orders),
  k as (select "column", v, count(*) n from v where v is not null group by all),
  s as (select "column", count(*) u, sum(n) n, max(n) m, stddev_samp(n)/avg(n) cv from k group by 1)
  select "column", u n_levels, round(u/n, 8) unique_ratio, round(n/u, 8) mean_per_group, m max_per_group, (u/n >= 0.9 or coalesce(cv, 0) < 0.5) balanced, u/n >= 0.9 is_identifier
  from s where u/n >= 0.9 or (n/u >= 2 and u/n <= 0.5)""")
def _(t):
    r = P.group_structure(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice"])
    return r.select("column", "n_levels", F.round("unique_ratio", 8).alias("unique_ratio"), F.round("mean_per_group", 8).alias("mean_per_group"),
                    "max_per_group", "balanced", "is_identifier")


@query("repeat_candidates", """select 'o_custkey' as column, count(*) n, count(distinct o_custkey) n_unique, count(*)-count(distinct o_custkey) repeats from orders""")
def _(t):
    return P.repeat_candidates(t.orders, ["o_orderkey", "o_custkey"])


@query("impute_knn", """with s as (select s_suppkey k, case when s_suppkey % 6 <> 0 then s_acctbal end a, s_nationkey::double b, case when s_suppkey % 4 <> 0 then s_acctbal * 2 end d from supplier),
  p as (select x.k, y.a ya, y.d yd, x.a xa, x.d xd, (coalesce(pow(x.a-y.a, 2), 0) + pow(x.b-y.b, 2) + coalesce(pow(x.d-y.d, 2), 0)) * 3
      / (1 + case when x.a is not null and y.a is not null then 1 else 0 end + case when x.d is not null and y.d is not null then 1 else 0 end) dist
    from s x join s y on x.k <> y.k where x.a is null or x.d is null),
  fa as (select k, avg(ya) v from (select *, row_number() over (partition by k order by dist, ya) r from p where xa is null and ya is not null) where r <= 5 group by k),
  fd as (select k, avg(yd) v from (select *, row_number() over (partition by k order by dist, yd) r from p where xd is null and yd is not null) where r <= 5 group by k),
  f as (select coalesce(s.a, fa.v) a, coalesce(s.d, fd.v) d from s left join fa using (k) left join fd using (k))
  select count(a) a, count(d) d, round(avg(a), 6) mean_a, round(avg(d), 6) mean_d from f""")
def _(t):
    s = t.supplier.select("s_suppkey", F.when(c("s_suppkey") % 6 != 0, c("s_acctbal")).alias("a"), c("s_nationkey").cast("double").alias("b"),
                          F.when(c("s_suppkey") % 4 != 0, c("s_acctbal") * 2).alias("d"))
    f = M.impute(s, "knn", ["a", "b", "d"], key="s_suppkey")
    return f.agg(F.count("a").alias("a"), F.count("d").alias("d"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("d"), 6).alias("mean_d"))


# ---------------------------------------------------------------- reports and reuse
@query("impute_report", """with h as (select case when s_suppkey % 6 <> 0 then s_acctbal end a, case when s_suppkey % 40 <> 0 then 0.5 end u from supplier)
  select 'a' as column, count(*) - count(a) n_filled, 0 n_remaining, round((count(*) - count(a))/count(*), 8) ratio_filled, 'mean fill on more than 10 % missing' warning from h union all
  select 'u', count(*) - count(u), 0, round((count(*) - count(u))/count(*), 8), null from h""")
def _(t):
    h = t.supplier.select(F.when(c("s_suppkey") % 6 != 0, c("s_acctbal")).alias("a"), F.when(c("s_suppkey") % 40 != 0, F.lit(0.5)).alias("u"))
    return M.impute_report(h, M.impute(h, "mean", ["a", "u"]), ["a", "u"], "mean").withColumn("ratio_filled", F.round("ratio_filled", 8))


@query("formula_reuse", """select o_orderkey, round(ln((o_totalprice + 1)/(o_custkey + 1)), 8) one, round(ln((o_custkey + 1)/(o_totalprice + 1)), 8) two, 'log-scale' kind from orders""")
def _(t):
    both = t.orders.select("o_orderkey", *[V.typed(V.bind(V.alr, a=x, b=y, eps=1.0), n, "log") for n, x, y in (("one", "o_totalprice", "o_custkey"), ("two", "o_custkey", "o_totalprice"))])
    kinds = {f.metadata["semantic_type"] for f in both.schema.fields if f.metadata}
    return both.select("o_orderkey", F.round("one", 8).alias("one"), F.round("two", 8).alias("two"), F.lit("|".join(sorted(kinds))).alias("kind"))


@query("count_set", """with l as (select l_linenumber lines_seen, floor(l_quantity) lines_sold, l_tax lines_rate, l_partkey part from lineitem)
  select 'lines_seen' as column from l having min(lines_seen) >= 0 and bool_and(lines_seen = floor(lines_seen)) union all
  select 'lines_sold' from l having min(lines_sold) >= 0 and bool_and(lines_sold = floor(lines_sold)) union all
  select 'lines_rate' from l having min(lines_rate) >= 0 and bool_and(lines_rate = floor(lines_rate))""")
def _(t):
    rows = t.lineitem.select(c("l_linenumber").alias("lines_seen"), F.floor("l_quantity").alias("lines_sold"), c("l_tax").alias("lines_rate"), c("l_partkey").alias("part"))
    return t.spark.createDataFrame([(v,) for v in P.count_set(rows, "lines_sold")], "column string")
