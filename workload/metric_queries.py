"""Metric values over the driver's tables."""
from pyspark.sql import functions as F

from statweave.functions import vectors as V
from statweave.operators import audit as A, metrics as M, neighbourhood as N, rank_tests as R
from workload.registry import query

c = F.col


def rd(df, digits=6, keep=(), skip=()):
    """Round every double column."""
    return df.select(*[F.round(n, digits).alias(n) if t == "double" and n not in keep else c(n) for n, t in df.dtypes if n not in skip])


# ---------------------------------------------------------------- errors
def _pred(t):
    return t.lineitem.select("l_returnflag", c("l_extendedprice").alias("y"), (c("l_quantity") * 900 * (1 + c("l_discount"))).alias("p"))


@query("sc_err_regression", """with p as (select l_returnflag, l_extendedprice y, l_quantity*900*(1+l_discount) p from lineitem)
  select l_returnflag, count(*) n, round(avg(abs(y-p)), 4) mae, round(sqrt(avg(pow(y-p,2))), 4) rmse, round(100*avg(abs(y-p)/abs(y)), 4) mape, count(*) filter (y=0) zero_y,
    round(100*avg(abs(y-p)/((abs(y)+abs(p))/2)), 4) smape, round(avg(pow(ln(1+y)-ln(1+p),2)), 4) msle, round(sqrt(avg(pow(ln(1+y)-ln(1+p),2))), 4) rmsle,
    round(1-sum(pow(y-p,2))/(count(*)*var_pop(y)), 4) r2, round(2*covar_pop(y,p)/(var_pop(y)+var_pop(p)+pow(avg(p)-avg(y),2)), 4) ccc, round(avg(p-y), 4) bias,
    round(avg(case when abs(y-p)<=1000 then pow(y-p,2)/2 else 1000*(abs(y-p)-500) end), 4) huber from p group by 1""")
def _(t):
    return rd(M.error_metrics(_pred(t), "y", "p", ["l_returnflag"], delta=1000.0), 4)


def scored(t):
    """Orders with a 0/1 label and two synthetic probabilities that depend on the row."""
    y = (c("o_orderstatus") == "F").cast("int")
    u = F.pmod(c("o_orderkey") * 37 + c("o_custkey"), F.lit(1000)) / 1000.0
    return t.orders.select("o_orderkey", "o_orderpriority", y.alias("y"), (0.02 + u * 0.75 + y * 0.2).alias("s"), (0.05 + u * 0.9).alias("old"))


SC = """sc as (select o_orderkey, o_orderpriority, (o_orderstatus='F')::int y, 0.02+((o_orderkey*37+o_custkey) % 1000)/1000.0*0.75+(o_orderstatus='F')::int*0.2 s,
  0.05+((o_orderkey*37+o_custkey) % 1000)/1000.0*0.9 old from orders)"""


@query("sc_err_probability", f"with {SC} select count(*) n, round(avg(pow(s-y,2)), 8) brier, round(-avg(y*ln(s)+(1-y)*ln(1-s)), 8) log_loss from sc")
def _(t):
    return rd(M.probability_errors(scored(t), "y", "s"), 8)


@query("sc_cls_confusion", f"""with {SC}, k as (select o_orderpriority g, count(*) filter (s>=.5 and y=1)::double tp, count(*) filter (s>=.5 and y=0)::double fp, count(*) filter (s<.5 and y=1)::double fn,
    count(*) filter (s<.5 and y=0)::double tn from sc group by 1), r as (select *, tp/(tp+fn) se, tn/(tn+fp) sp, tp+fp+fn+tn n, ((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/pow(tp+fp+fn+tn,2) pe from k)
  select g, tp, fp, fn, tn, round(se,6) sensitivity, round(sp,6) specificity, round(tp/(tp+fp),6) ppv, round(tn/(tn+fn),6) npv, round(se/(1-sp),6) lr_plus, round((1-se)/sp,6) lr_minus,
    round(se+sp-1,6) youden_j, round(2*tp/(2*tp+fn+fp),6) f_beta, round((tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)),6) mcc, round((se+sp)/2,6) balanced_accuracy,
    round(((tp+tn)/n-pe)/(1-pe),6) kappa, round(tp/n-fp/n,6) net_benefit from r""")
def _(t):
    return rd(M.confusion_metrics(scored(t).withColumnRenamed("o_orderpriority", "g"), "y", "s", 0.5, ["g"]))


@query("sc_cls_06_08_roc_pr_by_group", f"""with {SC}, v as (select o_orderpriority g, s, count(*) n, sum(y) pos from sc group by all),
  w as (select *, sum(n) over d cn, sum(pos) over d cp, sum(n-pos) over a - (n-pos) below, sum(pos) over (partition by g) tp, sum(n) over (partition by g) tn from v window d as (partition by g order by s desc), a as (partition by g order by s))
  select g, round(sum(pos*(below+(n-pos)/2.0))/(max(tp)*(max(tn)-max(tp))), 8) roc_auc, round(sum(pos*cp/cn::double)/max(tp), 8) pr_auc from w group by g""")
def _(t):
    r = A.roc_pr(scored(t).withColumnRenamed("o_orderpriority", "g"), "s", "y", ["g"])
    return r.select("g", F.round("roc_auc", 8).alias("roc_auc"), F.round("pr_auc", 8).alias("pr_auc"))


@query("sc_cls_07_partial_auc", f"""with {SC}, v as (select s, count(*) filter (y=1) p, count(*) filter (y=0) q from sc group by 1),
  w as (select s, sum(p) over o/(sum(p) over ())::double t1, sum(q) over o/(sum(q) over ())::double f1, p/(sum(p) over ())::double dt, q/(sum(q) over ())::double df from v window o as (order by s desc)),
  a as (select sum((least(f1,0.2)-(f1-df))*((t1-dt) + (t1-dt) + coalesce(dt*(least(f1,0.2)-(f1-df))/nullif(df,0), 0))/2) a from w where f1-df < 0.2)
  select round(a, 7) pauc, round(0.5*(1+(a-0.02)/(0.2-0.02)), 7) pauc_mcclish from a""")
def _(t):
    return rd(M.partial_auc(scored(t), "y", "s", 0.2), 7)


@query("sc_cls_13_ece", f"with {SC}, b as (select least(9, floor(s*10)) b, count(*) n, avg(s) p, avg(y) a from sc group by 1) select round(sum(n*abs(p-a))/sum(n), 8) ece from b")
def _(t):
    return A.calibration_error(scored(t)).select(F.round("ece", 8).alias("ece"))


@query("sc_cls_16_nri_idi", f"""with {SC}, x as (select y, (s>=.3)::int+(s>=.6)::int cn, (old>=.3)::int+(old>=.6)::int co, s, old from sc)
  select round(avg((cn>co)::int) filter (y=1)-avg((cn<co)::int) filter (y=1)+avg((cn<co)::int) filter (y=0)-avg((cn>co)::int) filter (y=0), 8) nri,
    round(avg(s) filter (y=1)-avg(s) filter (y=0)-avg(old) filter (y=1)+avg(old) filter (y=0), 8) idi from x""")
def _(t):
    return rd(M.reclassification(scored(t), "y", "old", "s", [0.3, 0.6]), 8)


@query("sc_cls_17_top_k", """select round(avg((len([x for x in embedding if x >= embedding[label + 1]]) <= 5)::int), 8) top5 from embeddings where label is not null""")
def _(t):
    s = F.transform("embedding", lambda x: x.cast("double"))
    hit = V.top_k_hit(s, F.sequence(F.lit(0), F.size("embedding") - 1), c("label"), 5)
    return t.embeddings.where("label is not null").agg(F.round(F.avg(hit.cast("double")), 8).alias("top5"))


# ---------------------------------------------------------------- distances of neighbouring vectors
def _vec_pairs(t):
    e = t.embeddings.select("vec_id", c("embedding").cast("array<double>").alias("a"))
    f = t.embeddings.select((c("vec_id") - 1).alias("vec_id"), c("embedding").cast("array<double>").alias("b"))
    return e.join(f, "vec_id")


_VP = """vp as (select a.vec_id, a.embedding::double[] a, b.embedding::double[] b from embeddings a join embeddings b on b.vec_id = a.vec_id+1),
  el as (select vec_id, unnest(a) x, unnest(b) y from vp)"""


@query("sc_dist_vectors", f"""with {_VP} select vec_id, round(sqrt(sum(pow(x-y,2))), 6) euclidean, round(sum(abs(x-y)), 6) manhattan, round(sum(x*y)/sqrt(sum(x*x)*sum(y*y)), 6) cosine,
  round(1-corr(x,y), 6) pearson, round(avg((x<>y)::int), 6) hamming from el group by 1""")
def _(t):
    return rd(_vec_pairs(t).select("vec_id", V.euclidean("a", "b").alias("euclidean"), V.manhattan("a", "b").alias("manhattan"), V.cosine_similarity("a", "b").alias("cosine"),
                                   V.pearson_distance("a", "b").alias("pearson"), V.hamming(c("a"), c("b")).alias("hamming")))


@query("sc_dist_compositions", f"""with {_VP}, p as (select vec_id, abs(x)+.01 x, abs(y)+.01 y from el), q as (select *, x/sum(x) over (partition by vec_id) p, y/sum(y) over (partition by vec_id) q,
    ln(x)-avg(ln(x)) over (partition by vec_id) cx, ln(y)-avg(ln(y)) over (partition by vec_id) cy from p)
  select vec_id, round(sum(abs(x-y))/sum(x+y), 6) bray_curtis, round(sqrt(sum(pow(cx-cy,2))), 6) aitchison, round(sqrt(sum(pow(sqrt(p)-sqrt(q),2)))/sqrt(2), 6) hellinger,
    round(sum(p*ln(p/q)), 6) kl, round(sqrt((sum(p*ln(2*p/(p+q)))+sum(q*ln(2*q/(p+q))))/2), 6) js, round(sum(abs(p-q))/2, 6) tv from q group by 1""")
def _(t):
    pos = lambda v: F.transform(v, lambda x: F.abs(x) + 0.01)
    p = _vec_pairs(t).select("vec_id", pos("a").alias("a"), pos("b").alias("b"))
    return rd(p.select("vec_id", V.bray_curtis("a", "b").alias("bray_curtis"), V.aitchison("a", "b").alias("aitchison"), V.hellinger("a", "b").alias("hellinger"),
                       V.kl_divergence("a", "b").alias("kl"), V.jensen_shannon("a", "b").alias("js"), V.total_variation("a", "b").alias("tv")))


@query("sc_dist_07_jaccard", """with u as (select user_id, date_trunc('week', ts) w, list(distinct event_type) s from events group by all),
  p as (select a.user_id, a.w, list_intersect(a.s, b.s) i, a.s a, b.s b from u a join u b on a.user_id = b.user_id and b.w = a.w + interval 7 day)
  select count(*) n, round(avg(1-len(i)/(len(a)+len(b)-len(i))), 8) mean_distance from p""")
def _(t):
    u = t.events.groupBy("user_id", F.date_trunc("week", "ts").alias("w")).agg(F.collect_set("event_type").alias("s"))
    v = u.select("user_id", (c("w") - F.expr("interval 7 day")).alias("w"), c("s").alias("s2"))
    return u.join(v, ["user_id", "w"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.jaccard("s", "s2")), 8).alias("mean_distance"))


@query("sc_dist_03_mahalanobis", """with s as (select avg(l_quantity) m1, avg(l_discount) m2, var_samp(l_quantity) v1, var_samp(l_discount) v2, covar_samp(l_quantity, l_discount) c from lineitem)
  select round(avg(d), 8) mean, round(max(d), 8) max from (select sqrt((v2*pow(l_quantity-m1,2) - 2*c*(l_quantity-m1)*(l_discount-m2) + v1*pow(l_discount-m2,2))/(v1*v2-c*c)) d from lineitem, s)""")
def _(t):
    r = M.mahalanobis_rows(t.lineitem, ["l_quantity", "l_discount"])
    return r.agg(F.round(F.avg("mahalanobis"), 8).alias("mean"), F.round(F.max("mahalanobis"), 8).alias("max"))


@query("sc_dist_14_mmd", """with k as (select a.label % 2 p, b.label % 2 q, avg(exp(-0.05*list_distance(a.embedding::double[], b.embedding::double[])*list_distance(a.embedding::double[], b.embedding::double[]))) k
    from embeddings a cross join embeddings b group by all) select round(sum(case when p = q then k else -k end), 8) mmd2 from k""")
def _(t):
    e = t.embeddings.select("vec_id", (c("label") % 2).cast("string").alias("g"), "embedding")
    return rd(M.mmd(e, "embedding", "g", ["0", "1"], 0.05, key="vec_id"), 8)


@query("sc_dist_14_mmd_fourier")
def _(t):
    e = t.embeddings.select((c("label") % 2).cast("string").alias("g"), "embedding")
    return M.mmd(e, "embedding", "g", ["0", "1"], 0.05, features=512)


@query("sc_dist_16_gower", """with r as (select max(p_size)-min(p_size) w1, max(p_retailprice)-min(p_retailprice) w2 from part),
  p as (select a.p_partkey, (abs(a.p_size-b.p_size)/w1::double + abs(a.p_retailprice-b.p_retailprice)/w2 + (a.p_brand<>b.p_brand)::int)/3 d from part a join part b on b.p_partkey = a.p_partkey+1, r)
  select p_partkey, round(d, 8) gower from p""")
def _(t):
    p = t.part
    r = p.agg(F.max("p_size") - F.min("p_size"), F.max("p_retailprice") - F.min("p_retailprice")).first()
    b = p.select((c("p_partkey") - 1).alias("p_partkey"), c("p_size").alias("s2"), c("p_retailprice").alias("r2"), c("p_brand").alias("b2"))
    d = V.gower({"size": (c("p_size"), c("s2"), float(r[0])), "price": (c("p_retailprice"), c("r2"), float(r[1]))}, {"brand": (c("p_brand"), c("b2"))})
    return p.join(b, "p_partkey").select("p_partkey", F.round(d, 8).alias("gower"))


@query("sc_dist_13_18_samples", """with e as (select o_totalprice v, count(*) filter (o_orderstatus='F') a, count(*) filter (o_orderstatus='O') b from orders where o_orderstatus in ('F','O') group by 1),
  w as (select v, sum(a) over (order by v)/(sum(a) over ())::double fa, sum(b) over (order by v)/(sum(b) over ())::double fb, lead(v) over (order by v)-v g from e)
  select round(sum(abs(fa-fb)*g), 4) wasserstein, round(max(abs(fa-fb)), 8) ks from w""")
def _(t):
    from statweave.operators.regression import _paste
    w = R.energy_distance(t.orders, "o_totalprice", "o_orderstatus", ["F", "O"], permutations=0).select(F.round(c("numbers")["wasserstein"], 4).alias("wasserstein"))
    k = R.ks_two_sample(t.orders, "o_totalprice", "o_orderstatus", ["F", "O"]).select(F.round("statistic", 8).alias("ks"))
    return _paste(w, k)


@query("sc_dist_19_total_variation", """with t as (select o_orderpriority, count(*) filter (o_orderstatus='F')::double a, count(*) filter (o_orderstatus='O')::double b from orders group by 1)
  select round(sum(abs(a/(select sum(a) from t) - b/(select sum(b) from t)))/2, 8) tv from t""")
def _(t):
    return rd(M.total_variation(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O"]), 8)


# ---------------------------------------------------------------- diversity, information, entropy
@query("sc_div_diversity", """with t as (select o_orderpriority g, o_custkey, count(*)::double n from orders group by all), p as (select *, n/sum(n) over (partition by g) p from t)
  select g, round(-sum(p*ln(p)), 6) shannon, round(1-sum(p*p), 6) simpson, round(1/sum(p*p), 6) inverse_simpson, round(-ln(sum(p*p)), 6) renyi, round(1/sum(p*p), 6) hill, count(*) richness,
    round(count(*)+pow(count(*) filter (n=1),2)/(2*count(*) filter (n=2)), 6) chao1, round(-sum(p*ln(p))/ln(count(*)), 6) pielou from p group by g""")
def _(t):
    return rd(M.diversity(t.orders.withColumnRenamed("o_orderpriority", "g"), "o_custkey", ["g"]))


@query("sc_div_08_gini", """with r as (select o_orderstatus g, o_totalprice x, row_number() over (partition by o_orderstatus order by o_totalprice) i, count(*) over (partition by o_orderstatus) n from orders)
  select g, round(sum((2*i-n-1)*x)/(max(n)*sum(x)), 8) gini from r group by g""")
def _(t):
    return rd(M.gini_coefficient(t.orders.withColumnRenamed("o_orderstatus", "g"), "o_totalprice", ["g"]), 8)


@query("sc_ent_parametric", """with s as (select var_samp(l_quantity) v, avg(l_quantity) m, avg(ln(l_quantity)) ml, var_samp(ln(l_quantity)) vl, quantile_cont(l_quantity, .75)-quantile_cont(l_quantity, .25) q from lineitem)
  select round(0.5*ln(2*pi()*exp(1)*v), 8) normal, round(1+ln(m), 8) exponential, round(ml+0.5*ln(2*pi()*exp(1)*vl), 8) lognormal, round(ln(4*pi()*q/2), 8) cauchy from s""")
def _(t):
    r = M.entropy_fits(t.lineitem, "l_quantity")
    return rd(r.select("normal", "exponential", "lognormal", "cauchy"), 8)


@query("sc_ent_special_laws")
def _(t):
    return M.entropy_fits(t.lineitem.withColumn("u", (c("l_quantity") + 0.5) / 52.0), "u").select("gamma", "beta", "von_mises")


@query("sc_ent_02_multivariate_normal", """with s as (select var_samp(l_quantity) a, var_samp(l_discount) b, covar_samp(l_quantity, l_discount) c from lineitem) select round(0.5*(2*ln(2*pi()*exp(1)) + ln(a*b-c*c)), 8) entropy from s""")
def _(t):
    return rd(M.multivariate_normal_entropy(t.lineitem, ["l_quantity", "l_discount"]), 8, skip=("n",))


@query("sc_ent_07_dirichlet")
def _(t):
    from workload.model_queries import MEMBERS, user_counts
    return M.dirichlet_entropy(user_counts(t), MEMBERS)


@query("sc_ent_11_spacing", """with d as (select p_retailprice v, count(*) n from part group by 1), g as (select v, n, v-lag(v) over (order by v) a, lead(v) over (order by v)-v b, (select count(*) from part)::double t from d)
  select round(ln(max(t))-1/(2*max(t))-1/(12*max(t)*max(t))+0.5772156649015329+ln(2)+avg(ln(least(coalesce(a,b), coalesce(b,a)))) filter (n=1), 6) entropy, count(*) filter (n=1) used from g""")
def _(t):
    return rd(M.spacing_entropy(t.part, "p_retailprice"), 6, skip=("tied_rows",))


@query("sc_ent_12_binned", """with s as (select min(o_totalprice) a, max(o_totalprice) b from orders), h as (select least(19, floor((o_totalprice-a)/(b-a)*20)) i, count(*)::double n from orders, s group by 1)
  select round(-sum(n/(select count(*) from orders)*ln(n/(select count(*) from orders))), 8) entropy from h""")
def _(t):
    return rd(M.binned_entropy(t.orders, "o_totalprice"), 8)


@query("sc_inf_mutual_information", """with t as (select l_returnflag a, l_linestatus b, count(*)::double o from lineitem group by all), m as (select *, sum(o) over (partition by a) ra, sum(o) over (partition by b) rb, sum(o) over () n from t),
  ha as (select -sum(x/n*ln(x/n)) h from (select distinct a, ra x, n from m)), hb as (select -sum(x/n*ln(x/n)) h from (select distinct b, rb x, n from m)), i as (select sum(o/n*ln(o*n/(ra*rb))) mi from m)
  select round(mi, 10) mi, round(mi/sqrt(ha.h*hb.h), 10) nmi, round(ha.h, 10) ha, round(hb.h, 10) hb from i, ha, hb""")
def _(t):
    return rd(M.information(t.lineitem, "l_returnflag", "l_linestatus"), 10)


@query("sc_inf_cross_entropy", """with t as (select o_orderpriority, count(*) filter (o_orderstatus='F')::double a, count(*) filter (o_orderstatus='O')::double b from orders group by 1), p as (select a/sum(a) over () p, b/sum(b) over () q from t)
  select round(-sum(p*ln(q)), 8) cross_entropy, round(pow(2, -sum(p*log2(p))), 8) perplexity from p""")
def _(t):
    return rd(M.cross_entropy(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O"]), 8)


# ---------------------------------------------------------------- batch effects on the embeddings
@query("sc_be_silhouette", """with d as (select a.vec_id, a.label la, b.label lb, pow(list_distance(a.embedding::double[], b.embedding::double[]), 2) d from embeddings a join embeddings b on a.vec_id <> b.vec_id),
  m as (select vec_id, la, lb, avg(d) m from d group by all), s as (select vec_id, max(m) filter (la=lb) a, min(m) filter (la<>lb) b from m group by vec_id)
  select round(avg((b-a)/greatest(a,b)), 8) silhouette, round(avg(1-abs((b-a)/greatest(a,b))), 8) asw_batch from s""")
def _(t):
    return rd(N.silhouette(t.embeddings, "embedding", "label"), 8)


@query("sc_be_neighbourhood", """with d as (select a.vec_id, b.vec_id other, b.label l, row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) r from embeddings a join embeddings b on a.vec_id <> b.vec_id),
  o as (select vec_id, l, count(*)::double o from d where r <= 15 group by all), k as (select count(distinct label) m from embeddings),
  s as (select vec_id, sum(pow(o/15,2)) d, -sum(o/15*ln(o/15)) h from o group by 1) select round(avg(1/d), 6) lisi, round(avg(h)/ln(max(m)), 6) neighbour_entropy from s, k""")
def _(t):
    return rd(N.mixing(t.embeddings, "vec_id", "embedding", "label", 15), 6, skip=("kbet_accept",))


_NEAR = """d as (select a.vec_id qid, b.vec_id did, list_distance(a.embedding::double[], b.embedding::double[]) d from embeddings a join embeddings b on a.vec_id <> b.vec_id),
  r as (select qid, did, row_number() over (partition by qid order by d, did) r from d), k as (select qid, did from r where r <= 15)"""


@query("sc_be_03_kbet", f"""with {_NEAR}, p as (select label l, count(*)/(sum(count(*)) over ())::double p from embeddings group by 1),
  crit(df, q) as (values (1, 3.841458820694124), (2, 5.991464547107979), (3, 7.814727903251179), (4, 9.487729036781154), (5, 11.070497693516351), (6, 12.591587243743977), (7, 14.067140449340169),
    (8, 15.507313055865453), (9, 16.918977604620448), (10, 18.307038053275146), (11, 19.67513757268249), (12, 21.02606981748307), (13, 22.362032494826934), (14, 23.684791304840576), (15, 24.99579013972863)),
  o as (select qid, e.label l, count(*) o from k join embeddings e on e.vec_id = k.did group by 1, 2),
  x as (select v.vec_id, sum(pow(coalesce(o, 0) - 15*p, 2)/(15*p)) x2 from embeddings v cross join p left join o on o.qid = v.vec_id and o.l = p.l group by 1)
  select round(avg((x2 <= (select q from crit where df = (select count(*) - 1 from p)))::int), 8) kbet_accept from x""")
def _(t):
    return N.mixing(t.embeddings, "vec_id", "embedding", "label", 15).select(F.round("kbet_accept", 8).alias("kbet_accept"))


@query("knn_forest_recall", "select count(*) filter (vec_id % 10 = 0) queries, true found from embeddings where embedding is not null")
def _(t):
    from statweave.plans.neighbours import knn_forest, knn_recall
    found = knn_forest(t.embeddings, "vec_id", "embedding", 5, leaf=128)
    r = knn_recall(t.embeddings, "vec_id", "embedding", found, 5, t.embeddings.where("vec_id % 10 = 0 and embedding is not null"))
    return r.select("queries", (c("recall") >= 0.9).alias("found"))


@query("knn_table", """with d as (select a.vec_id qid, b.vec_id did, list_distance(a.embedding::double[], b.embedding::double[]) d from embeddings a join embeddings b on a.vec_id <> b.vec_id),
  r as (select *, row_number() over (partition by qid order by d, did) r from d) select qid, did, round(d, 6) dist, r as rank from r where r <= 5""")
def _(t):
    from statweave.plans.neighbours import knn
    return rd(knn(t.embeddings, "vec_id", "embedding", 5))


@query("sc_be_05_pc_regression")
def _(t):
    return N.pc_regression(t.embeddings, "embedding", "label", 10)


@query("sc_be_08_connectivity", f"""with recursive {_NEAR}, e as (select qid a, did b from k join embeddings x on x.vec_id = qid join embeddings y on y.vec_id = did where x.label = y.label),
  u as (select a, b from e union select b, a from e), reach(id, root) as (select vec_id, vec_id from embeddings where label is not null union select u.b, reach.root from reach join u on u.a = reach.id),
  c as (select v.label, min(root) root from reach join embeddings v on v.vec_id = reach.id group by reach.id, v.label), s as (select label, root, count(*) n from c group by 1, 2),
  l as (select label, max(n)/sum(n)::double share from s group by 1)
  select round(avg(share), 8) connectivity, count(*) labels from l""")
def _(t):
    return N.graph_connectivity(t.embeddings, "vec_id", "embedding", "label", 15).select(F.round("connectivity", 8).alias("connectivity"), "labels")


# ---------------------------------------------------------------- normalisation
_LONG = "g as (select user_id s, event_type f, count(*)::double n, (ascii(event_type)-90)::double len from events group by all)"


def _counts(t):
    return t.events.groupBy(c("user_id").alias("s"), c("event_type").alias("f")).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("len", (F.ascii("f") - 90).cast("double"))


@query("sc_norm_library_size", f"""with {_LONG} select s, f, round(n*1e6/sum(n) over (partition by s), 4) cpm, round(n/len*1e6/sum(n/len) over (partition by s), 4) tpm,
  round(n*1e9/(len*sum(n) over (partition by s)), 3) rpkm, round(ln(1+n), 8) log1p from g""")
def _(t):
    g = M.rpkm(M.tpm(M.cpm(_counts(t), "s", "n"), "s", "n", "len"), "s", "n", "len")
    return g.select("s", "f", F.round("cpm", 4).alias("cpm"), F.round("tpm", 4).alias("tpm"), F.round("rpkm", 3).alias("rpkm"), F.round(F.log1p("n"), 8).alias("log1p"))


@query("sc_norm_scaling", """with m as (select median(p_retailprice) m, mad(p_retailprice) d, min(p_retailprice) a, max(p_retailprice) b, avg(p_retailprice) u, stddev_samp(p_retailprice) s from part)
  select p_partkey, round((p_retailprice-m)/(1.4826*d), 8) rz, round((p_retailprice-a)/(b-a), 8) mm, round((p_retailprice-u)/s, 8) z from part, m""")
def _(t):
    from statweave.functions.derive import with_zscore
    d = M.min_max(M.robust_z(with_zscore(t.part, "p_retailprice", "z"), "p_retailprice", "rz"), "p_retailprice", "mm")
    return d.select("p_partkey", *[F.round(k, 8).alias(k) for k in ("rz", "mm", "z")])


@query("sc_norm_08_quantile", """with r as (select p_partkey, p_size::double a, p_retailprice b, row_number() over (order by p_size) ra, row_number() over (order by p_retailprice) rb from part),
  m as (select x.ra r, (x.a+y.b)/2 m from r x join r y on x.ra = y.rb), a as (select a, avg(m) m from r join m on r = ra group by a), b as (select b, avg(m) m from r join m on r = rb group by b)
  select p_partkey, round(a.m, 6) p_size, round(b.m, 6) p_retailprice from r join a using (a) join b using (b)""")
def _(t):
    return rd(M.quantile_normalise(t.part, "p_partkey", ["p_size", "p_retailprice"]))


@query("sc_norm_12_power")
def _(t):
    d, lam = M.power_transform(t.lineitem, "l_extendedprice", "bc")
    return d.agg(F.lit(lam).alias("lambda"), F.skewness("bc").alias("skew_after"), F.skewness("l_extendedprice").alias("skew_before"))


@query("sc_norm_13_inverse_normal_rank")
def _(t):
    r = M.inverse_normal_rank(t.part, "p_retailprice", "z")
    return r.agg(F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd"), F.max("z").alias("max"))


@query("sc_norm_14_rarefaction", """with u as (select user_id, count(*) n from events group by 1) select count(*) n, count(*)*30 individuals from u where n >= 30""")
def _(t):
    from workload.model_queries import MEMBERS, user_counts
    r = M.rarefy(user_counts(t), MEMBERS, ["user_id"], 30)
    return r.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((c(m) for m in MEMBERS), F.lit(0))).alias("individuals"))


# ---------------------------------------------------------------- variability and clinical
@query("sc_var_variability", """with m as (select l_returnflag g, median(l_tax*10) md, quantile_cont(l_tax*10, .75)-quantile_cont(l_tax*10, .25) q from lineitem group by 1),
  d as (select l_returnflag g, median(abs(l_tax*10-md)) mad from lineitem join m on g = l_returnflag group by 1),
  s as (select l_returnflag g, count(*) n, avg(l_tax*10) a, stddev_samp(l_tax*10) sd, kurtosis_pop(l_tax*10) k from lineitem group by 1)
  select g, n, round(sd, 6) sd, round(100*sd/a, 6) cv, round(mad, 6) mad, round(sd/sqrt(a*(1-a)), 6) bernoulli_scaled, round(sd*sd/a, 6) fano, round(q, 6) iqr, round(a/sd, 6) snr, round(k, 6) kurt
  from s join m using (g) join d using (g)""")
def _(t):
    return rd(M.variability(t.lineitem.select(c("l_returnflag").alias("g"), (c("l_tax") * 10).alias("v")), "v", ["g"]), 6, skip=("skew",))


@query("sc_var_09_gini_simpson", "with t as (select p_brand, count(*)::double n from part group by 1), p as (select n/sum(n) over () p from t) select round(1-sum(p*p), 8) gini_simpson from p")
def _(t):
    return M.diversity(t.part, "p_brand").select(F.round("simpson", 8).alias("gini_simpson"))


@query("sc_cln_risk", """with r as (select avg((l_returnflag='R')::int) filter (l_discount > 0.05) a, avg((l_returnflag='R')::int) filter (l_discount <= 0.05) b from lineitem)
  select round(a-b, 8) risk_difference, round(1/abs(a-b), 4) nnt, round(a/b, 8) risk_ratio, round((a/b-1)/(a/b), 8) attributable_fraction from r""")
def _(t):
    s = t.lineitem.select((c("l_discount") > 0.05).cast("int").alias("x"), (c("l_returnflag") == "R").cast("int").alias("y"))
    return rd(M.risk_measures(s, "x", "y"), 8, keep=("nnt",)).withColumn("nnt", F.round("nnt", 4))


@query("sc_cln_04_incidence", """with fu as (select datediff('day', o_orderdate, l_shipdate) t, (l_returnflag='R')::int d, o_orderstatus g from lineitem join orders on l_orderkey=o_orderkey where datediff('day', o_orderdate, l_shipdate) > 0)
  select g, sum(d)::double events, sum(t)::double person_time, round(1000*sum(d)/sum(t), 8) rate from fu group by g""")
def _(t):
    from workload.model_queries import follow_up
    return M.incidence(follow_up(t).withColumnRenamed("o_orderstatus", "g"), "event", "days", ["g"]).withColumn("rate", F.round("rate", 8))


@query("sc_cln_05_sir", """with fu as (select datediff('day', o_orderdate, l_shipdate) t, (l_returnflag='R')::int d, o_orderstatus g from lineitem join orders on l_orderkey=o_orderkey where datediff('day', o_orderdate, l_shipdate) > 0),
  r as (select g, sum(d)/sum(t) rate from fu group by g), x as (select g, sum(d) o, sum(t) t from fu where t > 100 group by g)
  select sum(o)::double observed, round(sum(t*rate), 4) expected, round(sum(o)/sum(t*rate), 8) sir from x join r using (g)""")
def _(t):
    from workload.model_queries import follow_up
    f = follow_up(t)
    ref = M.incidence(f, "event", "days", ["o_orderstatus"], per=1.0).select(c("o_orderstatus").alias("stratum"), "rate")
    r = M.standardised_ratio(f.where("days > 100").withColumnRenamed("o_orderstatus", "stratum_"), "event", "days", "stratum_", ref)
    return r.select("observed", F.round("expected", 4).alias("expected"), F.round("sir", 8).alias("sir"))
