"""Batch-mixing measures over vectors: silhouettes by group sums, the rest from one kNN table."""
from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from statweave.functions import distributions as D
from statweave.functions.vectors import total, vec
from statweave.plans.common import MAX_LEVELS, cut_lineage, ratio, sq
from statweave.plans.moments import group_moments, sums_of_squares
from statweave.plans.neighbours import knn, knn_forest

c = F.col


def silhouette_rows(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Silhouette per row under squared Euclidean distance.  The mean squared distance to a cluster
    needs only its size, vector sum and summed squared norms, so no pair is formed."""
    src = df.select("*", vec(vector).alias("_v"), c(label).cast("string").alias("_l")).where("_v is not null and _l is not null")
    long = src.select("_l", F.posexplode("_v").alias("i", "x"))
    sums = long.groupBy("_l", "i").agg(F.sum("x").alias("s"), F.sum(sq(c("x"))).alias("q"), F.count(F.lit(1)).alias("n"))
    per = sums.groupBy("_l").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s"), F.sum("q").alias("q"), F.max("n").cast("double").alias("n"))
    per = per.select("_l", F.transform("s", lambda r: r["s"]).alias("s"), "q", "n")
    if per.limit(MAX_LEVELS + 1).count() > MAX_LEVELS:
        raise ValueError(f"{label!r} has too many levels for a silhouette")
    table = per.agg(F.collect_list(F.struct(c("_l").alias("l"), "s", "q", "n"))).scalar()
    x2 = total(F.transform("_v", lambda x: x * x))
    src = src.withColumn("_t", table).withColumn("_x2", x2)
    d = F.transform("_t", lambda t: F.struct(
        (t["l"] == c("_l")).alias("own"), t["n"].alias("n"),
        (c("_x2") * t["n"] + t["q"] - 2 * total(F.zip_with(c("_v"), t["s"], lambda a, b: a * b))).alias("sum")))
    src = src.withColumn("_d", d)
    own = F.filter("_d", lambda r: r["own"])[0]
    a = ratio(own["sum"], own["n"] - 1)
    b = F.array_min(F.transform(F.filter("_d", lambda r: ~r["own"]), lambda r: r["sum"] / r["n"]))
    s = F.when(own["n"] <= 1, 0.0).otherwise(ratio(b - a, F.greatest(a, b)))
    return src.withColumn("silhouette", F.greatest(F.lit(-1.0), s)).drop("_v", "_l", "_t", "_x2", "_d")


def silhouette(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean silhouette and 1 - |s| averaged (batch mixing)."""
    return silhouette_rows(df, vector, label).agg(F.avg("silhouette").alias("silhouette"), F.avg(1 - F.abs("silhouette")).alias("asw_batch"))


def neighbours(df: DataFrame, key: str, vector: str, k: int, exact: bool = False) -> DataFrame:
    """The kNN table: from the forest, or exact by the block join."""
    return knn(df, key, vector, k) if exact else knn_forest(df, key, vector, k)


def neighbour_labels(df: DataFrame, key: str, vector: str, label: str, k: int, exact: bool = False) -> DataFrame:
    """(qid, own label, neighbour label, count) over the kNN table."""
    n = neighbours(df, key, vector, k, exact)
    lab = df.select(c(key).cast("long").alias("_id"), c(label).cast("string").alias("_lab"))
    j = n.join(lab, c("did") == c("_id")).select("qid", c("_lab").alias("other"))
    return j.groupBy("qid", "other").agg(F.count(F.lit(1)).cast("double").alias("o"))


def mixing(df: DataFrame, key: str, vector: str, label: str, k: int = 15, alpha: float = 0.05, exact: bool = False) -> DataFrame:
    """kBET acceptance, LISI (inverse Simpson of neighbours) and normalised neighbour entropy."""
    share = df.where(c(label).isNotNull()).groupBy(c(label).cast("string").alias("l")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = share.limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{label!r} has too many levels")
    tot, m = sum(r["n"] for r in rows), len(rows)
    crit = float(D.bisect(lambda v: -D.chi2_sf(v, m - 1), np.array(-alpha), np.array(0.0), np.array(10.0 * m + 100)))
    p_of = F.create_map(*[x for r in rows for x in (F.lit(r["l"]), F.lit(r["n"] / tot))])
    t = neighbour_labels(df, key, vector, label, k, exact)
    p = c("o") / c("_k")
    q = t.groupBy("qid").agg(F.sum("o").alias("_k"), F.collect_list(F.struct("other", "o")).alias("_o")).select("qid", "_k", F.explode("_o").alias("r")).select("qid", "_k", "r.*")
    e = c("_k") * p_of[c("other")]
    # levels without a neighbour contribute their expectation, which is k minus the seen expectations
    s = q.groupBy("qid").agg((F.sum(sq(c("o") - e) / e) + F.max("_k") - F.sum(e)).alias("x2"), F.sum(sq(p)).alias("d"), (-F.sum(p * F.ln(p))).alias("h"))
    return s.agg(F.avg((c("x2") <= crit).cast("double")).alias("kbet_accept"), F.avg(1 / c("d")).alias("lisi"),
                 F.avg(c("h") / float(np.log(max(m, 2)))).alias("neighbour_entropy"))


def pc_regression(df: DataFrame, vector: str, batch: str, components: int = 10) -> DataFrame:
    """Share of total variance the batch explains: sum over components of variance times R2."""
    src = df.where(c(batch).isNotNull()).select(c(batch).cast("string").alias("b"), array_to_vector(vec(vector)).alias("f"))
    k = min(components, src.select(F.size(vector_to_array("f"))).first()[0])
    model = PCA(k=k, inputCol="f", outputCol="pc").fit(src)
    var = [float(v) for v in model.explainedVariance]
    pcs = model.transform(src).select("b", F.posexplode(vector_to_array("pc")).alias("i", "v"))
    r2 = sums_of_squares(group_moments(pcs, "v", "b", ["i"]), ["i"]).select("i", ratio(c("ssb"), c("ssb") + c("ssw")).alias("r2"))
    w = F.array(*[F.lit(v) for v in var])[c("i")]
    return r2.agg(F.sum(w * c("r2")).alias("variance_by_batch"), (F.sum(w * c("r2")) / F.sum(w)).alias("share_of_components"))


def connected_components(vertices: DataFrame, edges: DataFrame, max_iter: int = 1000) -> DataFrame:
    """(id, root) with the smallest id of each component: a vertex and its root both take the least root beside the vertex, then roots jump to their roots; checkpointed
    per round. As whole trees of roots are hung onto others, the rounds grow with the logarithm of a component's size, not with its diameter."""
    e = edges.select(c("a").alias("s"), c("b").alias("t")).unionByName(edges.select(c("b").alias("s"), c("a").alias("t"))).where("s <> t").distinct()
    e = cut_lineage(e)
    lab = cut_lineage(vertices.select("id", c("id").alias("root")))
    for _ in range(max_iter):
        low = e.join(lab, c("t") == c("id")).groupBy("s").agg(F.min("root").alias("m"))
        near = cut_lineage(lab.join(low, c("id") == c("s"), "left").select("id", "root", "m"))
        hung = near.select("id", F.least("root", "m").alias("root")).unionByName(near.where("m < root").select(c("root").alias("id"), c("m").alias("root")))
        step = cut_lineage(hung.groupBy("id").agg(F.min("root").alias("root")))
        jump = step.where("id <> root").select(c("id").alias("_p"), c("root").alias("_r"))
        new = cut_lineage(step.join(jump, c("root") == c("_p"), "left").select("id", F.least("root", "_r").alias("root")))
        moved = new.join(lab.select(c("id").alias("_i"), c("root").alias("_o")), c("id") == c("_i")).where(c("root") != c("_o")).limit(1).count()
        lab = new
        if not moved:
            return lab
    raise RuntimeError(f"components still moving after {max_iter} rounds")


def graph_connectivity(df: DataFrame, key: str, vector: str, label: str, k: int = 15, exact: bool = False) -> DataFrame:
    """Mean over labels of the largest connected share of the label's own kNN graph."""
    lab = df.where(c(label).isNotNull()).select(c(key).cast("long").alias("id"), c(label).cast("string").alias("l"))
    n = neighbours(df, key, vector, k, exact)
    l2 = lab.select(c("id").alias("_j"), c("l").alias("_m"))
    same = n.join(lab, c("qid") == c("id")).join(l2, c("did") == c("_j")).where(c("l") == c("_m")).select(c("qid").alias("a"), c("did").alias("b"))
    roots = connected_components(lab.select("id"), same)
    size = lab.join(roots, "id").groupBy("l", "root").agg(F.count(F.lit(1)).alias("n"))
    per = size.groupBy("l").agg((F.max("n") / F.sum("n")).alias("share"))
    return per.agg(F.avg("share").alias("connectivity"), F.count(F.lit(1)).alias("labels"))
