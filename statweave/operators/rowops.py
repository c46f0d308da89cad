"""Row filters, exclusions, outlying points, and replay of recorded operations."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType


from statweave.operators import labels, missing
from statweave.plans.common import beside, num, ratio
from statweave.plans.cumulate import quantiles

c = F.col
EXCLUDE_RED = 0.10


def _cond(expr: str | Column) -> Column:
    """A condition where "unknown" counts as false, for keep and for drop alike."""
    return F.coalesce(F.expr(expr) if isinstance(expr, str) else expr, F.lit(False))


def filter_rows(df: DataFrame, expr: str | Column, mode: str = "keep") -> DataFrame:
    return df.where(_cond(expr) if mode == "keep" else ~_cond(expr))


def filter_preview(df: DataFrame, expr: str | Column, mode: str = "keep") -> DataFrame:
    hit = _cond(expr) if mode == "keep" else ~_cond(expr)
    kept = F.sum(hit.cast("long"))
    s = df.agg(kept.alias("kept"), F.count(F.lit(1)).alias("total"))
    return s.select("kept", (c("total") - c("kept")).alias("removed"), "total", ratio(c("total") - c("kept"), c("total")).alias("ratio"))


def exclude_rows(df: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """Drop rows whose key is listed in ``excluded`` (key, note)."""
    e = excluded.select(c("key").cast("string").alias("_k"))
    return df.join(e, c(key).cast("string") == c("_k"), "left_anti")


def exclusion_status(df: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """How much was left out; more than a tenth is red."""
    e = excluded.select(c("key").cast("string").alias("_k")).distinct()
    hit = df.join(e, c(key).cast("string") == c("_k"), "left").agg(
        F.count("_k").alias("n_excluded"), F.count(F.lit(1)).alias("n_total"))
    share = ratio(c("n_excluded"), c("n_total"))
    return hit.select("n_excluded", "n_total", share.alias("ratio"),
                      F.when(share > EXCLUDE_RED, "red").when(c("n_excluded") > 0, "yellow").otherwise("green").alias("verdict"))


def both_ways(df: DataFrame, spec, test_id: str, key: str, excluded: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The same test with and without the excluded rows; ``flips`` when significance changes."""
    from statweave.operators.run import RUNNERS
    full = RUNNERS[test_id](df, spec, []).withColumn("rows_used", F.lit("all"))
    part = RUNNERS[test_id](exclude_rows(df, key, excluded), spec, []).withColumn("rows_used", F.lit("after exclusion"))
    both = full.unionByName(part)
    w = Window.partitionBy("test_id")
    return both.withColumn("flips", F.max(c("p") < alpha).over(w) != F.min(c("p") < alpha).over(w))


def outlying_points(df: DataFrame, y: str, key: str, group: str | None = None, top: int = 8) -> DataFrame:
    """Rows beyond the 1.5 IQR fences (inside each level when ``group`` is a category), farthest
    first.  Only fence-crossers reach the ranking window."""
    by = [group] if group and not isinstance(df.schema[group].dataType, NumericType) else []
    src = df.select(c(key).alias("key"), *( [c(group).alias("x")] if group else []), num(y).alias("y")).where("y is not null")
    keys = ["x"] if by else []
    if group:
        src = src.where("x is not null")
    q = quantiles(src, "y", [0.25, 0.75], keys)
    iqr = c("q1") - c("q0")
    q = q.where((c("n") >= 4) & (iqr > 0)).select(*keys, (c("q0") - 1.5 * iqr).alias("fence_low"), (c("q1") + 1.5 * iqr).alias("fence_high"))
    if keys:
        j = beside(src, q, keys)
    else:
        j = src.withColumns({"fence_low": q.select("fence_low").scalar(), "fence_high": q.select("fence_high").scalar()})
    far = F.greatest(c("fence_low") - c("y"), c("y") - c("fence_high"))
    out = j.where((c("y") < c("fence_low")) | (c("y") > c("fence_high"))).withColumn("distance", far)
    if not keys:
        ranked = out.orderBy(c("distance").desc(), "key").limit(top)
        return ranked.withColumn("side", F.when(c("y") < c("fence_low"), "low").otherwise("high"))
    w = Window.partitionBy(*keys).orderBy(c("distance").desc(), "key")
    return out.withColumn("_r", F.row_number().over(w)).where(c("_r") <= top).drop("_r") \
              .withColumn("side", F.when(c("y") < c("fence_low"), "low").otherwise("high"))


def points(df: DataFrame, y: str, key: str, group: str | None = None, by: str | None = None) -> DataFrame:
    """The rows a plot would show: key, x, y and stratum of complete rows."""
    cols = [c(key).cast("string").alias("key"), *([c(group).alias("x")] if group else []), num(y).alias("y"),
            *([c(by).cast("string").alias("stratum")] if by else [])]
    return df.select(*cols).dropna(subset=["y", *(["x"] if group else [])])


# ------------------------------------------------------------------ recorded operations, in recorded order
def apply_ops(df: DataFrame, ops: Sequence[dict]) -> DataFrame:
    """Fold a list of operations over one lazy plan.  Each op is a dict with ``op`` and its
    arguments; order of recording is order of effect.  A later ``include_row`` takes its keys out
    of the exclusions recorded before it."""
    steps: list[dict] = []
    for op in ops:
        if op["op"] == "include_row":
            back = {str(k) for k in op["keys"]}
            steps = [s if s["op"] != "exclude_row" or s["key"] != op["key"]
                     else {**s, "keys": [k for k in s["keys"] if str(k) not in back]} for s in steps]
        elif op["op"] != "exclude_row" or op.get("note", "").strip():
            steps.append(op)
        else:
            raise ValueError("an exclusion needs a reason (note)")
    for op in steps:
        df = _STEPS[op["op"]](df, op)
    return df


def _local(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _impute(df, o):
    return missing.impute(df, o["method"], o["columns"], o.get("group_by"), o.get("key"))


def _relabel(df, o):
    edits = _local(df, [(str(k), None if v is None else str(v), o.get("note", "")) for k, v in o["values"].items()],
                   "key string, value string, note string")
    return labels.relabel(df, o["key"], o["column"], edits)


def _derive(df, o):
    f = o["formula"]
    if callable(f):
        out = f(df)
        return out if isinstance(out, DataFrame) else df.withColumn(o["name"], out)
    return df.withColumn(o["name"], F.expr(f) if isinstance(f, str) else f)


def _net_exclusions(df, o):
    e = _local(df, [(str(k), o.get("note", "")) for k in o["keys"]], "key string, note string")
    return exclude_rows(df, o["key"], e)


_STEPS = {
    "select": lambda df, o: df.select(*o["columns"]),
    "deselect": lambda df, o: df.drop(*o["columns"]),
    "hold": lambda df, o: _hold(df, o["columns"], True),
    "unhold": lambda df, o: _hold(df, o["columns"], False),
    "derive": _derive,
    "derive_drop": lambda df, o: df.drop(o["name"]),
    "replace": lambda df, o: df.withColumn(o["column"], F.expr(o["formula"]) if isinstance(o["formula"], str) else o["formula"]),
    "filter_rows": lambda df, o: filter_rows(df, o["expr"], o.get("mode", "keep")),
    "missing_drop": lambda df, o: missing.drop_na(df, o.get("columns"), o.get("how", "row")),
    "impute": _impute,
    "exclude_row": _net_exclusions,
    "relabel": _relabel,
    "label_map": lambda df, o: labels.apply_label_maps(df, {o["column"]: o["map"]}),
    "semantic_confirm": lambda df, o: _mark(df, o["column"], "semantic_type", o["type"]),
    "semantic_unconfirm": lambda df, o: _mark(df, o["column"], "semantic_type", None),
    "group_confirm": lambda df, o: _mark(df, o["column"], "group_kind", o["kind"]),
}


def _mark(df: DataFrame, col: str, key: str, value) -> DataFrame:
    meta = dict(df.schema[col].metadata or {})
    meta.pop(key, None) if value is None else meta.update({key: value})
    return df.withMetadata(col, meta)


def _hold(df: DataFrame, columns: Sequence[str], on: bool) -> DataFrame:
    for col in columns:
        df = _mark(df, col, "held", True if on else None)
    return df


def analysis_columns(df: DataFrame) -> list[str]:
    """Selected columns that are not held back from analysis."""
    return [f.name for f in df.schema if not (f.metadata or {}).get("held")]


def semantic_type_of(df: DataFrame, col: str) -> str | None:
    return (df.schema[col].metadata or {}).get("semantic_type")
