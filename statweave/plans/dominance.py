"""Pair statistics over (x, y) in N log N: concordance, sums over ordered pairs, |dx||dy|.

Each row's dense x rank is read as a path of digits of up to BITS bits.  Two rows with different
x part at exactly one level: there they are different children of one node.  So a row moves once
per level (one up to 2 ** BITS distinct x, two up to 2 ** (2 * BITS)), sorted by y inside its
node, and each task sweeps its nodes upwards in y with one running sum per child.  Nodes of many
rows are cut into buckets of y; pairs across buckets meet in the sums per (bucket, child).  No
pair is ever materialised, and no node has to fit in one task.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from statweave.plans.common import cut_lineage
from statweave.plans.cumulate import add_bucket, cumulate, rows_per_bucket, value_cuts

#: Bits of the x rank that one level tells apart.
BITS = 13
#: Rows of a sweep that meet each other directly.
STEP = 256
#: Tables of at most this many distinct values are broadcast.
FEW = 100_000


class _Sweep:
    """Sums over pairs of one node at a time, rows arriving upwards in (y, child): running sums of the left weights per child, those at the latest y apart."""

    def __init__(self, left: int, right: int, children: int):
        self.below, self.tie = np.zeros((left, right)), np.zeros((left, right))
        self.low, self.top, self.y = np.zeros((left, children)), np.zeros((left, children)), -np.inf

    def add(self, node: np.ndarray, y: np.ndarray, child: np.ndarray, left: np.ndarray, right: np.ndarray, opened: bool) -> None:
        """A block of rows; ``node`` numbers their nodes in order, and ``opened`` says that the first of them goes on from the block before."""
        last = int(np.searchsorted(node, node[-1]))                          # first row of the block's last node
        if opened:
            head = int(np.searchsorted(node, node[0], side="right"))
            at, up = child[:head], y[:head] > self.y
            under = [(np.cumsum(s, axis=1) - s)[:, at] for s in (self.low, self.top)]
            self.below += (under[0] + under[1] * up) @ right[:, :head].T
            self.tie += (under[1] * ~up) @ right[:, :head].T
        met = (child[:, None] < child) & (node[:, None] == node)
        self.below += left @ (met & (y[:, None] < y)) @ right.T
        self.tie += left @ (met & (y[:, None] == y)) @ right.T
        if not opened or last:
            self.low[:], self.top[:], self.y = 0, 0, -np.inf
        if y[-1] != self.y:
            self.low += self.top
            self.top[:], self.y = 0, y[-1]
        new = last + int(np.searchsorted(y[last:], y[-1]))                   # first row at the latest y
        for k in range(len(left)):
            self.low[k] += np.bincount(child[last:new], left[k, last:new], self.low.shape[1])
            self.top[k] += np.bincount(child[new:], left[k, new:], self.low.shape[1])


def _changes(columns: Sequence[pa.Array], before: Sequence[pa.Array] | None) -> np.ndarray:
    """Whether each row differs from the row before it in any column (nulls alike); ``before`` holds the row before the first."""
    out = np.zeros(len(columns[0]), bool)
    out[0] = before is None
    for k, col in enumerate(columns):
        codes = pa.concat_arrays([col.slice(0, 1) if before is None else before[k], col]).dictionary_encode("encode").indices.to_numpy()
        out |= codes[1:] != codes[:-1]
    return out


def pair_sums(df: DataFrame, x: str, y: str, weights: dict[str, Column], left: Sequence[str], right: Sequence[str],
              by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Per stratum, for each l in ``left`` and r in ``right``: sums of l(i) * r(j) over all pairs with x_i < x_j and y_i < y_j
    (``below_l_r``), y_i = y_j (``tie_l_r``) or any y (``all_l_r``).  ``weights`` are columns over x, y and n, the number of equal
    rows; ``count`` names a column that tells it: such rows are not counted again."""
    by, weights = list(by), {f"_w_{k}": w.cast("double") for k, w in weights.items()}
    pairs = [(l, r) for l in left for r in right]
    below, tie, every = ([f"{w}_{l}_{r}" for l, r in pairs] for w in ("below", "tie", "all"))
    pts = (df.select(*by, (F.col(x).cast("double") + F.lit(0.0)).alias("x"), (F.col(y).cast("double") + F.lit(0.0)).alias("y"),
                     (F.col(count) if count else F.lit(1)).cast("long").alias("n"))
             .where("x is not null and y is not null"))
    if not count:
        pts = cut_lineage(pts.groupBy(*by, "x", "y").agg(F.sum("n").alias("n")))
    axis = cut_lineage(cumulate(pts, "x", {"one": F.max(F.lit(1)), "rows": F.count(F.lit(1)), **{k: F.sum(w) for k, w in weights.items()}}, by))
    top, values = axis.agg(F.max("tot_one"), F.count(F.lit(1))).first()
    depth = max(1, int((top or 1) - 1).bit_length())
    levels = -(-depth // BITS)
    bits = -(-depth // levels)

    def places(r: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(v).alias("lvl"), F.expr(f"shiftright({r}, {(v + 1) * bits})").alias("node"),
                                            F.expr(f"cast(shiftright({r}, {v * bits}) & {(1 << bits) - 1} as int)").alias("child")) for v in range(levels)])).alias("_p")

    ranks = axis.select(*[F.col(c).alias(f"_a_{c}") for c in by], F.col("x").alias("_ax"), F.col("cum_one").cast("long").alias("_r"))
    cond = [pts[c].eqNullSafe(ranks[f"_a_{c}"]) for c in by] + [pts["x"] == ranks["_ax"]]
    ranked = pts.join(F.broadcast(ranks) if values <= FEW else ranks, cond)
    cuts = value_cuts(pts, "y")
    node = [*by, "lvl", "node"]
    leaf = add_bucket(ranked, "y", cuts).select(*by, places("_r"), F.col("_bucket").cast("int").alias("_b"), "y", *[w.alias(k) for k, w in weights.items()])
    leaf = leaf.select(*by, "_p.*", "_b", "y", *weights)
    if cuts:
        large = (axis.select(*by, "rows", F.col("cum_one").cast("long").alias("_r")).select(*by, "rows", places("_r")).select(*by, "rows", "_p.*")
                 .groupBy(*node).agg(F.sum("rows").alias("_n")).where(F.col("_n") > rows_per_bucket(df)))
        large = F.broadcast(large.select(*[F.col(c).alias(f"_l_{c}") for c in node], F.lit(True).alias("_large")))       # at most a row per level and bucket
        leaf = leaf.join(large, [leaf[c].eqNullSafe(large[f"_l_{c}"]) for c in node], "left")
        across = (leaf.where("_large").groupBy(*node, "child", "_b").agg(*[F.sum(k).alias(k) for k in weights])
                  .select(*by, (-1 - F.col("lvl")).alias("lvl"), "node", "child", F.lit(0).alias("_b"), F.col("_b").cast("double").alias("y"), *weights))
        leaf = leaf.select(*by, "lvl", "node", "child", F.when(F.col("_large"), F.col("_b")).otherwise(0).alias("_b"), "y", *weights).unionByName(across)
    key, names, firsts = [*node, "_b"], [*weights], len(by) + 1
    at_left, at_right = ([names.index(f"_w_{k}") for k in side] for side in (left, right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = open_ = sweep = None
        done: list[tuple] = []

        def out(schema: pa.Schema) -> pa.RecordBatch:
            cols = [pa.array([d[0][k] for d in done], schema.field(k).type) for k in range(firsts)]
            flat = np.array([d[1] for d in done])
            got = pa.RecordBatch.from_arrays([*cols, *[pa.array(v) for v in flat.T]], [*schema.names[:firsts], *below, *tie])
            done.clear()
            return got

        def close() -> None:
            done.append((open_, np.concatenate([sweep.below.ravel(), sweep.tie.ravel()])))

        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema, keys = batch.schema, batch.columns[:len(key)]
            new = _changes(keys[:firsts], before and before[:firsts])                    # another stratum or level
            moved = _changes(keys, before)
            nodes = np.cumsum(moved)
            ys, child = (batch.column(k).to_numpy() for k in ("y", "child"))
            values = np.array([batch.column(k).to_numpy() for k in names])
            lefts, rights = values[at_left], values[at_right]
            ends = [*np.flatnonzero(new), len(ys)]
            for a, b in zip([0, *ends], ends):
                if a < b and new[a]:
                    if sweep:
                        close()
                    sweep, open_ = _Sweep(len(at_left), len(at_right), 1 << bits), [batch.column(k)[int(a)].as_py() for k in range(firsts)]
                for s in range(a, b, STEP):
                    e = min(s + STEP, b)
                    sweep.add(nodes[s:e], ys[s:e], child[s:e], lefts[:, s:e], rights[:, s:e], not moved[s])
            before = [k.slice(len(k) - 1) for k in keys]
            if len(done) >= 10_000:
                yield out(schema)
        if sweep:
            close()
            yield out(schema)

    spread = leaf.select(*key, "y", "child", *weights).repartition(*key).sortWithinPartitions(*key, "y", "child")
    shape = StructType(spread.schema.fields[:firsts])
    for name in (*below, *tie):
        shape = shape.add(name, DoubleType())
    zero = F.lit(0.0)
    parts = spread.mapInArrow(run, shape).select(*by, *below, *[F.when(F.col("lvl") >= 0, F.col(k)).otherwise(zero).alias(k) for k in tie], *[zero.alias(k) for k in every])
    whole = axis.groupBy(*by).agg(*[F.sum(F.col(f"_w_{r}") * F.col(f"cum__w_{l}")).alias(k) for (l, r), k in zip(pairs, every)])
    whole = whole.select(*by, *[zero.alias(k) for k in (*below, *tie)], *every)
    return parts.unionByName(whole).groupBy(*by).agg(*[F.sum(k).alias(k) for k in (*below, *tie, *every)])


def concordance(df: DataFrame, x: str, y: str, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Per stratum: con, dis = pairs ordered alike / unlike (pairs tied in x or y excluded)."""
    s = pair_sums(df, x, y, {"n": F.col("n")}, ["n"], ["n"], by, count)
    return s.select(*by, F.coalesce("below_n_n", F.lit(0.0)).alias("con"), F.coalesce(F.col("all_n_n") - F.col("below_n_n") - F.col("tie_n_n"), F.lit(0.0)).alias("dis"))
