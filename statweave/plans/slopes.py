"""Order statistics of all pairwise slopes (dy / dx over pairs with dx > 0) without listing them, and how many slopes lie above a number.

Randomised selection: a rank is enclosed in a bracket of slopes; pairs whose slope lies in the bracket (lo, hi] are exactly those that the residuals at lo and at hi order
differently. Each round draws slopes from the bracket, narrows it around the rank and counts the slopes up to its ends; what is left in the end is listed and read off exactly.
The rule is one at every size; small tables are listed at once.

Points are laid out once in chunks by x. Slopes above s are pairs in the order of x whose residuals y - s x ascend: a chunk counts its own, and only its residuals move, to buckets
of residuals, for those across chunks. Within a bracket every residual stays in an interval, and pairs that change order have intervals that meet. So the points are dealt once more
to buckets by these intervals (a strip), and whatever is counted, drawn or listed inside the bracket, or a narrower one, is local to a bucket; nothing moves again. Brackets without
an end go through a rank tree of all points instead."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from statweave.plans.common import cut_lineage, shuffle_partitions
from statweave.plans.cumulate import GRID, cumulate, rows_per_bucket

c = F.col
#: Ends of a bracket lie this far (relative to the slopes) outside those that they come from: residuals are rounded, and equal slopes stay together.
TOLERANCE = 1e-9
#: Points of a chunk and of a bucket of a strip, and the most chunks there are (beyond, they grow; the driver sees a number per chunk and bucket of residuals).
CHUNK, STRIP, CHUNKS = 1 << 18, 1 << 20, 1024
#: A strip with a bucket of more points than this (very many lines through one point) is not used.
CROWDED = 1 << 23
PACKED = "part int, x binary, y binary, n binary"


# ------------------------------------------------------------------ pairs in one task
def _parted(rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per binary digit of the ranks, highest first: (order, start, one): positions by node, in their own order inside; the first place of each one's node; whether it goes right.
    Two positions with different ranks are in one node and part at exactly one digit."""
    at = np.arange(len(rank), dtype=np.int32)                      # a task holds fewer than 2^31 points
    order, rank = at, rank.astype(np.int32)
    for level in reversed(range(int(rank.max(initial=0)).bit_length())):
        one = (rank >> level & 1).astype(bool)
        fresh = np.empty(len(rank), bool)
        fresh[:1] = True
        np.not_equal(rank[1:] >> (level + 1), rank[:-1] >> (level + 1), out=fresh[1:])
        first = np.flatnonzero(fresh).astype(np.int32)
        many = np.diff(first, append=np.int32(len(rank)))
        start = np.repeat(first, many)
        yield order, start, one
        zeros = np.zeros(len(rank) + 1, np.int32)
        np.cumsum(~one, out=zeros[1:])
        before = zeros[:-1] - np.repeat(zeros[first], many)                                 # zeros before it in its node
        here = np.repeat(np.diff(zeros[first], append=zeros[-1]), many)
        place = np.where(one, at + here - before, start + before)
        moved, ranks = np.empty_like(order), np.empty_like(rank)
        moved[place], ranks[place] = order, rank
        order, rank = moved, ranks


def _ranks(v: np.ndarray) -> np.ndarray:
    return np.unique(v, return_inverse=True)[1]


def _ascending(rank: np.ndarray, w: np.ndarray) -> int:
    """The sum of w[i] w[j] over i < j with rank[i] < rank[j]."""
    out = 0
    for order, start, one in _parted(rank):
        right = np.flatnonzero(one)
        weight, low = w[order], np.zeros(len(w) + 1, np.int64)
        np.cumsum(weight * ~one, out=low[1:])
        out += int((weight[right] * (low[right] - low[start[right]])).sum())
    return out


def _ascending_pairs(rank: np.ndarray, w: np.ndarray, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, weight): the pairs that `_ascending` counts, all of them with their weights at rate 1, else as many draws as the rate gives them, each with weight 1."""
    got = [(np.zeros(0, np.int64),) * 3]
    for order, start, one in _parted(rank):
        at, right = np.flatnonzero(~one), np.flatnonzero(one)
        seen = np.r_[0, np.cumsum(~one)]                                                    # zeros before a place: indices into `at`
        if rate >= 1:
            many = seen[right] - seen[start[right]]
            j = np.repeat(right, many)
            i = at[np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(seen[start[right]], many)]
            got.append((order[i], order[j], w[order[i]] * w[order[j]]))
            continue
        low = np.r_[0, np.cumsum(w[order[at]])]                                             # weights of the zeros
        below = low[seen[start[right]]]
        left = low[seen[right]] - below
        want = rate * w[order[right]] * left
        draws = np.floor(want).astype(np.int64) + (rng.random(len(want)) < want % 1)
        j = np.repeat(np.arange(len(right)), draws)
        place = below[j] + np.minimum((rng.random(len(j)) * left[j]).astype(np.int64), left[j] - 1)
        i = at[np.searchsorted(low, place, side="right") - 1]
        got.append((order[i], order[right[j]], np.ones(len(j), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*got))


def _turned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of points with residuals a at the lower end, which ascend, and b at the upper one: i before j in the order and rank[i] < rank[j] means that i is below j at the
    lower end and not below it at the upper."""
    order, rank = np.arange(len(a)), np.empty(len(a), np.int64)
    if (a[1:] == a[:-1]).any():
        order = np.lexsort((b, a))
        last = np.lexsort((-a[order], b[order]))
    else:
        last = len(a) - 1 - np.argsort(b[::-1], kind="stable")
    rank[last] = np.arange(len(a) - 1, -1, -1)
    return order, rank


# ------------------------------------------------------------------ points in chunks
def _sorted_once(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points in the order of x, those of one x downwards in y, equal ones together."""
    order = np.lexsort((-y, x))
    x, y, n = x[order], y[order], n[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
    return x[first], y[first], np.add.reduceat(n, first) if len(x) else n


def _columns(batches, most: int | None = None) -> Iterator[list[np.ndarray]]:
    """The numeric columns of the batches, in parts of at least `most` rows, or all at once."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([col.to_numpy() for col in batch.columns])
            rows += batch.num_rows
            if most and rows >= most:
                yield [np.concatenate(col) for col in zip(*held)]
                held, rows = [], 0
    if held:
        yield [np.concatenate(col) for col in zip(*held)]


def _pack(part: int, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": int(part), "x": x.tobytes(), "y": y.tobytes(), "n": b"" if (n == 1).all() else n.tobytes()}],
                                      pa.schema([("part", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("n", pa.binary())]))


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = np.frombuffer(row["x"]), np.frombuffer(row["y"])
    return x, y, np.frombuffer(row["n"], np.int64) if row["n"] else np.ones(len(x), np.int64)


def _rows(batches) -> Iterator[dict]:
    """Packed rows one by one: a batch may hold several."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _chunks(points: DataFrame, rows: int) -> DataFrame:
    """The points (x, y, n) in PACKED rows, a chunk of the order by x (downwards in y where x is equal) each; equal points meet before they move."""
    def once(batches):
        for x, y, n in _columns(batches, CHUNK):
            x, y, n = _sorted_once(x, y, n)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(n)], ["x", "y", "n"])

    def pack(batches):
        for x, y, n in _columns(batches):
            yield _pack(TaskContext.get().partitionId(), *_sorted_once(x, y, n))

    src = points.select((c("x") + F.lit(0.0)).alias("x"), (c("y") + F.lit(0.0)).alias("y"), c("n").cast("long").alias("n")).mapInArrow(once, "x double, y double, n long")
    return src.repartitionByRange(max(1, min(CHUNKS, -(-rows // CHUNK))), c("x"), c("y").desc()).mapInArrow(pack, PACKED)


def _weights(chunks: DataFrame) -> tuple[dict[int, int], int, int]:
    """(points of each chunk, counted as often as they are; pairs of equal x; pairs of equal points)."""
    def look(batches):
        for row in _rows(batches):
            x, y, n = _unpack(row)
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            same = np.add.reduceat(n, first)
            inner = same[1:-1]
            ends = [(float(x[0]), int(same[0])), (float(x[-1]), int(same[-1]) if len(same) > 1 else 0)]
            yield pa.RecordBatch.from_pylist([{"part": row["part"], "n": int(n.sum()), "tied": int((inner * (inner - 1) // 2).sum()), "equal": int((n * (n - 1) // 2).sum()),
                                               "a": ends[0][0], "na": ends[0][1], "b": ends[1][0], "nb": ends[1][1]}])

    found = sorted(chunks.mapInArrow(look, "part long, n long, tied long, equal long, a double, na long, b double, nb long").collect(), key=lambda r: r["part"])
    tied, ends = sum(r["tied"] for r in found), {}
    for r in found:                                                # an x may go over several chunks
        for v, m in ((r["a"], r["na"]), (r["b"], r["nb"])):
            ends[v] = ends.get(v, 0) + m
    return {r["part"]: r["n"] for r in found}, tied + sum(m * (m - 1) // 2 for m in ends.values()), sum(r["equal"] for r in found)


def laid_out(points: DataFrame) -> tuple[DataFrame, int, dict[int, int], int]:
    """(chunks of the points (x, y, n), written once; rows; points of each chunk; pairs of equal x)."""
    rows = points.count()
    chunks = cut_lineage(_chunks(points, rows))
    return chunks, rows, *_weights(chunks)[:2]


def _points_at(chunks: DataFrame, weights: dict[int, int], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the points at these places of the order by x; a bounded number, held whole by every task."""
    start = dict(zip(sorted(weights), np.r_[0, np.cumsum([weights[p] for p in sorted(weights)])].tolist()))
    order = np.argsort(places, kind="stable")
    ordered = places[order]

    def pick(batches):
        for row in _rows(batches):
            x, y, n = _unpack(row)
            low = start[row["part"]]
            a, b = np.searchsorted(ordered, [low, low + int(n.sum())])
            at = np.searchsorted(np.cumsum(n), ordered[a:b] - low, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(x[at]), pa.array(y[at])], ["i", "x", "y"])

    t = chunks.mapInArrow(pick, "i long, x double, y double").toArrow()
    x, y, i = np.empty(len(places)), np.empty(len(places)), order[t.column("i").to_numpy()]
    x[i], y[i] = t.column("x").to_numpy(), t.column("y").to_numpy()
    return x, y


def _drawn_points(chunks: DataFrame, weights: dict[int, int], sample: int, seed: int) -> tuple[np.ndarray, ...]:
    """(xa, ya, xb, yb) of `sample` pairs of places drawn with equal chances and with repeats."""
    places = np.random.default_rng([seed, 77]).integers(0, sum(weights.values()), 2 * sample)
    x, y = _points_at(chunks, weights, places)
    return x[:sample], y[:sample], x[sample:], y[sample:]


def _cuts(x: np.ndarray, y: np.ndarray, slope: float, parts: int) -> np.ndarray:
    """Borders of about equally full buckets of residuals; any give the same answer."""
    return np.unique(np.quantile(y - slope * x, np.arange(1, parts) / parts)) if parts > 1 and len(x) else np.zeros(0)


def slopes_above(chunks: DataFrame, slopes: Sequence[float], cuts: Sequence[np.ndarray]) -> list[int]:
    """How many slopes of the points in these chunks lie above each of the numbers. A residual moves once per number, as 8 bytes."""
    slopes, cuts = [float(s) for s in slopes], [np.asarray(x, dtype=float) for x in cuts]

    def spread(batches):
        for row in _rows(batches):
            x, y, n = _unpack(row)
            for k, s in enumerate(slopes):
                r = y - s * x + 0.0 if s else y                    # x may be infinite where only its order counts
                v, of = np.unique(r, return_inverse=True)
                own = _ascending(of, n)
                w = np.bincount(of, n, len(v)).astype(np.int64)
                ends = np.r_[0, np.searchsorted(v, cuts[k]), len(v)]
                for b in np.flatnonzero(np.diff(ends)):
                    here = slice(ends[b], ends[b + 1])
                    yield pa.RecordBatch.from_pylist([{"k": k, "b": int(b), "part": row["part"], "v": v[here].tobytes(), "w": b"" if (w[here] == 1).all() else w[here].tobytes(),
                                                       "weight": int(w[here].sum()), "own": own}])
                    own = 0

    def across(cell, t):
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        v = [np.frombuffer(r["v"])[::-1] for r in rows]            # downwards in one chunk: no pair of its own ascends
        w = [np.frombuffer(r["w"], np.int64)[::-1] if r["w"] else np.ones(len(x), np.int64) for r, x in zip(rows, v)]
        count = _ascending(_ranks(np.concatenate(v)), np.concatenate(w)) + sum(r["own"] for r in rows)
        return pa.table({"k": [cell[0].as_py()], "b": [cell[1].as_py()], "parts": [[r["part"] for r in rows]], "weights": [[r["weight"] for r in rows]],
                         "count": [count]})

    moved = chunks.mapInArrow(spread, "k long, b long, part long, v binary, w binary, weight long, own long")
    out, cells = [0] * len(slopes), [{} for _ in slopes]
    for r in moved.groupBy("k", "b").applyInArrow(across, "k long, b long, parts array<long>, weights array<long>, count long").collect():
        out[r["k"]] += r["count"]
        cells[r["k"]] |= {(p, r["b"]): m for p, m in zip(r["parts"], r["weights"])}
    for k, cell in enumerate(cells):                               # pairs across chunks and buckets
        if cell:
            grid = np.zeros((max(p for p, _ in cell) + 1, max(b for _, b in cell) + 1), np.int64)
            for at, m in cell.items():
                grid[at] = m
            under = np.cumsum(np.cumsum(grid, axis=0), axis=1)
            out[k] += int((grid[1:, 1:] * under[:-1, :-1]).sum())
    return out


def ascending_pairs(points: DataFrame) -> tuple[int, int]:
    """(pairs of the points (x, y, n) with both x and y ascending, pairs of equal points)."""
    rows = points.count()
    parts = max(1, min(CHUNKS, -(-rows // CHUNK)))
    grid = ",".join(f"{i / parts!r}D" for i in range(1, parts))
    cuts = points.agg(F.expr(f"percentile_approx(y, array({grid}), 10000)")).first()[0] if parts > 1 else []
    chunks = cut_lineage(_chunks(points, rows))
    return slopes_above(chunks, [0.0], [np.unique(cuts)])[0], _weights(chunks)[2]


# ------------------------------------------------------------------ strips
@dataclass
class Strip:
    """The points in buckets (PACKED, sorted by x and y) by the intervals that their residuals cover from slope lo to hi; a point is in every bucket that its interval meets."""
    buckets: DataFrame
    lo: float
    hi: float
    cuts: np.ndarray

    def covers(self, bracket: tuple[float, float]) -> bool:
        return self.lo <= bracket[0] and bracket[1] <= self.hi

    def earlier(self, part: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether a point of this bucket is in the bucket before as well. Pairs of two such points are counted there."""
        return np.searchsorted(self.cuts, np.minimum(y - self.lo * x, y - self.hi * x), side="right") < part

    def without_buckets(self) -> Strip:
        return Strip(None, self.lo, self.hi, self.cuts)


def _strip(chunks: DataFrame, lo: float, hi: float, cuts: np.ndarray) -> Strip | None:
    def spread(batches):
        for row in _rows(batches):
            x, y, n = _unpack(row)
            a, b = y - lo * x, y - hi * x
            first, last = (np.searchsorted(cuts, f(a, b), side="right") for f in (np.minimum, np.maximum))
            many = last - first + 1
            i = np.repeat(np.arange(len(x)), many)
            part = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(len(cuts) + 2))
            for p in np.flatnonzero(np.diff(ends)):
                mine = i[order[ends[p]:ends[p + 1]]]
                yield _pack(p, x[mine], y[mine], n[mine])

    def merge(cell, t):
        x, y, n = (np.concatenate(col) for col in zip(*map(_unpack, t.to_pylist())))
        order = np.lexsort((y, x))
        return pa.Table.from_batches([_pack(cell[0].as_py(), x[order], y[order], n[order])])

    moved = chunks.mapInArrow(spread, PACKED)
    buckets = cut_lineage(moved.groupBy("part").applyInArrow(merge, PACKED))
    most = buckets.agg(F.max(F.octet_length("x"))).first()[0] or 0
    return Strip(buckets, lo, hi, cuts) if most <= 8 * CROWDED else None


def slopes_up_to(strip: Strip, ends: Sequence[float]) -> list[int]:
    """How many slopes lie in (strip.lo, end] for each of these ends inside the strip."""
    ends, of = list(ends), strip.without_buckets()

    def count(batches):
        for row in _rows(batches):
            x, y, n = _unpack(row)
            early = of.earlier(row["part"], x, y)
            up = np.argsort(y - of.lo * x, kind="stable")
            x, y, n, early = x[up], y[up], n[up], early[up]
            for k, e in enumerate(ends):
                order, rank = _turned(y - of.lo * x, y - e * x)
                late = early[order]
                yield pa.RecordBatch.from_pylist([{"k": k, "m": _ascending(rank, n[order]) - (_ascending(_ranks(rank[late]), n[order][late]) if late.any() else 0)}])

    got = strip.buckets.mapInArrow(count, "k long, m long").groupBy("k").agg(F.sum("m").alias("m")).collect()
    found = {r["k"]: r["m"] for r in got}
    return [found.get(k, 0) for k in range(len(ends))]


def _pairs_in_strip(strip: Strip, brackets: dict[int, tuple[float, float]], share: Sequence[float], seed: int) -> DataFrame:
    of = strip.without_buckets()

    def draw(batches):
        for row in _rows(batches):
            x, y, n = _unpack(row)
            early = of.earlier(row["part"], x, y)
            for k, (lo, hi) in brackets.items():
                up = np.argsort(y - lo * x, kind="stable")
                order, rank = _turned((y - lo * x)[up], (y - hi * x)[up])
                order = up[order]
                i, j, w = _ascending_pairs(rank, n[order], share[k], np.random.default_rng([seed, k, row["part"]]))
                i, j = order[i], order[j]
                ok = ~(early[i] & early[j]) & (x[j] > x[i])
                i, j = i[ok], j[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int64)), pa.array((y[j] - y[i]) / (x[j] - x[i])), pa.array(w[ok])], ["k", "slope", "w"])

    return strip.buckets.mapInArrow(draw, "k long, slope double, w long")


def _residuals(points: DataFrame, brackets: Sequence[tuple[float, float]]) -> DataFrame:
    """(k, x, y, n, rl, nh): every point once per bracket with its residual at the lower end and its negated residual at the upper end."""
    def one(lo: float, hi: float, k: int) -> Column:
        rl = c("x") if lo == -math.inf else c("y") - F.lit(lo) * c("x")
        nh = c("x") if hi == math.inf else F.lit(hi) * c("x") - c("y")
        return F.struct(F.lit(k).alias("k"), (rl + F.lit(0.0)).alias("rl"), (nh + F.lit(0.0)).alias("nh"))
    each = F.explode(F.array(*[one(lo, hi, k) for k, (lo, hi) in enumerate(brackets)])).alias("r")
    return points.select("x", "y", "n", each).select(c("r.k").alias("k"), "x", "y", "n", c("r.rl").alias("rl"), c("r.nh").alias("nh"))


def _pairs_in_tree(points: DataFrame, brackets: Sequence[tuple[float, float]], share: Sequence[float], total: int, seed: int) -> DataFrame:
    """`pairs_in_brackets` for any bracket, drawn by the hashes of places. w counts equal points on the right.

    Pairs (i, j) in (lo, hi] have rl_i < rl_j and nh_i <= nh_j with nh = -residual at hi. Points get a unique number q in the order of (nh, x), ranks of rl form a binary tree, and at
    the level where i and j part, i is among the first left points below j in q: the number of j's partners and each partner's place are running counts."""
    few = [] if total * len(brackets) <= rows_per_bucket(points) else None
    pts = cut_lineage(_residuals(points, brackets).groupBy("k", "rl", "nh", "x").agg(F.min("y").alias("y"), F.sum("n").alias("n")))
    low = cumulate(pts, "rl", {"one": F.max(F.lit(1))}, ["k"], cuts=few)
    depth = max(1, int((low.agg(F.max("tot_one")).first()[0] or 1) - 1).bit_length())
    outer = cumulate(pts, "nh", {"one": F.count(F.lit(1))}, ["k"], cuts=few).select("k", "nh", c("cum_one").alias("_o"))
    inner = cumulate(pts, "x", {"one": F.count(F.lit(1))}, ["k", "nh"], cuts=few).select("k", "nh", "x", c("cum_one").alias("_i"))
    numbered = cut_lineage(pts.join(low.select("k", "rl", c("cum_one").cast("long").alias("_r")), ["k", "rl"]).join(outer, ["k", "nh"]).join(inner, ["k", "nh", "x"])
                           .select("k", "x", "y", "n", "_r", (c("_o") + c("_i")).cast("double").alias("q")).repartition(shuffle_partitions(points), "k", "q"))
    leaf = numbered.select("k", "q", "n", "_r", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("lvl")).select(
        "k", "q", "n", "lvl", F.expr("shiftright(_r, lvl + 1)").alias("node"), (F.expr("shiftright(_r, lvl) & 1") == 1).alias("right"))
    node = ["k", "lvl", "node"]
    cuts = [] if few is not None else [float(q) for q in range(rows_per_bucket(points), total, max(rows_per_bucket(points), -(-total // GRID)))]      # q runs from 0 without gaps
    run = cumulate(leaf, "q", {"l": F.sum(F.when(~c("right"), c("n")).otherwise(0)), "r": F.sum(F.when(c("right"), c("n")).otherwise(0))}, node, cuts=cuts)
    run = cut_lineage(run.where("l > 0 or r > 0 and cum_l > 0").select(*node, "q", "l", "r", "cum_l"))      # read three times below
    rate = F.element_at(F.array(*[F.lit(float(s)) for s in share]), c("k") + 1)
    u = lambda *what: F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 53)) / float(1 << 53)
    want = rate * c("r") * c("cum_l")
    draws = (F.floor(want) + (u("k", "lvl", "node", "q") < want - F.floor(want)).cast("long")).cast("int")
    ask = run.where("r > 0 and cum_l > 0").select(*node, c("q").alias("qr"), "cum_l", "r", rate.alias("rate"), draws.alias("draws"))
    whole = ask.where("rate >= 1").select(*node, "qr", c("r").alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), c("cum_l") - 1)).alias("place"))
    drawn = ask.where("rate < 1 and draws > 0").select(*node, "qr", "cum_l", F.explode(F.sequence(F.lit(1), c("draws"))).alias("d")).select(
        *node, "qr", F.lit(1).cast("long").alias("w"), F.floor(u("k", "lvl", "node", "qr", "d", F.lit("place")) * c("cum_l")).alias("place"))
    left = run.where("l > 0").select(*node, c("q").alias("ql"), F.explode(F.sequence(c("cum_l"), c("cum_l") + c("l") - 1)).alias("place"))
    met = whole.unionByName(drawn).join(left, [*node, "place"]).select("k", "ql", "qr", "w")
    at = lambda s: numbered.select("k", c("q").alias(f"q{s}"), c("x").alias(f"x{s}"), c("y").alias(f"y{s}"))
    both = met.join(at("l"), ["k", "ql"]).join(at("r"), ["k", "qr"])
    return both.where("xr > xl").select("k", ((c("yr") - c("yl")) / (c("xr") - c("xl"))).alias("slope"), "w")


def pairs_in_brackets(points: DataFrame, brackets: Sequence[tuple[float, float]], share: Sequence[float], total: int, seed: int = 0, strips: Sequence[Strip] = ()) -> DataFrame:
    """(k, slope, w): slopes in bracket k, all of them where its share is 1, else about that share, drawn at random. w counts equal pairs. Brackets inside a strip are read from it,
    others go through a tree of all points."""
    out, rest = None, dict(enumerate(brackets))
    for strip in strips:
        mine = {k: b for k, b in rest.items() if strip.covers(b)}
        if mine:
            got = _pairs_in_strip(strip, mine, share, seed)
            out = got if out is None else out.unionByName(got)
            rest = {k: b for k, b in rest.items() if k not in mine}
    if rest:
        ks = list(rest)
        tree = _pairs_in_tree(points, [rest[k] for k in ks], [share[k] for k in ks], total, seed)
        tree = tree.select(F.element_at(F.array(*[F.lit(k).cast("long") for k in ks]), c("k") + 1).alias("k"), "slope", c("w").cast("long").alias("w"))
        out = tree if out is None else out.unionByName(tree)
    return out


def _read_ranks(lists: DataFrame, brackets: dict[int, tuple[float, float]], seek: dict[int, tuple[int, int]], listed: int) -> dict[int, float]:
    """name -> the slope at a place (k, t) of the listed slopes (k, slope, w); where rounding leaves a place beside its bracket, the nearest one.

    Counts in equal parts of a bracket tell the part that holds a place, and the slopes of that part alone are ordered; a bracket without an end has no parts, its slopes are ordered as they are."""
    parts, out = 4096, {}
    open_ = {k for k, b in brackets.items() if not all(map(math.isfinite, b))}
    if open_:
        run = cumulate(lists.where(c("k").isin(sorted(open_))), "slope", {"m": F.sum("w")}, ["k"], cuts=[] if listed <= rows_per_bucket(lists) else None)
        at_most = lambda t: F.greatest(F.lit(0), F.least(t, c("tot_m") - 1))
        hit = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).cast("long").alias("r"), F.lit(t).cast("long").alias("t")) for r, (k, t) in seek.items() if k in open_]),
                       lambda s: (s["k"] == c("k")) & (c("cum_m") <= at_most(s["t"])) & (at_most(s["t"]) < c("cum_m") + c("m")))
        out = {row["r"]: row["slope"] for row in run.select("slope", F.explode(hit).alias("s")).select("slope", "s.r").collect()}
    seek = {r: at for r, at in seek.items() if at[0] not in open_}
    if seek:
        ends = {k: brackets[k] for k, _ in seek.values()}
        part = F.coalesce(*[F.when(c("k") == k, F.floor((c("slope") - F.lit(lo)) / F.lit(max(hi - lo, 5e-324)) * parts)) for k, (lo, hi) in ends.items()])
        lists = lists.withColumn("part", F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1)).cast("int"))
        count = {k: np.zeros(parts, np.int64) for k in ends}
        for row in lists.groupBy("k", "part").agg(F.sum("w").alias("w")).where("part is not null").collect():
            count[row["k"]][row["part"]] = row["w"]
        want = {}
        for r, (k, t) in seek.items():
            below = np.cumsum(count[k])
            if below[-1]:
                t = min(max(t, 0), int(below[-1]) - 1)
                p = int(np.searchsorted(below, t, side="right"))
                want[r] = (k, p, t - int(below[p] - count[k][p]))
        inside = F.lit(False)
        for k, p, _ in set(want.values()):
            inside = inside | ((c("k") == k) & (c("part") == p))
        t = lists.where(inside).groupBy("k", "part", "slope").agg(F.sum("w").alias("w")).toArrow()
        ks, ps, slope, w = (t.column(n).to_numpy() for n in ("k", "part", "slope", "w"))
        for r, (k, p, at) in want.items():
            mine = (ks == k) & (ps == p)
            order = np.argsort(slope[mine], kind="stable")
            out[r] = float(slope[mine][order][np.searchsorted(np.cumsum(w[mine][order]), at, side="right")])
    return out


def drawn_pairs(points: DataFrame, sample: int, seed: int = 0) -> DataFrame:
    """slope: of about `sample` pairs with dx <> 0, drawn with equal chances and with repeats from all pairs of the points (x, y, n), without a tree."""
    chunks, _, weights, _ = laid_out(points)
    xa, ya, xb, yb = _drawn_points(chunks, weights, sample, seed)
    ok = xa != xb
    return points.sparkSession.createDataFrame(pa.table({"slope": (yb - ya)[ok] / (xb - xa)[ok]}))


def slope_order_statistics(points: DataFrame, ranks: Sequence[int], pairs: int, sample: int = 100_000, listed: int = 2_000_000, seed: int = 0) -> list[float]:
    """The slopes at these ranks (from 0) among `pairs` slopes of the points (x, y, n: doubles, centred, and how often), exact up to the rounding of residuals.

    `sample` slopes of a bracket reach the driver per round; a bracket of at most `listed` slopes is listed and ordered in Spark."""
    chunks, rows, weights, _ = laid_out(points)
    return slopes_of_chunks(points, chunks, weights, rows, ranks, pairs, sample, listed, seed)


def slopes_of_chunks(points: DataFrame, chunks: DataFrame, weights: dict[int, int], total: int, ranks: Sequence[int], pairs: int, sample: int, listed: int, seed: int) -> list[float]:
    """`slope_order_statistics` of points that are laid out already."""
    bracket: dict[int, tuple[float, float]] = {r: (-math.inf, math.inf) for r in ranks}
    above = {-math.inf: pairs, math.inf: 0}                        # slopes above an end
    done: dict[int, float] = {}
    equal: dict[int, tuple[tuple[float, float], float]] = {}       # brackets around one slope that very many pairs have
    strips: list[Strip] = []
    some_x = some_y = np.zeros(0)                                  # points drawn, which tell where to cut residuals

    def cuts(slope: float, size: int) -> np.ndarray:
        return _cuts(some_x, some_y, slope, max(1, min(CHUNKS, -(-total // size))))

    def count_ends() -> None:
        """`above` for all ends of the brackets: globally for one end of every new strip and for ends that none covers, in the strips for the others."""
        todo = sorted({b for b in bracket.values() if not any(s.covers(b) for s in strips) and all(map(math.isfinite, b))})
        spans: list[tuple[float, float]] = []
        for lo, hi in todo:
            spans = [*spans[:-1], (spans[-1][0], max(hi, spans[-1][1]))] if spans and lo <= spans[-1][1] else [*spans, (lo, hi)]
        new = [s for s in (_strip(chunks, lo, hi, cuts((lo + hi) / 2, STRIP)) for lo, hi in spans) if s]
        strips.extend(new)
        ends = {e for b in bracket.values() for e in b if e not in above}
        inside = {s.lo: sorted(e for e in ends if s.lo < e <= s.hi) for s in strips}
        alone = sorted({s.lo for s in new if s.lo not in above} | {e for e in ends if not any(e in x for x in inside.values())})
        above.update(zip(alone, slopes_above(chunks, alone, [cuts(e, CHUNK) for e in alone]) if alone else []))
        for s in strips:
            if inside[s.lo]:
                above.update({e: above[s.lo] - m for e, m in zip(inside[s.lo], slopes_up_to(s, inside[s.lo]))})

    for step in range(60):
        todo = sorted({bracket[r] for r in ranks if r not in done})
        if not todo:
            break
        size = {b: above[b[0]] - above[b[1]] for b in todo}
        small = {b for b in todo if size[b] <= listed}
        wide = [b for b in todo if b not in small]
        got, slopes = None, {}
        if todo == [(-math.inf, math.inf)] and not small:
            xa, ya, xb, yb = _drawn_points(chunks, weights, sample, seed)
            some_x, some_y = np.concatenate([xa, xb]), np.concatenate([ya, yb])
            ok = xa != xb
            if ok.sum() >= sample // 4:                            # else most pairs are tied in x: the tree draws from the others alone
                slopes = {0: (yb - ya)[ok] / (xb - xa)[ok]}
        if not slopes:
            got = pairs_in_brackets(points, todo, [1.0 if b in small else sample / size[b] for b in todo], total, seed + step, strips)
            got = cut_lineage(got) if small and wide else got      # read twice
        if small:
            seek = {r: (todo.index(bracket[r]), r - (pairs - above[bracket[r][0]])) for r in ranks if r not in done and bracket[r] in small}
            lists = got.where(c("k").isin([todo.index(b) for b in small]))
            done |= _read_ranks(lists, {k: b for k, b in enumerate(todo) if b in small}, seek, sum(size[b] for b in small))
        if not wide:
            continue
        if not slopes:
            t = got.where(c("k").isin([todo.index(b) for b in wide])).select("k", "slope").toArrow()
            of, s = t.column("k").to_numpy(), t.column("slope").to_numpy()
            slopes = {k: s[of == k] for k in np.unique(of).tolist()}
        for r in ranks:
            if r in done or bracket[r] not in wide:
                continue
            lo, hi = bracket[r]
            s = np.sort(slopes[todo.index(bracket[r])])
            f = (r - (pairs - above[lo]) + 0.5) / size[bracket[r]]
            slack = 5 * math.sqrt(len(s) * f * (1 - f)) + 5
            i, j = math.floor(f * len(s) - slack), math.ceil(f * len(s) + slack)
            mid = float(s[min(max(int(f * len(s)), 0), len(s) - 1)])
            near = TOLERANCE * (max(abs(mid), float(np.mean(np.abs(s)))) or 1.0)
            new = (max(lo, float(s[i]) - near) if i >= 0 else lo, min(hi, float(s[j]) + near) if j < len(s) else hi)
            if new == bracket[r] or new[1] - new[0] <= 4 * near:   # equal slopes all around: no bracket is narrower
                new = (max(lo, mid - near), min(hi, mid + near))
                equal[r] = new, mid
            bracket[r] = new
        count_ends()
        for r in ranks:
            if r in done:
                continue
            lo, hi = bracket[r]
            if pairs - above[lo] <= r < pairs - above[hi]:
                if r in equal and equal[r][0] == (lo, hi):
                    done[r] = equal[r][1]
            elif r < pairs - above[lo]:                            # the draw missed: the rank lies between known ends
                bracket[r] = (max(e for e in above if pairs - above[e] <= r and e < lo), lo)
            else:
                bracket[r] = (hi, min(e for e in above if pairs - above[e] > r and e > hi))
    return [done.get(r, math.nan) for r in ranks]
