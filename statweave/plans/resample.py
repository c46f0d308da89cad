"""Resampling replicates computed inside the partitions.

Bootstrap: every row draws a Poisson(1) multiplicity per replicate from a hash of (row key,
replicate, seed); each partition reduces to one row of weighted sums per (stratum, replicate),
so nothing is exploded or cross joined and the answer does not depend on partitioning.

Permutation: labels are dealt exactly (group sizes kept).  A seeded binary tree splits the deal
over value buckets by hypergeometric draws, each task walks to its own buckets, and only sums per
replicate leave it.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from statweave.plans.common import cut_lineage

_POISSON1 = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix) turning counters into uniform bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(h: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """(rows, reps) uniforms that depend only on row hash, replicate number and seed."""
    with np.errstate(over="ignore"):
        mixed = reps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        bits = _mix(h.astype(np.int64).view(np.uint64)[:, None] ^ _mix(mixed)[None, :])
    return (bits >> np.uint64(11)).astype(float) / float(1 << 53)


def bootstrap_sums(df: DataFrame, key: Sequence[str], cols: Sequence[str], reps: int = 500,
                   by: Sequence[str] = (), seed: int = 0, chunk: int = 4096) -> DataFrame:
    """(by, b) -> ``w`` and ``s_<col>``: Poisson-weighted count and sums per replicate."""
    by = list(by)
    src = df.select(*[F.col(c).cast("string").alias(c) for c in by],
                    F.xxhash64(*key).alias("_h"), *[F.col(c).cast("double") for c in cols])
    src = src.dropna(subset=[*by, *cols])
    out_cols = [*by, "b", "w", *[f"s_{c}" for c in cols]]
    schema = ", ".join([f"`{c}` string" for c in by] + ["b int", "w double"]
                       + [f"`s_{c}` double" for c in cols])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = np.arange(reps)
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, sort=False) if by else [((), pdf)]
            for k, g in groups:
                k = k if isinstance(k, tuple) else (k,)
                x = np.column_stack([np.ones(len(g)), *[g[c].to_numpy(float) for c in cols]])
                h = g["_h"].to_numpy()
                total = acc.setdefault(k, np.zeros((reps, x.shape[1])))
                for lo in range(0, len(g), chunk):
                    w = np.searchsorted(_POISSON1, uniforms(h[lo:lo + chunk], b, seed))
                    total += w.T.astype(float) @ x[lo:lo + chunk]
        for k, total in acc.items():
            yield pd.DataFrame([[*k, int(i), *total[i]] for i in range(reps)], columns=out_cols)

    return src.mapInPandas(run, schema).groupBy(*by, "b").agg(
        F.sum("w").alias("w"), *[F.sum(f"s_{c}").alias(f"s_{c}") for c in cols])


def percentile_ci(reps: DataFrame, value, by: Sequence[str] = ()) -> DataFrame:
    """2.5 % and 97.5 % points over the replicate rows."""
    return reps.groupBy(*by).agg(F.percentile(value, 0.025).alias("ci_low"),
                                 F.percentile(value, 0.975).alias("ci_high"))


# ------------------------------------------------------------------ exact relabelling
def _hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, draws) -> np.ndarray:
    """Marked items among `draws` of good + bad, elementwise. Populations that numpy's sampler refuses (1e9 and more) are drawn from the normal law with the same mean and variance."""
    n = good + bad
    if np.max(n, initial=0) < 1_000_000_000:
        return rng.hypergeometric(good, bad, draws)
    d = np.broadcast_to(np.asarray(draws, float), n.shape)
    share = good / np.maximum(n, 1)
    sd = np.sqrt(np.maximum(d * share * (1 - share) * (n - d) / np.maximum(n - 1, 1), 0))
    return np.clip(np.rint(d * share + sd * rng.standard_normal(n.shape)), np.maximum(0, d - bad), np.minimum(d, good)).astype(np.int64)


def _share_out(rng: np.random.Generator, left: np.ndarray, draws: int) -> np.ndarray:
    """(reps, levels): labels of each level among `draws` rows taken from those left."""
    out = np.zeros_like(left)
    need = np.full(len(left), draws, dtype=np.int64)
    rest = left.sum(axis=1)
    for g in range(left.shape[1] - 1):
        rest = rest - left[:, g]
        out[:, g] = _hypergeometric(rng, left[:, g], rest, need)
        need = need - out[:, g]
    out[:, -1] = need
    return out


def _at_bucket(counts: np.ndarray, target: int, sizes: np.ndarray, reps: int, seed: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(labels in the buckets before, labels in the bucket), each (reps, levels): the way from the root of a binary tree over the buckets to one leaf. A node's draw depends on
    the seed and the node alone, so every task finds the same deal for the part it needs."""
    lo, hi = 0, len(counts)
    total = np.concatenate([[0], np.cumsum(counts)])
    here = np.repeat(sizes[None, :], reps, axis=0).astype(np.int64)
    before = np.zeros_like(here)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _share_out(np.random.default_rng([*seed, 1, lo, hi]), here, int(total[mid] - total[lo]))
        if target < mid:
            here, hi = left, mid
        else:
            before, here, lo = before + left, here - left, mid
    return before, here


def _even_cuts(table: DataFrame, value: str, rows: int) -> list[float]:
    """Cut points for buckets of about this many rows, from values drawn by a threshold on their hashes (about 64 per bucket): the same however the table is partitioned."""
    n = table.count()
    want = min(4096, -(-n // rows))
    if want <= 1:
        return []
    some = table.select(value).distinct()
    if 64 * want < n:
        some = some.where(F.xxhash64(value) < F.lit(int(64 * want / n * 2 ** 64) - 2 ** 63))
    drawn = np.sort(some.toArrow().column(0).to_numpy())
    return sorted({float(drawn[len(drawn) * i // want]) for i in range(1, want)}) if len(drawn) else []


#: Rows of one value that are dealt together by hypergeometric draws; fewer are dealt one by one.
TOGETHER = 16


def _dealt(rng: np.random.Generator, left: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(values, reps, levels): the labels ``left`` (reps, levels) dealt at random to values with these counts, all of them. Values with many rows draw from what is left one after
    another; the rows of all others get the rest in the order of random keys, whose lowest bits are the labels."""
    levels, left = left.shape[1], left.copy()
    k = np.zeros((len(count), len(left), levels), dtype=np.int64)
    for i in np.flatnonzero(count > TOGETHER):
        k[i] = _share_out(rng, left, int(count[i]))
        left -= k[i]
    few = np.flatnonzero(count <= TOGETHER)
    if len(few):
        rows, bits = int(count[few].sum()), max(1, (levels - 1).bit_length())
        kind = np.uint32 if rows * rows << bits + 5 < 1 << 32 else np.uint64
        low = kind((1 << bits) - 1)
        label = np.zeros((len(left), rows), dtype=kind)
        place = np.arange(rows)
        for edge in np.cumsum(left, axis=1).T[:-1]:
            label += place >= edge[:, None]
        keys, again = np.empty_like(label), np.arange(len(left))
        while len(again):                                          # equal random bits would leave labels in order, so such replicates draw anew
            part = rng.integers(0, np.iinfo(kind).max, (len(again), rows), dtype=kind, endpoint=True) & ~low | label[again]
            part.sort(axis=1)
            keys[again] = part
            again = again[((part[:, 1:] ^ part[:, :-1]) <= low).any(axis=1)]
        label = np.ascontiguousarray((keys & low).astype(np.int16).T)
        single = (count[few] == 1).all()
        starts = np.cumsum(count[few]) - count[few]
        where = slice(None) if len(few) == len(count) else few
        for g in range(levels):
            k[where, :, g] = label == g if single else np.add.reduceat((label == g).astype(np.int64), starts, axis=0)
    return k


def _bucketed(table: DataFrame, value: str, by: list[str], rows: int) -> tuple[DataFrame, dict[tuple, dict[int, tuple[int, float, float]]]]:
    """The table with ``_bucket`` and, per stratum and bucket, its rows, smallest and largest value."""
    from statweave.plans.cumulate import add_bucket
    cols = [*[F.col(c).cast("string").alias(c) for c in by], F.col(value).alias("v"), "n", "cum_n", "tot_n", "next_value"]
    table = cut_lineage(table.select(*cols))                       # read four times below
    src = add_bucket(table, "v", _even_cuts(table, "v", rows)).withColumn("_bucket", F.col("_bucket").cast("int"))
    cells: dict[tuple, dict[int, tuple[int, float, float]]] = {}
    for r in src.groupBy(*by, "_bucket").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        cells.setdefault(tuple(r[c] for c in by), {})[r["_bucket"]] = (r["n"], r["lo"], r["hi"])
    return src, cells


def _mark(seed: int, stratum: tuple) -> list[int]:
    return [seed, zlib.crc32("\x00".join(map(str, stratum)).encode())]


def _all_buckets(counts: np.ndarray, sizes: np.ndarray, reps: int, seed: Sequence[int]) -> np.ndarray:
    """(buckets, reps, levels): the labels that the splitting tree of ``_at_bucket`` deals to every bucket."""
    out = np.zeros((len(counts), reps, len(sizes)), dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(counts)])
    todo = [(0, len(counts), np.repeat(sizes[None, :], reps, axis=0).astype(np.int64))]
    while todo:
        lo, hi, here = todo.pop()
        if hi - lo == 1:
            out[lo] = here
            continue
        mid = (lo + hi) // 2
        left = _share_out(np.random.default_rng([*seed, 1, lo, hi]), here, int(total[mid] - total[lo]))
        todo += [(lo, mid, left), (mid, hi, here - left)]
    return out


def permuted(table: DataFrame, value: str, sizes: dict[tuple, Sequence[int]], reps: int, terms: Callable, names: Sequence[str],
             by: Sequence[str] = (), seed: int = 0, rows: int = 20_000, how: str = "sum", unsure: Callable | None = None) -> DataFrame:
    """(by, _rep, names): statistics that are a sum (or with ``how`` "max" the largest) over distinct values, under ``reps`` exact relabellings of each stratum.

    ``table`` is a ``cumulate`` table with one row per (by, value): n rows in all, cum_n, tot_n and next_value. ``sizes`` has the rows of each level per stratum (its key as text).
    Rows of one value are alike, so a relabelling deals label counts to values: a splitting tree deals them to value buckets, a task draws those of its buckets, and runs of values
    inside a bucket draw from what is left. Only the sums of each bucket and replicate leave a task. ``terms(part, before, k, total)`` gives (reps, names) for a run of values: part has
    the columns, before (values, reps, levels) the labels below each value, k those at it.

    ``unsure(deal, first, last, sizes)`` may name the replicates (an array) of a stratum for which the counts per bucket, deal (buckets, reps, levels), and each bucket's smallest and
    largest value leave open what the caller asks; the others are not drawn further and give no rows."""
    by = list(by)
    src, cells = _bucketed(table, value, by, rows)
    order = {k: sorted(v) for k, v in cells.items()}
    wanted = {k: np.arange(reps) for k in cells}
    if unsure is not None:
        for key, places in order.items():
            got = np.array([cells[key][x] for x in places], dtype=float)
            whole = np.asarray(sizes[key], dtype=np.int64)
            wanted[key] = unsure(_all_buckets(got[:, 0].astype(np.int64), whole, reps, _mark(seed, key)), got[:, 1], got[:, 2], whole.astype(float))
    out_cols = [*by, "_rep", *names]
    schema = ", ".join([f"`{x}` string" for x in by] + ["_rep int"] + [f"`{x}` double" for x in names])
    if not any(len(v) for v in wanted.values()):
        return table.sparkSession.createDataFrame([], schema)
    levels = max((len(v) for v in sizes.values()), default=1)
    chunk = max(8, (1 << 18) // (reps * levels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, rest, state = None, None, None

        def start(key: tuple) -> list:
            stratum = tuple(key[:-1])
            deal = np.array([cells[stratum][x][0] for x in order[stratum]], dtype=np.int64)
            place, mark, some = order[stratum].index(key[-1]), _mark(seed, stratum), wanted[stratum]
            before, left = _at_bucket(deal, place, np.asarray(sizes[stratum], dtype=np.int64), reps, mark)
            return [before[some], left[some], np.random.default_rng([*mark, 2, place]), np.zeros((len(some), len(names))), np.asarray(sizes[stratum], float)]

        def take(piece: pd.DataFrame) -> None:
            before, left, rng, total, whole = state
            count = piece["n"].to_numpy()
            here = _share_out(rng, left, int(count.sum()))
            k = _dealt(rng, here, count)
            below = before[None] + np.cumsum(k, axis=0) - k if getattr(terms, "needs_before", True) else None
            more = terms(piece, below, k, whole)
            state[:2], state[3] = (before + here, left - here), total + more if how == "sum" else np.maximum(total, more)

        def done() -> pd.DataFrame:
            if len(rest):
                take(rest)
            out = pd.DataFrame(state[3], columns=list(names))
            out.insert(0, "_rep", wanted[tuple(cell[:-1])])
            for x, v in reversed(list(zip(by, cell))):
                out.insert(0, x, v)
            return out[out_cols]

        for pdf in batches:
            for key, part in pdf.groupby([*by, "_bucket"], sort=False):
                if key != cell:
                    if cell is not None:
                        yield done()
                    cell, state, rest = key, start(key), part.iloc[:0]
                rest = pd.concat([rest, part]) if len(rest) else part      # runs begin at the same values whatever the batches are
                full = len(rest) // chunk * chunk
                for at in range(0, full, chunk):
                    take(rest.iloc[at:at + chunk])
                rest = rest.iloc[full:]
        if cell is not None:
            yield done()

    parts = max(1, sum(map(len, cells.values())))
    rows_in = src.repartition(min(parts, 4096), *by, "_bucket").sortWithinPartitions(*by, "_bucket", "v")
    return rows_in.mapInPandas(run, schema).groupBy(*by, "_rep").agg(*[getattr(F, how)(x).alias(x) for x in names])


def level_sums(part: pd.DataFrame, before: np.ndarray, k: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sum of the values that fall to each level."""
    return np.tensordot(part["v"].to_numpy(float), k.astype(float), axes=1)


level_sums.needs_before = False
