"""Exact top-k search by tiles: matrix products of query blocks and shards, a selection in each tile, and merging."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statweave.llm.shared import cut, table


def quantised(vectors: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and q: the components times scale, rounded down, as longs. Vectors that are null or hold a null or a non-finite component are left out."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        "vec_id", F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def _packed(rows: DataFrame, rows_per_block: int) -> DataFrame:
    """vec_id, q and a number `block` as packs of at most rows_per_block rows of one block with as many components: block, dim, ids and components as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.stack([np.asarray(batch.column(2)), np.asarray(batch.column(1).value_lengths())])
            for block, dim in np.unique(kinds, axis=1).T.tolist():
                rows = np.flatnonzero((kinds[0] == block) & (kinds[1] == dim))
                for a in range(0, len(rows), rows_per_block):
                    part = batch.take(pa.array(rows[a:a + rows_per_block]))
                    ids = np.asarray(part.column(0), dtype="<i8")
                    q = np.asarray(part.column(1).flatten(), dtype="<i8")
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary())],
                                                     ["block", "dim", "ids", "q"])
    return rows.select("vec_id", "q", F.col("block").cast("int")).mapInArrow(run, "block int, dim int, ids binary, q binary")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows: through doubles where every partial sum stays below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every query the k best (vec_id, score) of a tile; ties go to the smaller vec_id. The columns ascend by vec_id."""
    for row, me in zip(scores, own):
        take = np.flatnonzero(ids != me)
        s = row[take]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            keep = np.flatnonzero(s >= least)
            if len(keep) > k:                                      # ties at the last place: those above it, then the first of it
                above = keep[s[keep] > least]
                keep = np.concatenate([above, keep[s[keep] == least][:k - len(above)]])
            take, s = take[keep], s[keep]
        order = np.lexsort((ids[take], -s))[:k]
        yield ids[take[order]], s[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 2_048, shard_rows: int = 16_384, groups: int = 64) -> DataFrame:
    """The k rows of `vectors` with the largest integer inner product for every row of `queries` (both: vec_id, q as `quantised` gives).

    Rows are packed into shards and queries into blocks; shard groups and blocks meet in a grid of tiles by an equi-join, each tile is one matrix product
    with a partial selection, and lists merge in two steps, by (query, shard group) and by query, each step limited before it shuffles. Rows with the query's
    vec_id are the query's own and no candidates; a repeated vec_id as query is answered once. Vectors of another length than the query's are no candidates.
    Ties go to the smaller vec_id. Rows without vec_id take no part. No rows give no rows. Returns query_id, rank, vec_id, score."""
    asked = cut(queries.filter(F.col("vec_id").isNotNull()).dropDuplicates(["vec_id"]))
    count = max(1, -(-asked.count() // query_block))
    blocks = _packed(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count))).repartition("block"), 2 * query_block)
    shards = _packed(vectors.filter(F.col("vec_id").isNotNull()).withColumn("block", F.lit(0)), shard_rows)
    left = shards.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), "dim", "ids", "q")
    right = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("tile"), "block", "dim", F.col("ids").alias("qids"), F.col("q").alias("qq"))
    grid = left.join(right, ["tile", "block", "dim"]).select("tile", "dim", "ids", "q", "qids", "qq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, dim, ids, q, qids, qq in zip(*(batch.column(i) for i in range(6))):
                ids, qids = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(qids.as_py(), "<i8")
                order = np.argsort(ids, kind="stable")
                width = dim.as_py()
                rows = np.frombuffer(q.as_py(), "<i8").reshape(len(ids), width)[order]
                asked = np.frombuffer(qq.as_py(), "<i8").reshape(len(qids), width)
                ids = ids[order]
                for a in range(0, len(qids), 256):
                    found = list(_best(_products(asked[a:a + 256], rows), ids, qids[a:a + 256], k))
                    count = np.array([len(f[0]) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[a:a + 256], count)), pa.array(np.full(count.sum(), tile.as_py(), np.int32)),
                                                      pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "tile", "vec_id", "score"])

    lists = grid.mapInArrow(run, "query_id long, tile int, vec_id long, score long")
    best = [F.col("score").desc(), F.col("vec_id")]
    merged = lists.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "tile").orderBy(*best))).filter(F.col("r") <= k)
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
