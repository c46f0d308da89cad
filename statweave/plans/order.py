"""Global row numbers of an order over any sortable columns, without a single-task window."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import MapType

from statweave.plans.common import cut_lineage
from statweave.plans.cumulate import rows_per_bucket

c = F.col


def numbered(df: DataFrame, order: Sequence[Column], total: int | None = None, out: str = "_g") -> DataFrame:
    """``df`` with its row number (from 0) in this order as ``out``; rows equal in it follow by a hash of all columns.

    Spark's range partitioning samples the whole sort key, so long texts with one beginning and any type are cut where their rows lie; the hash and a row id after it split rows of one
    key. Rows are numbered by their place in their sorted range plus the rows of the ranges before (one number per range)."""
    total = df.count() if total is None else total
    ranges = max(1, -(-total // rows_per_bucket(df)))
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    src = df.withColumns({"_tie": F.xxhash64(*plain), "_row": F.monotonically_increasing_id()})
    keys = [*order, c("_tie"), c("_row")]
    spread = src.repartitionByRange(ranges, *keys) if ranges > 1 else src.coalesce(1)
    placed = cut_lineage(spread.sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()).drop("_tie", "_row"))
    part, place = F.shiftright("_m", 33), c("_m").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))        # a row per range
    return placed.withColumn("_q", part).join(F.broadcast(offsets), c("_q") == c("_p")).withColumn(out, place + c("_off")).drop("_m", "_q", "_p", "_off")


def block_ranges(total: int, n: int, blocks: int) -> list[tuple[int, int]]:
    """First and last row number of each of ``blocks`` runs that hold ``n`` of ``total`` rows together: run b starts at total * b / blocks, later where the run before has not ended, and
    earlier where the rows left would not hold the rest."""
    n = min(n, total)
    sizes = [n // blocks + (b < n % blocks) for b in range(blocks)]
    out, end = [], 0
    for b, size in enumerate(sizes):
        start = max(end, min(total * b // blocks, total - sum(sizes[b:])))
        end = start + size
        if size:
            out.append((start, end - 1))
    return out
