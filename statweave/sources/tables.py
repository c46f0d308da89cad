"""Reading, sampling, reshaping and writing tables."""
from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from statweave.plans.order import block_ranges, numbered


c = F.col
FORMATS = {".csv": ("csv", ","), ".tsv": ("csv", "\t"), ".parquet": ("parquet", None)}


def _format(path: str) -> tuple[str, str | None]:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"cannot read {path!r}: csv, tsv and parquet are supported")
    return FORMATS[suffix]


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               schema: StructType | str | None = None) -> DataFrame:
    """csv / tsv / parquet by suffix.  Text tables take a schema when given (no inference pass)."""
    fmt, sep = _format(path)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("sep", sep)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.load(path)
    return df.select(*columns) if columns else df


def open_meta(spark: SparkSession, path: str) -> DataFrame:
    """column, dtype, and the exact row count where the format stores it (parquet footers)."""
    fmt, sep = _format(path)
    df = read_table(spark, path) if fmt == "parquet" else spark.read.option("header", True).option("sep", sep).csv(path)
    n = df.count() if fmt == "parquet" else None
    return spark.createDataFrame(
        [(fmt, i, col, kind if fmt == "parquet" else None, n) for i, (col, kind) in enumerate(df.dtypes)],
        "format string, position int, column string, dtype string, n_rows bigint")


def estimate_rows(spark: SparkSession, path: str, probe: int = 200) -> int:
    """File bytes over the mean length of the first ``probe`` lines (text tables)."""
    lines = spark.read.text(path).limit(probe + 1)
    mean = lines.agg(F.avg(F.octet_length("value") + 1)).first()[0]
    files = spark.read.text(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    size = files.agg(F.sum("file_size")).first()[0] or 0
    return max(0, round(size / mean) - 1) if mean else 0


def sample_blocks(df: DataFrame, order: Sequence[str], n: int = 10_000, blocks: int = 3) -> DataFrame:
    """Exactly ``n`` rows (all of a smaller table) from ``blocks`` equally spaced runs of the ordered table (front, middle, back), so a table sorted by batch is not judged by its head."""
    total = df.count()
    if total <= n:
        return df
    pos = numbered(df, [c(v) for v in order], total)
    return pos.where(_within("_g", block_ranges(total, n, blocks))).select(*df.columns)


def _within(col: str, ranges: Sequence[tuple[int, int]]):
    return reduce(lambda a, b: a | b, [c(col).between(lo, hi) for lo, hi in ranges], F.lit(False))


def sample_rows(spark: SparkSession, path: str, n: int = 10_000, blocks: int = 3, columns: Sequence[str] | None = None) -> DataFrame:
    """As ``sample_blocks``, in the order of the rows in the files of a parquet table: rows are known by their place in their file, so nothing is sorted or shuffled."""
    fmt, _ = _format(path)
    if fmt != "parquet":
        raise ValueError("rows of text tables have no place of their own: read the table and use sample_blocks")
    df = read_table(spark, path)
    sizes = df.groupBy(c("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).orderBy("f").collect()       # a row per file
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["f"], total))
        total += r["n"]
    src = df.select("*", c("_metadata.file_path").alias("_f"), c("_metadata.row_index").alias("_i"))
    src = src.join(F.broadcast(spark.createDataFrame(offsets, "_f2 string, _off long")), c("_f") == c("_f2")).withColumn("_g", c("_i") + c("_off"))
    return src.where(_within("_g", block_ranges(total, n, blocks))).select(*(columns or df.columns))


def hash_sample(df: DataFrame, key: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    """Repeatable row sample that does not depend on partitioning."""
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / float(1 << 53)
    return df.where(u < fraction)


# ------------------------------------------------------------------ transpose
def transpose_cost(df: DataFrame) -> DataFrame:
    """Cells x 64 bytes with a warning above 4 GB."""
    k = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(k).alias("n_columns"), (c("n_rows") * k * 64).alias("bytes"), (c("n_rows") * k * 64 > 4 * 1024 ** 3).alias("warn"))


def transpose(df: DataFrame, header: str | None = None) -> DataFrame:
    """First column (or ``header``) becomes the column names, every other column one row."""
    head = header or df.columns[0]
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    ids = df.groupBy(c(head).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect()
    if len(ids) > limit:
        raise ValueError(f"more than {limit} header values: too wide to transpose")
    dup = [r["id"] for r in ids if r["n"] > 1]
    if dup:
        raise ValueError(f"header column {head!r} has repeated values, e.g. {dup[0]!r}")
    rest = [v for v in df.columns if v != head]
    long = df.select(c(head).cast("string").alias("_id"), *[c(v).cast("string").alias(v) for v in rest]).unpivot(
        "_id", rest, "column", "_value")
    return long.groupBy("column").pivot("_id", sorted(r["id"] for r in ids)).agg(F.first("_value"))


# ------------------------------------------------------------------ export
def export(df: DataFrame, path: str, fmt: str | None = None, provenance: dict | None = None) -> None:
    """Write a processed copy; refuses to overwrite; the record of how it arose goes beside it."""
    kind, sep = _format(path) if fmt is None else ({"tsv": "csv"}.get(fmt, fmt), "\t" if fmt == "tsv" else ",")
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer.option("header", True).option("sep", sep).csv(path)
    else:
        writer.parquet(path)
    record = {"columns": df.columns, **(provenance or {})}
    df.sparkSession.createDataFrame([(json.dumps(record, ensure_ascii=False, default=str),)], "value string") \
      .coalesce(1).write.mode("errorifexists").text(path.rstrip("/") + ".provenance")


# ------------------------------------------------------------------ integrity of a whole table
def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive fingerprint: count, sum and xor of row hashes (nulls hash by position)."""
    cols = list(columns or df.columns)
    parts = [F.coalesce(c(v).cast("string"), F.lit("\u0000")) for v in cols]
    h = F.xxhash64(*[F.lit(v) for v in cols], *parts)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def same_content(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns and fingerprint(a).first() == fingerprint(b).first()
