"""Helpers of the operators: table access, written intermediate tables, and word hashing of Arrow text columns."""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session gets a temporary folder; a cluster must set it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _LOCAL.setdefault("top", "file://" + tempfile.mkdtemp(prefix="statweave-llm-"))
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of_id(col) -> F.Column:
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


#: Bytes of text that word_hashes looks at together.
SLICE = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, spans: bool = False, breaks: np.ndarray = _SPACE, fold: np.ndarray = _LOWER):
    """64-bit hashes of the words of every text: runs of bytes that are not `breaks` (a boolean per byte value; 9-13 and 32 here), bytes replaced by `fold` (A-Z lower-cased here).

    Returns (hashes, first): text i has hashes[first[i]:first[i + 1]]. With spans, also the words' first bytes and ends within the column's bytes.
    Work goes over slices of whole texts of about SLICE bytes, so a longer text is a slice by itself."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    hashes, counts, begins, ends = [], np.zeros(n, np.int64), [], []
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        lo, hi = offsets[i], offsets[j]
        if hi > lo:
            part = raw[lo:hi]
            word = ~breaks[part]
            edge = np.flatnonzero(word[1:] != word[:-1]) + 1
            cuts = offsets[i + 1:j] - lo
            cuts = cuts[(cuts > 0) & (cuts < hi - lo)]
            inner = cuts[word[cuts - 1] & word[cuts]]                   # two texts' words touch: an end and a start
            starts = np.sort(np.concatenate([[0] if word[0] else [], edge[word[edge]], np.unique(inner)])).astype(np.int64)
            stops = np.sort(np.concatenate([edge[~word[edge]], np.unique(inner), [hi - lo] if word[-1] else []])).astype(np.int64)
            if len(starts):
                up, down = _powers(int(hi - lo) + 1)
                value = fold[part].astype(np.uint64) + np.uint64(1)
                value *= up[:len(part)]
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(value, dtype=np.uint64, out=total[1:])
                h = (total[stops] - total[starts]) * down[starts]
                hashes.append(mix(h + np.uint64(0x632BE59BD9B4E019) * (stops - starts).astype(np.uint64)))
                bounds = np.searchsorted(starts, offsets[i:j + 1] - lo)
                counts[i:j] = np.diff(bounds)
                if spans:
                    begins.append(starts + lo)
                    ends.append(stops + lo)
        i = j
    first = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    out = (cat(hashes, np.uint64), first)
    return (*out, cat(begins, np.int64), cat(ends, np.int64)) if spans else out


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs of this size; fewer words are one run, none give none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    take = min(n, size)
    h = np.full(n - take + 1, np.uint64(take), dtype=np.uint64)
    for k in range(take):
        h = mix(h * np.uint64(0xD1342543DE82EF95) + words[k:n - take + 1 + k])
    return np.unique(h)
