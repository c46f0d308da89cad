"""Periodic runs of words: common extensions through a difference cover, asked for on harmonic grids.

A stretch of words with period q that is at least four periods long holds a pair (i, i + q) with i on the grid 0, 3q, 6q, ...: so every run shows itself at one of the
n ln(n) / 3 grid pairs, extended to both sides. Most pairs end within a few words, compared directly. The others ask a structure that sorts only the suffixes at the
positions of a difference cover: any two positions reach two of those within 31 words, and the least common prefix between them in sorted order is the extension."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statweave.llm.shared import crc_of_id, table, text_bytes, word_hashes

#: A perfect difference set: every residue modulo 31 is a difference of two of its members in one way.
MODULUS, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
#: Words compared directly before the structure is asked, words looked at together, and grid pairs held together.
DIRECT, SLICE_WORDS, PAIRS = 16, 1 << 17, 1 << 20
_SAME = np.arange(256, dtype=np.uint8)


def _shifts() -> np.ndarray:
    """shift[a, b]: the least t with a + t and b + t both in the cover, modulo MODULUS."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    a, b, t = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return np.argmax(inside[(a + t) % MODULUS] & inside[(b + t) % MODULUS], axis=2)


_SHIFT = _shifts()


def _equal_words(w: np.ndarray, i: np.ndarray, j: np.ndarray, most, step: int = 1) -> np.ndarray:
    """How many words at i, i + step, ... equal those at j, j + step, ..., at most `most` (a number or one per pair)."""
    got = np.zeros(len(i), np.int64)
    left = np.arange(len(i))
    for t in range(int(np.max(most, initial=0))):
        left = left[got[left] == t]
        if np.ndim(most):
            left = left[most[left] > t]
        if not len(left):
            break
        left = left[w[i[left] + step * t] == w[j[left] + step * t]]
        got[left] += 1
    return got


class CoverLce:
    """Longest common extensions within a sequence of ids whose last one occurs nowhere else."""

    def __init__(self, w: np.ndarray):
        n = len(w)
        self.w = w = np.unique(w, return_inverse=True)[1].astype(np.int64).reshape(-1) + 1
        pos = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        number = np.full(n + MODULUS, -1, np.int64)
        number[pos] = np.arange(len(pos))
        padded = np.concatenate([w, np.zeros(MODULUS, np.int64)])
        bits = int(w.max()).bit_length()
        together = 62 // bits
        keys = []
        for a in range(0, MODULUS, together):
            key = np.zeros(len(pos), np.int64)
            for k in range(a, min(a + together, MODULUS)):
                key = (key << bits) | padded[pos + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        differ = np.zeros(max(len(pos) - 1, 0), bool)
        for key in keys:
            differ |= key[order[1:]] != key[order[:-1]]
        rank = np.zeros(len(pos), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(differ)]) if len(pos) else 0
        levels, height = [(MODULUS, rank)], MODULUS
        while len(pos) and rank.max() + 1 < len(pos):                  # rank by twice as many blocks, until no two suffixes are alike
            ahead = number[np.minimum(pos + height, n)]
            key = rank * (len(pos) + 1) + np.where(ahead < 0, 0, rank[ahead] + 1)
            order = np.argsort(key, kind="stable")
            rank = np.zeros(len(pos), np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            height *= 2
            levels.append((height, rank))
        x, y = pos[order[:-1]], pos[order[1:]]
        common = np.zeros(len(x), np.int64)
        for height, level in reversed(levels):
            a, b = number[np.minimum(x + common, n)], number[np.minimum(y + common, n)]
            common += np.where((a >= 0) & (b >= 0) & (level[a] == level[b]), height, 0)
        common += _equal_words(padded, x + common, y + common, MODULUS)
        self.number, self.rank, self.least = number, rank, [common]
        while len(self.least[-1]) > 1 << (len(self.least) - 1):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and at j > i have in common."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        got = _equal_words(self.w, i, j, shift)
        on = np.flatnonzero(got == shift)
        if len(on):
            a, b = self.rank[self.number[i[on] + shift[on]]], self.rank[self.number[j[on] + shift[on]]]
            a, b = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level):
                m = level == k
                got[on[m]] += np.minimum(self.least[k][a[m]], self.least[k][b[m] - (1 << int(k))])
        return got


def _pieces(lengths: np.ndarray, ratio: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The grid pairs of texts of these lengths: (text, i, q), about PAIRS at once, or one period of one text."""
    periods = np.where(lengths >= least, lengths // ratio, 0)
    text = np.repeat(np.arange(len(lengths)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (ratio - 1) * q
    count = (lengths[text] - q - 1) // step + 1
    ends = np.cumsum(count)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
        c = count[a:b]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(text[a:b], c), k * np.repeat(step[a:b], c), np.repeat(q[a:b], c)
        a = b


def find_runs(words: np.ndarray, first: np.ndarray, ratio: int = 4, least: int = 6) -> np.ndarray:
    """Rows (text, start, length, period) of every run, by text, start and period: stretches whose smallest period q fits `ratio` times, of `least` words or more, that no
    neighbouring word extends. Text t has words[first[t]:first[t + 1]] (ids, equal for equal words)."""
    lengths = np.diff(first)
    ids = np.unique(words, return_inverse=True)[1].reshape(-1).astype(np.int64)
    sure, open_ = [np.zeros((0, 4), np.int64)], []
    w, at = _walled(ids, first, np.arange(len(lengths)))
    for text, i, q in _pieces(lengths, ratio, least):
        x = at[text] + i
        same = np.flatnonzero(w[x] == w[x + q])
        text, i, q, x = text[same], i[same], q[same], x[same]
        ahead, back = _equal_words(w, x, x + q, DIRECT), _equal_words(w, x - 1, x + q - 1, DIRECT, -1)
        known = (ahead < DIRECT) & (back < DIRECT)
        good = known & (q + ahead + back >= np.maximum(ratio * q, least))
        sure.append(np.stack([text, i - back, q + ahead + back, q], 1)[good])
        open_.append(np.stack([text, i, q], 1)[~known])
    rest = np.concatenate(open_) if open_ else np.zeros((0, 3), np.int64)
    if len(rest):                                                      # only their texts are sorted
        texts, text = np.unique(rest[:, 0], return_inverse=True)
        w, at = _walled(ids, first, texts)
        ahead_of, back_of, top = CoverLce(w), CoverLce(w[::-1]), len(w) - 1
        for a in range(0, len(rest), PAIRS):
            i, q = rest[a:a + PAIRS, 1], rest[a:a + PAIRS, 2]
            x = at[text.reshape(-1)[a:a + PAIRS]] + i
            ahead, back = ahead_of(x, x + q), back_of(top - (x + q - 1), top - (x - 1))
            good = q + ahead + back >= np.maximum(ratio * q, least)
            sure.append(np.stack([rest[a:a + PAIRS, 0], i - back, q + ahead + back, q], 1)[good])
    out = np.concatenate(sure)
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
    new = np.ones(len(out), bool)
    new[1:] = np.any(out[1:, :3] != out[:-1, :3], axis=1)              # the same stretch shows at multiples of its period too
    out = out[new]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _walled(ids: np.ndarray, first: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of these texts with an id of its own before, between and after them, and where each text begins."""
    sizes = np.diff(first)[texts]
    at = np.cumsum(sizes + 1) - sizes
    w = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    inside = np.ones(len(w), bool)
    walls = np.concatenate([[0], at + sizes])
    inside[walls] = False
    w[walls] = -1 - np.arange(len(walls))
    source = np.repeat(first[texts] - (at - np.arange(len(texts)) - 1), sizes) + np.arange(int(sizes.sum()))
    w[inside] = ids[source]
    return w, at


def _collapsed(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of every text joined by one space."""
    kept = np.concatenate([[0], np.cumsum(keep)])[first]               # kept words before each text
    starts, sizes = starts[keep], (stops - starts)[keep] + 1
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out = np.concatenate([raw, [32]]).astype(np.uint8)[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]
    out[ends - 1] = 32
    last = np.zeros(len(ends), bool)
    last[kept[1:][kept[1:] > kept[:-1]] - 1] = True
    mask = np.ones(total, bool)
    mask[ends[last] - 1] = False                                       # no space after a text's last word
    sizes = sizes - last
    offsets = np.concatenate([[0], np.cumsum(sizes)])[kept].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[mask].tobytes())).cast(pa.string())


def _runs_of(column: pa.Array, ratio: int, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of every text."""
    raw, _ = text_bytes(column)
    words, first, starts, stops = word_hashes(column, spans=True, fold=_SAME)
    found = find_runs(words, first, ratio, least)
    begin = first[found[:, 0]] + found[:, 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begin + found[:, 3], 1)
    np.add.at(edge, begin + found[:, 2], -1)
    keep = np.cumsum(edge[:-1]) == 0
    runs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    offsets = np.searchsorted(found[:, 0], np.arange(len(first))).astype(np.int32)
    return pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(offsets), runs), _collapsed(raw, starts, stops, first, keep)


def periodic_runs(docs: DataFrame, text: str = "text", ratio: int = 4, least: int = 6) -> DataFrame:
    """Every row of docs with `n_words` long, `runs` (array of start, length, period, by start and period) and `collapsed`, the words left when every run keeps its first
    period only, joined by one space; `text` itself is left out, and columns with the names of results are replaced.

    Words are runs of characters other than white space (9-13, 32), compared as they are. Null and empty texts have no words, no runs and an empty collapsed text; repeated rows and
    equal runs at the same start are each told; no rows give no rows. A text is one unit of work however long; nothing is shuffled."""
    keep = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed")]
    source = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    results = StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    schema = StructType([*(f for f in source.schema.fields if f.name != "_text"), *results.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ends = text_bytes(batch.column(0))
            i = 0
            while i < batch.num_rows:                                  # whole texts, about 8 bytes a word
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + 8 * SLICE_WORDS, side="right")) - 1)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *_runs_of(part.column(0), ratio, least)], names)
                i = j
    return source.mapInArrow(run, schema)


def longest_run(runs: str = "runs") -> Column:
    """The run with the greatest length / period, exactly compared; of ties the first by start and period; null where there is none."""
    return F.expr(f"aggregate({runs}, CAST(NULL AS struct<start:long,length:long,period:long>), (m, r) -> CASE WHEN m IS NULL OR r.length * m.period > m.length * r.period THEN r ELSE m END)")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; for every tenth document by its id's checksum a tail of the text is replaced by repetitions of the tail's beginning."""
    planted = """transform(array(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), w -> CASE WHEN size(w) = 0 THEN text ELSE concat_ws(' ', transform(sequence(0, size(w) - 1),
        i -> w[CAST(CASE WHEN i < g % size(w) THEN i ELSE g % size(w) + (i - g % size(w)) % (1 + (size(w) - g % size(w)) DIV (3 + g % 8)) END AS INT)])) END)[0]"""
    return docs.select("doc_id", "text", crc_of_id(F.col("doc_id")).alias("h")).withColumn("g", F.expr("h DIV 10")).select(
        "doc_id", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.expr(planted)).otherwise(F.col("text")).alias("text"))


def op12_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.col("best")
    rows = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents"))).withColumn("best", longest_run())
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                       F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
                       F.expr("sha2(concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n'))), 256)").alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
