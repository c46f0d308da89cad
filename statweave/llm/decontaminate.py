"""Benchmark decontamination by edit distance: CGK random walks map it to Hamming distance, bit sampling finds windows near an item, exact edit distances confirm."""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm.shared import mix, table, word_hashes

#: Doc windows begin at every STRIDE-th word, and an item is indexed in segments over its whole length, each from STRIDE words on, so what is left of a copy meets
#: one window aligned. For the first SHORT sizes of items windows begin at every word.
STRIDE, SHORT = 4, 5
#: Steps of a walk, by size of the items; a walk of t steps crosses about t / 2 words.
STEPS = (1, 2, 3, 4, 8, 16, 32, 64, 96)
WALKS, TABLES, SAMPLED = 4, 8, 3


def size_class(words: int) -> int:
    """The longest walk that ends within an item about this long."""
    if words < 5:
        return words - 1
    return max((k for k, t in enumerate(STEPS) if t <= 2 * words - 6), default=0)


def item_starts(words: int) -> list[int]:
    """The words of an item where its windows begin: runs of STRIDE (one for short items), a walk's way apart, the last run's windows ending about where the item ends."""
    c = size_class(words)
    way, run = max(1, STEPS[c] // 2), 1 if c < SHORT else STRIDE
    last = max(0, words - way - run - 2)
    return sorted({s + o for s in (*range(0, last, way), last) for o in range(run)})


def _samples() -> list[list[np.ndarray]]:
    """[walk][class]: TABLES x SAMPLED steps whose symbols make a key."""
    rng = np.random.default_rng(7)
    return [[np.stack([np.sort(rng.choice(t, min(t, SAMPLED), replace=False)) for _ in range(TABLES)]) for t in STEPS] for _ in range(WALKS)]


def window_keys(words: np.ndarray, starts: np.ndarray, classes: list[int]) -> Iterator[tuple[tuple[int, int], list[np.ndarray]]]:
    """((walk, class), keys of the windows for each of TABLES), a walk at a time, of the windows that begin at `starts`; words: 64-bit symbols, zeros stand behind the last.

    A walk begins at a window's first word; at every step it writes the word it stands on and moves on or not, by a random bit of (walk, step, word): equal
    words move alike, so two windows with a small edit distance soon write the same again."""
    longest = max(STEPS[c] for c in classes)
    padded = np.concatenate([words, np.zeros(longest + 1, np.uint64)])
    for walk, sampled in enumerate(_samples()):
        coins = [mix(padded ^ np.uint64(0x5851F42D4C957F2D * (2 * walk + half + 1) & 0xFFFFFFFFFFFFFFFF)) for half in range(2 if longest > 64 else 1)]
        at = starts.copy()
        wanted = {int(t) for c in classes for t in sampled[c].ravel()}
        symbols = {}
        for step in range(longest):
            if step in wanted:
                symbols[step] = padded[at]
            at += ((coins[step >> 6][at] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
        for c in classes:
            keys = []
            for j, steps in enumerate(sampled[c]):
                h = np.full(len(starts), np.uint64(1000 * walk + 10 * c + 100 * j + 1))
                for t in steps:
                    h = (h ^ symbols[int(t)]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                keys.append(h * np.uint64(0xBF58476D1CE4E5B9))
            yield (walk, c), keys


def best_distance(item: list[int], text: list[int]) -> int:
    """The least edit distance, in words, of the item and any run of the text's words (bit-parallel)."""
    m = len(item)
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        peq[w] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & mask, mh << 1 & mask                      # a match may begin at any word
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        best = min(best, score)
    return best


@dataclass
class Index:
    """A block of items: their words, and for each table the ascending keys of their windows with (item, offset) and a map of the keys' high bits."""
    ids: list
    words: list[np.ndarray]
    classes: list[int]
    keys: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def index_items(ids: list, texts: list[str | None]) -> Index:
    h, first = word_hashes(pa.array(texts, pa.string()))
    words = [h[a:b] for a, b in zip(first[:-1], first[1:])]
    groups: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if len(w):
            groups[size_class(len(w))].append(i)
    keys = {}
    for c, members in groups.items():
        gap = np.zeros(STEPS[-1], np.uint64)
        flat = np.concatenate([x for i in members for x in (words[i], gap)])
        heads = np.cumsum([0] + [len(words[i]) + len(gap) for i in members[:-1]])
        offsets = [item_starts(len(words[i])) for i in members]
        starts = np.array([a + o for a, os in zip(heads, offsets) for o in os], dtype=np.int64)
        owner = np.array([i for i, os in zip(members, offsets) for _ in os], dtype=np.int32)
        offset = np.array([o for os in offsets for o in os], dtype=np.int32)
        for (walk, _), table_ in window_keys(flat, starts, [c]):
            for j, k in enumerate(table_):
                order = np.argsort(k, kind="stable")
                seen = np.zeros(1 << 16, dtype=bool)
                seen[(k >> np.uint64(48)).astype(np.int64)] = True
                keys[walk, c, j] = (k[order], owner[order], offset[order], seen)
    return Index(ids, words, sorted(groups), keys)


def _places(found: set[tuple[int, int, int]], index: Index, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first place, last place) of the hits: places of an item no further apart than its allowed distance are looked at together."""
    head = None
    for d, item, at in sorted(found):
        if head is not None and head[:2] == (d, item) and at - head[2] <= len(index.words[item]) * (100 - percent) // 100:
            last = at
            continue
        if head is not None:
            yield (*head, last)
        head, last = (d, item, at), at
    if head is not None:
        yield (*head, last)


def matches_in(h: np.ndarray, first: np.ndarray, index: Index, percent: int) -> Iterator[tuple[int, int, int]]:
    """(document, item, distance) of documents whose words are h[first[i]:first[i + 1]] and that hold an item within its allowed distance."""
    n = len(first) - 1
    if not len(h) or not index.classes:
        return
    doc = np.repeat(np.arange(n), np.diff(first))
    within = np.arange(len(h)) - first[doc]
    sparse, every = np.flatnonzero(within % STRIDE == 0), np.arange(len(h))
    short, long = [c for c in index.classes if c < SHORT], [c for c in index.classes if c >= SHORT]
    found: set[tuple[int, int, int]] = set()
    tables = chain(((x, sparse) for x in (window_keys(h, sparse, long) if long else ())), ((x, every) for x in (window_keys(h, every, short) if short else ())))
    for ((walk, c), table_), starts in tables:
        for j, k in enumerate(table_):
            keys, owner, offset, seen = index.keys[walk, c, j]
            some = np.flatnonzero(seen[(k >> np.uint64(48)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, k[some], "left"), np.searchsorted(keys, k[some], "right")
            hit = hi > lo
            for s, a, b in zip(some[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                at = int(starts[s])
                found.update((int(doc[at]), int(owner[x]), at - int(offset[x])) for x in range(a, b))
    best: dict[tuple[int, int], int] = {}
    tried: dict[tuple[int, int], set[bytes]] = defaultdict(set)
    lists = {item: index.words[item].tolist() for item in {x[1] for x in found}}
    for d, item, at, last in _places(found, index, percent):
        w = index.words[item]
        allowed = len(w) * (100 - percent) // 100
        lo, hi = max(int(first[d]), at - allowed), min(int(first[d + 1]), last + len(w) + allowed)
        if best.get((d, item)) == 0 or (same := h[lo:hi].tobytes()) in tried[d, item]:
            continue
        tried[d, item].add(same)
        around = h[lo:hi].tolist()
        held = set(around)
        if sum(x in held for x in lists[item]) < len(w) - allowed:      # every word that is not there costs an edit
            continue
        distance = best_distance(lists[item], around)
        if distance <= allowed and distance < best.get((d, item), allowed + 1):
            best[d, item] = distance
    for (d, item), distance in best.items():
        yield d, item, distance


def _blocks(docs: DataFrame, items: DataFrame, block_chars: int) -> Iterator:
    """Broadcast indexes of the items, about block_chars characters in each, so that what is broadcast is bounded."""
    items = items.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).select("item_id", "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        yield docs.sparkSession.sparkContext.broadcast(index_items(part.column(0).to_pylist(), part.column(1).to_pylist()))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75, block_chars: int = 8_000_000) -> DataFrame:
    """Pairs (doc_id, item_id, distance, item_words) of documents that hold a run of words within (100 - percent) % of an item's words of it, by word edits (case of A-Z aside).

    Items (item_id, text) are taken in blocks, each against all documents in one pass. Every document word belongs to windows; keys are made of SAMPLED of a walk's
    steps, in WALKS x TABLES tables, of segments over an item's whole length. Of items with a quarter of their words edited 97 % are found (tests/llm), of less edited ones more, of copies all.
    Null or empty texts and items match nothing; repeated rows are found alike; a null doc_id comes out as null; other columns are ignored; no rows give no rows."""
    out = None
    for held in _blocks(docs, items, block_chars):
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in _pieces(batches):
                ids = batch.column(0).to_pylist()
                got = list(matches_in(*word_hashes(batch.column(1)), index, percent))
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _, _ in got], pa.int64()), pa.array([index.ids[i] for _, i, _ in got], pa.int64()), pa.array([x for _, _, x in got], pa.int64()),
                                                  pa.array([len(index.words[i]) for _, i, _ in got], pa.int64())], ["doc_id", "item_id", "distance", "item_words"])

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance long, item_words long")
        out = found if out is None else out.union(found)
    return out


def without_items(docs: DataFrame, items: DataFrame, percent: int = 75, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs (all columns) that hold no item, as `contaminated` finds them; rows go block by block through the items and are never shuffled."""
    place = docs.columns.index("text")
    for held in _blocks(docs, items, block_chars):
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[d for d, _, _ in matches_in(*word_hashes(batch.column(place)), held.value, percent)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
