"""Brown class-based bigrams: exchange clustering of words, class transitions, word emissions, and scores of whole texts."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm.shared import crc_of_id, cut, table, word_hashes

#: Fixed classes of the words that are not clustered, unknown or rare: (kind of the last byte) x (length).
SHAPES = 20
_KIND = np.full(256, 3, dtype=np.int64)                              # other marks
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0       # letters and bytes of longer characters
_KIND[list(b".!?")] = 1
_KIND[list(b",;:")] = 2
_KIND[list(b"0123456789")] = 4
#: A count of neighbours of one class, by its place.
_CELL = np.dtype([("place", "<u2"), ("count", "u1")])


def _words(batch: pa.RecordBatch, column: int):
    """Word hashes of a text column with their documents' bounds and the words' shapes."""
    from statweave.llm.shared import text_bytes
    h, first, begin, end = word_hashes(batch.column(column), spans=True)
    raw, _ = text_bytes(batch.column(column))
    size = end - begin
    shape = _KIND[raw[end - 1]] * 4 + (size > 4) + (size > 8) + (size > 16) if len(h) else np.zeros(0, np.int64)
    return h, first, shape


def _ids(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of hashes in the ascending array known, -1 where they are not in it."""
    if not len(known):
        return np.full(len(h), -1, dtype=np.int64)
    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[k] == h, k, -1)


def token_counts(docs: DataFrame) -> DataFrame:
    """h (64-bit hash), shape and c, the count, of every word of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                h, _, shape = _words(whole.slice(at, 2_000), 0)
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(shape[first].astype(np.int32)), pa.array(c)], ["h", "shape", "c"])

    return docs.select("text").mapInArrow(run, "h long, shape int, c long").groupBy("h").agg(F.max("shape").alias("shape"), F.sum("c").alias("c"))


def encoded(docs: DataFrame, clustered: np.ndarray) -> DataFrame:
    """The items of every document (binary, 32-bit integers), written once and read by every pass over the corpus.

    Items: the clustered words (ascending hashes), then the shapes of all others, then the end, which also stands before a text."""
    held = docs.sparkSession.sparkContext.broadcast(clustered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clustered = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                cur, _, bounds = _items(*_words(whole.slice(at, 2_000), 0), clustered)
                parts = [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(cur.astype("<i4"))]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(bounds) - 1, parts)], ["items"])

    return cut(docs.select("text").mapInArrow(run, "items binary"))


def _pairs(whole: pa.RecordBatch, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item, item before it) of all tokens of encoded documents, some documents together."""
    for at in range(0, whole.num_rows, 2_000):
        part = whole.column(0).slice(at, 2_000).cast(pa.large_binary())
        edge = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset:part.offset + len(part) + 1]
        cur = np.frombuffer(part.buffers()[2], dtype="<i4", count=(edge[-1] - edge[0]) // 4, offset=edge[0]).astype(np.int64)
        yield cur, np.concatenate([[end], cur[:-1]])


def bigram_counts(items: DataFrame, places: np.ndarray) -> np.ndarray:
    """Counts of (place, place before) over all encoded documents, where places gives each item's place, the end's last."""
    m, end = int(places.max()) + 1, len(places) - 1
    held = items.sparkSession.sparkContext.broadcast(places.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = held.value
        total = np.zeros(m * m, np.int64)
        for batch in batches:
            for cur, prev in _pairs(batch, end):
                pair = places[prev].astype(np.int64) * m + places[cur]
                if len(pair) * 4 > m * m:
                    total += np.bincount(pair, minlength=m * m)
                else:
                    pair, c = np.unique(pair, return_counts=True)
                    total[pair] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "c"])

    table_ = np.zeros(m * m, np.int64)
    pairs = items.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()      # at most m * m rows
    table_[np.asarray(pairs.column("pair"))] = np.asarray(pairs.column("c"))
    return table_.reshape(m, m)


def neighbour_counts(items: DataFrame, clustered: np.ndarray, classes: np.ndarray, chosen: np.ndarray, most: int = 4_000_000) -> DataFrame:
    """h and cells (binaries of _CELL) of every chosen word (a bool for each clustered one): how often each class stands before it (places from 0) and behind it (from the number of classes);
    of a word there are as many cells as parts of the corpus hold it, and a count beyond 255 is spread over several cells of one place."""
    k = int(classes.max()) + 1
    if 2 * k > 1 << 16:
        raise ValueError("at most 32,768 classes")
    held = items.sparkSession.sparkContext.broadcast((clustered, classes.astype(np.int32), chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clustered, classes, chosen = held.value
        wanted = np.append(chosen, np.zeros(SHAPES + 1, dtype=bool))
        keys, counts, held_rows = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)

        def lists(key: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            times = -(-c // 255)
            key = np.repeat(key, times)
            cells = np.full(len(key), 255, dtype=_CELL)
            cells["place"] = key % (2 * k)
            cells["count"][np.cumsum(times) - 1] = c - 255 * (times - 1)
            word = key // (2 * k)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            parts = [None, pa.py_buffer((np.append(first, len(word)) * _CELL.itemsize).astype(np.int32)), pa.py_buffer(cells.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array(clustered[word[first]].view(np.int64)), pa.Array.from_buffers(pa.binary(), len(first), parts)], ["h", "cells"])

        for batch in batches:
            for cur, prev in _pairs(batch, len(wanted) - 1):
                behind, before = wanted[prev], wanted[cur]
                key, c = np.unique(np.concatenate([cur[before] * (2 * k) + classes[prev[before]], prev[behind] * (2 * k) + k + classes[cur[behind]]]), return_counts=True)
                keys.append(key)
                counts.append(c)
                held_rows += len(key)
                if held_rows > most:
                    key, c = merged()
                    keys, counts, held_rows = [key], [c], len(key)
                    if held_rows > most // 2:
                        yield from lists(key, c)
                        keys, counts, held_rows = [], [], 0
        if keys:
            yield from lists(*merged())

    # a part seldom gives a word twice: its cells move as they are and are listed behind the shuffle
    return items.mapInArrow(run, "h long, cells binary").repartition("h").groupBy("h").agg(F.collect_list("cells").alias("cells"))


def best_classes(found: DataFrame, t: np.ndarray, classes: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, classes): for each word of neighbour_counts that of the first `classes` classes in which the bigram likelihood of its neighbours, by the class table t, and its own share are largest."""
    k = len(t)
    log = np.log((t + prior * (t.sum(0) + 1) / (t.sum() + k)) / (t.sum(1, keepdims=True) + prior))
    held = found.sparkSession.sparkContext.broadcast((np.concatenate([log[:, :classes], log[:classes].T]), np.log(t.sum(0)[:classes] + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, size = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                m = np.zeros((batch.num_rows, 2 * k))
                for i, parts in enumerate(batch.column(1)):
                    cells = np.frombuffer(b"".join(parts.as_py()), dtype=_CELL)
                    m[i] = np.bincount(cells["place"], weights=cells["count"], minlength=2 * k)
                best = (m @ gain - m.sum(1, keepdims=True) / 2 * size).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32))], ["h", "cls"])

    got = found.mapInArrow(run, "h long, cls int").toArrow()
    return np.asarray(got.column("h"), dtype=np.int64).view(np.uint64), np.asarray(got.column("cls"), dtype=np.int64)


def _items(h: np.ndarray, first: np.ndarray, shape: np.ndarray, clustered: np.ndarray):
    """(item, item before it, document's bounds) of all tokens, each document's end among them."""
    n = len(first) - 1
    end = len(clustered) + SHAPES
    k = _ids(h, clustered)
    item = np.where(k >= 0, k, len(clustered) + shape)
    cur = np.full(len(h) + n, end, dtype=np.int64)
    cur[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))] = item
    prev = np.concatenate([[end], cur[:-1]]) if len(cur) else cur
    return cur, prev, first + np.arange(n + 1)


def exchange_classes(counts: np.ndarray, words: int, classes: int, sweeps: int = 8) -> np.ndarray:
    """Classes of the items of a bigram table: the first `words` items are exchanged among `classes` classes as long as the bigram likelihood
    sum f(T) - sum f(rows) - sum f(columns), f(x) = x log x, of the class table T grows; each other item has a class of its own."""
    m = len(counts)
    b = counts.astype(np.float64)
    weight = b[:words].sum(1) + b[:, :words].sum(0)
    cls = np.empty(m, dtype=np.int64)
    order = np.argsort(-weight, kind="stable")
    cls[order] = np.arange(words) % classes
    cls[words:] = classes + np.arange(m - words)
    k = classes + m - words
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    hot = np.zeros((m, k))
    hot[np.arange(m), cls] = 1
    right, left = b @ hot, b.T @ hot
    t = hot.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a = cls[w]
            own = b[w, w]
            r, s = right[w].copy(), left[w].copy()
            r[a] -= own
            s[a] -= own
            t[a] -= r
            t[:, a] -= s
            t[a, a] -= own
            rows, cols = t.sum(1), t.sum(0)
            x, y = f(t + r) - f(t), f(t + s[:, None]) - f(t)
            d = np.diagonal(t)
            gain = (x.sum(1) - np.diagonal(x) + y.sum(0) - np.diagonal(y) + f(d + r + s + own) - f(d)
                    - f(rows + r.sum() + own) + f(rows) - f(cols + s.sum() + own) + f(cols))[:classes]
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            t[best] += r
            t[:, best] += s
            t[best, best] += own
            if best != a:
                moved += 1
                cls[w] = best
                right[:, a] -= b[:, w]
                right[:, best] += b[:, w]
                left[:, a] -= b[w]
                left[:, best] += b[w]
        if not moved:
            break
    return cls


@dataclass
class ClassModel:
    """What scoring needs: sizes bounded by the parameters of fit, but for `counts`, a table of all words, and the words' classes."""
    counts: DataFrame                      # h, shape, c, cls (null: that of the shape)
    frequent: np.ndarray                   # ascending hashes, at most `frequent` of them
    frequent_counts: np.ndarray
    frequent_emission: np.ndarray          # log10 P(word | class)
    clustered: np.ndarray                  # ascending hashes of all words with a class, which grow as the vocabulary does
    classes: np.ndarray                    # of the items
    transition: np.ndarray                 # log10 P(class | class before)
    class_total: np.ndarray                # tokens by class
    shape_total: np.ndarray                # tokens of the words that are not clustered, by shape
    shape_types: np.ndarray
    discount: float
    train_tokens: int
    vocabulary: int
    ends: int


def fit(train: DataFrame, clustered: int = 1_024, classes: int | None = None, frequent: int = 1 << 18, prior: float = 5.0, least: int = 5, sweeps: int = 2) -> ClassModel:
    """Counts and classes from all rows of `train` (text; null: empty).

    The `clustered` most frequent words are exchanged among the classes on the driver, from their bigram table, which is bounded by the parameters. All other words seen `least` times or more are then
    exchanged in Spark, `sweeps` times: each goes to its best class by the counts of its neighbours' classes and the table of class bigrams. The number of classes follows these words' number,
    2 times its cube root, at least 32, where it is not given. Rarer words and unknown ones belong to the class of their shape. Hashes and classes of the words that have one are broadcast;
    of the most frequent words, at most `frequent`, the counts are too, those of all others stay in a table.
    Within a shape every known word's count loses a discount d = n1 / (n1 + 2 n2) (words seen once, twice), which is what an unknown word gets."""
    counts = cut(token_counts(train))
    rows = train.count()
    total, types, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    # a count that at most `frequent` words reach, from classes of counts a sixteenth of an octave wide
    octave = F.floor(F.log2("c") * 16)
    bottom, held = None, 0
    for r in sorted(counts.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.o):
        if (held := held + r.n) > frequent:
            break
        bottom = r.o
    top = counts.filter(octave >= bottom if bottom is not None else F.lit(False)).toArrow()          # at most `frequent` rows
    h = np.asarray(top.column("h"), dtype=np.int64).view(np.uint64)
    c, shape = np.asarray(top.column("c"), dtype=np.int64), np.asarray(top.column("shape"), dtype=np.int64)
    order = np.lexsort((h, -c))
    h, c, shape = h[order], c[order], shape[order]
    head = np.sort(np.asarray(counts.orderBy(F.desc("c"), "h").limit(clustered).select("h").toArrow().column("h"), dtype=np.int64).view(np.uint64))
    shapes = counts.filter(F.col("c") >= least).select("h", "shape").toArrow()
    often = np.asarray(shapes.column("h"), dtype=np.int64).view(np.uint64)
    members = np.union1d(head, often)
    if classes is None:
        classes = max(32, round(2 * len(members) ** (1 / 3)))
    items = encoded(train, members)
    # for the first table the words that are not in the head count as their shapes, items from len(members) on as themselves
    shape_of = np.zeros(len(members), np.int64)
    shape_of[_ids(often, members)] = np.asarray(shapes.column("shape"), dtype=np.int64)
    spot = _ids(members, head)
    table_ = bigram_counts(items, np.concatenate([np.where(spot >= 0, spot, len(head) + shape_of), len(head) + np.arange(SHAPES + 1)]))
    first = exchange_classes(table_, len(head), classes)
    k = classes + SHAPES + 1
    t = np.zeros((k, k))
    np.add.at(t, (first[:, None], first[None, :]), table_)
    open_ = ~np.isin(members, head)
    if open_.any():
        known, cls = head, first
        for _ in range(sweeps):
            # before its first sweep a word counts as its shape where it is a neighbour
            start = cls if len(known) == len(members) else np.concatenate([np.zeros(len(members), np.int64), classes + np.arange(SHAPES + 1)])
            if len(known) < len(members):
                start[:len(members)] = np.where(open_, classes + shape_of, 0)
                start[np.searchsorted(members, head)] = first[:len(head)]
            word, best = best_classes(neighbour_counts(items, members, start, open_), t, classes, prior)
            known, cls = members, start.copy()
            cls[np.searchsorted(members, word)] = best
            t = bigram_counts(items, cls).astype(np.float64)
    else:
        cls = first
    share = (t.sum(0) + 1) / (t.sum() + k)
    transition = np.log10((t + prior * share) / (t.sum(1, keepdims=True) + prior))
    class_total = t.sum(0)
    assigned = pa.table({"h": pa.array(members.view(np.int64)), "cls": pa.array(cls[:len(members)].astype(np.int32))})
    counts = cut(counts.join(train.sparkSession.createDataFrame(assigned, "h long, cls int"), "h", "left"))
    d = once / (once + 2 * twice) if once else 0.5
    by_shape = counts.filter(F.col("cls").isNull()).groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    shape_total, shape_types = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in by_shape:
        shape_total[r.shape], shape_types[r.shape] = r.c, r.n
    inside = np.isin(h, members)
    emission = np.where(inside, np.log10(c / np.maximum(class_total[cls[np.searchsorted(members, h) % max(1, len(members))]], 1)) if len(h) else 0.0, 0.0)
    emission[~inside] = np.log10(np.maximum(c[~inside] - d, 1e-9) / np.maximum(shape_total[shape[~inside]], 1))
    order = np.argsort(h)
    return ClassModel(counts, h[order], c[order], emission[order], members, cls, transition, class_total, shape_total, shape_types, d, int(total) + rows, int(types) + (rows > 0), rows)


def score(docs: DataFrame, model: ClassModel, keep: list[str]) -> DataFrame:
    """The columns in keep, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every whole text (null: empty), its end counted as a token.

    Words beyond the frequent ones are rows (document, word, count) that meet the table of counts in a join and sum up to their documents again."""
    m = model
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((m.frequent, m.frequent_counts, m.frequent_emission, m.clustered, m.classes, m.transition))
    size = m.train_tokens + m.vocabulary + 1.0
    ends = m.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, emission, clustered, classes, transition = held.value
        base_of, emission = np.append(np.log10((counts + 1) / size), 0.0), np.append(emission, 0.0)      # the last for words that are not frequent
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                h, first, shape = _words(batch, 1)
                cur, prev, bounds = _items(h, first, shape, clustered)
                n = len(first) - 1
                add = lambda values, edges: np.diff(np.concatenate([[0.0], np.cumsum(values)])[edges])
                moves = add(transition[classes[prev], classes[cur]], bounds)
                f = _ids(h, frequent)
                hit = f >= 0
                base = add(base_of[f], first)
                emit = add(emission[f], first)
                known = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
                doc = np.repeat(np.arange(n), np.diff(first))[~hit]
                rest, kind = h[~hit], shape[~hit]
                order = np.lexsort((rest, doc))
                doc, rest, kind = doc[order], rest[order], kind[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1])
                spot = np.flatnonzero(new)
                times = np.diff(np.append(spot, len(doc)))
                cuts = np.searchsorted(doc[spot], np.arange(n + 1)).astype(np.int32)
                parts = [pa.array(rest[spot].view(np.int64)), pa.array(times.astype(np.int32)), pa.array(kind[spot].astype(np.int32))]
                rare = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(parts, ["h", "n", "shape"]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first) + 1), pa.array(known + (ends > 0)), pa.array(base + np.log10((ends + 1) / size)), pa.array(moves + emit), rare],
                                                 ["row", "n_tokens", "known", "base", "model", "rare"])

    numbered = docs.select(*keep, "text").withColumn("row", F.monotonically_increasing_id())
    scored = numbered.select(F.struct("row", *keep).alias("row"), "text").mapInArrow(run, _schema(numbered, keep))
    scored = cut(scored)
    rare = scored.select(F.col("row.row").alias("id"), F.explode("rare").alias("r")).select("id", "r.*")
    stats = docs.sparkSession.createDataFrame([(s, float(a), float(b)) for s, (a, b) in enumerate(zip(m.shape_total, m.shape_types))], "shape int, total double, types double")
    sizes = docs.sparkSession.createDataFrame([(k, float(n)) for k, n in enumerate(m.class_total)], "cls int, size double")
    found = rare.join(m.counts.select("h", "c", "cls"), "h", "left").join(F.broadcast(stats), "shape").join(F.broadcast(sizes), "cls", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    chance = F.when(F.col("cls").isNotNull(), c / F.col("size")).when(c > 0, (c - m.discount) / F.col("total")).when(F.col("total") > 0, m.discount * F.col("types") / F.col("total")).otherwise(F.lit(1.0))
    sums = found.groupBy("id").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known2"), F.sum(F.col("n") * F.log10((c + 1.0) / size)).alias("base2"), F.sum(F.col("n") * F.log10(chance)).alias("model2"))
    whole = scored.select(F.col("row.row").alias("id"), *[F.col(f"row.{x}").alias(x) for x in keep], "n_tokens", "known", "base", "model").join(sums, "id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return whole.select(*keep, F.col("n_tokens"), (F.col("known") + zero("known2")).cast("long").alias("n_known"), F.lit(m.train_tokens).cast("long").alias("train_tokens"),
                        (F.col("base") + zero("base2")).alias("base_score"), (F.col("model") + zero("model2")).alias("score"))


def _schema(docs: DataFrame, keep: list[str]) -> str:
    kinds = dict(docs.dtypes)
    return f"row struct<row: bigint, {', '.join(f'{x}: {kinds[x]}' for x in keep)}>, n_tokens long, known long, base double, model double, rare array<struct<h: bigint, n: int, shape: int>>"


def op4_brown_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_of_id(F.col("doc_id")) % 7 == 2).alias("held_out"))
    return score(docs, fit(docs.filter("NOT held_out")), ["doc_id", "held_out"])
