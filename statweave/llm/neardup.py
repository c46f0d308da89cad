"""Near duplicates on word shingles: banded MinHash candidates, odd sketches to sift them, and exact similarity of the full sets."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm.components import connected_components
from statweave.llm.shared import cut, mix, shingles, table, word_hashes

#: Longs of an odd sketch (1,024 bits), and MinHash samples that it folds; the bands take the first of them.
SKETCH, SAMPLES = 16, 256


def _signatures(bands: int, rows: int, width: int):
    """A function of (sorted shingle hashes): MinHash values folded to band keys, and the odd sketch of all of them."""
    k = max(SAMPLES, bands * rows)
    rng = np.random.default_rng(6)
    mul = (rng.integers(0, 1 << 31, k, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    add = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    place = mix(np.arange(1, k + 1, dtype=np.uint64))
    band = mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(1 << 40))

    def of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for a in range(0, len(x), 2048):
            np.minimum(low, (x[a:a + 2048, None] * mul + add).min(axis=0), out=low)
        wide = low.astype(np.uint64)
        key = band.copy()
        for v in wide[:bands * rows].reshape(bands, rows).T:
            key = mix(key ^ v) + band
        # the parity bitmap: every sample (place, value) flips one bit
        flips = np.bincount((mix(wide + place) % np.uint64(64 * width)).astype(np.int64), minlength=64 * width) & 1
        return key.view(np.int64), np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8")

    return of


def sketch_table(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (shingles), set_key (equal for equal sets, null for none), band keys, odd sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _signatures(bands, rows, SKETCH)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                words, first = word_hashes(batch.column(1))
                n, key, keys, odd, none = [], [], [], [], np.zeros(bands, np.int64)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    s = shingles(words[a:b], size)
                    n.append(len(s))
                    key.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                    k, o = sign(s) if len(s) else (none, none[:SKETCH])
                    keys.append(k)
                    odd.append(o)
                lists = lambda x, w: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w), pa.array(np.concatenate(x)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), lists(keys, bands), lists(odd, SKETCH)], ["doc_id", "n", "set_key", "bands", "odd"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_key binary, bands array<long>, odd array<long>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, bits: int) -> DataFrame:
    """doc_id, set_key and sorted shingle hashes of the documents whose ids may be among `wanted` (rep). The ids pass a bitmap of 2**bits bits, a bounded size; false positives do no harm."""
    cell = F.pmod(F.xxhash64("rep"), F.lit(1 << bits))
    rows = wanted.select(F.floor(cell / 32768).alias("page"), (cell % 32768).cast("int").alias("bit")).groupBy("page").agg(F.call_function("bitmap_construct_agg", F.col("bit").cast("long")).alias("map")).collect()
    bitmap = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in rows:
        part = np.frombuffer(r.map, np.uint8)
        bitmap[r.page * 4096:r.page * 4096 + len(part)] = part
    packed = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = packed.value
        for whole in batches:
            c = np.asarray(whole.column(2))
            whole = whole.filter(pa.array((held[c >> 3] >> (c & 7)) & 1 == 1))
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                words, first = word_hashes(batch.column(1))
                sets = [shingles(words[a:b], size) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))], ["rep", "set_key", "hashes"])

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("cell")).mapInArrow(run, "rep long, set_key binary, hashes array<long>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives with the sizes of their sets' intersection (common) and union."""
    one = pairs.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("right")), "b")
    two = one.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("left")), "a")
    both = two.select("a", "b", (F.size("left") + F.size("right")).alias("total"), F.size(F.array_intersect("left", "right")).alias("common"))
    return both.select("a", "b", "common", (F.col("total") - F.col("common")).alias("union"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, slack: float = 0.14, block: int = 256, bits: int = 24) -> DataFrame:
    """Documents (doc_id, text) and the components of the links: 100 * |intersection| >= percent * |union| of the sets of `size`-word shingles.

    Equal sets collapse to the row with the smallest doc_id first. The others are candidates where they share a band of `rows` MinHash values in one of
    `bands` buckets (at a similarity of 0.75 a pair is missed with probability 5e-6). Each bucket's best connected member is its centre. A row is compared
    with the best of its centres first, then with those that are not in its component yet; bucket members that are still in different components are then
    compared with each other in cells of about `block` rows, on sketches and sets within the join, so that only links leave it. Odd sketches
    (parity bitmaps of SAMPLES MinHash values, compared by the population count of their XOR) drop pairs that they put `slack` or more below the threshold
    (more than four standard deviations), sizes drop pairs that can't reach it, and all others are confirmed on the full sets.

    Null or empty text, or no words: an empty set, linked with nothing. Rows with a null doc_id are linked with nothing and kept. Rows with the same doc_id
    are judged by their own texts. Other columns are ignored; no rows give no rows. Returns doc_id, n_shingles, component_id, kept."""
    sig = cut(sketch_table(docs, size, bands, rows))
    own = ["rep", "n", "odd"]
    classes = cut(sig.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "bands", "odd")).alias("m"))
                  .select("set_key", F.col("m.doc_id").alias("rep"), "m.n", "m.bands", "m.odd"))
    banded = classes.select(F.explode("bands").alias("key"), "rep")
    crowded = cut(banded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    members = cut(banded.join(crowded, "key").select("key", "rep", "members"))
    degree = cut(members.groupBy("rep").agg(F.sum("members").alias("degree")))
    known = cut(classes.select(*own, "set_key").join(degree, "rep", "left_semi"))
    ranked = members.join(degree, "rep").select("key", F.struct("degree", (-F.col("rep")).alias("minus")).alias("r"))
    centre = cut(ranked.groupBy("key").agg(F.max("r").alias("r")).select("key", (-F.col("r.minus")).alias("centre")))
    side = lambda name: known.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}"))
    flips = sum((F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(SKETCH)), F.lit(0))
    width, samples = 64 * SKETCH, max(SAMPLES, bands * rows)
    # popcount at which the estimate 1 + width / (4 * samples) * ln(1 - 2 * popcount / width) is the threshold less the slack
    most = int(width / 2 * (1 - np.exp(-(1 - (percent / 100 - slack)) * 4 * samples / width)))
    likely = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (flips <= most)

    sets = _shingle_sets(docs, degree.select("rep"), size, bits).join(known.select("rep", "set_key"), ["rep", "set_key"], "left_semi").dropDuplicates(["rep", "set_key"]).select("rep", "hashes")
    sets = cut(sets)
    stars = cut(members.join(centre, "key").filter("rep <> centre").select("centre", "rep").distinct().join(degree.select(F.col("rep").alias("centre"), "degree"), "centre"))
    first = cut(stars.groupBy("rep").agg(F.max(F.struct("degree", (-F.col("centre")).alias("minus"))).alias("r")).select((-F.col("r.minus")).alias("a"), F.col("rep").alias("b")))
    sift = lambda pairs: cut(pairs.join(side("b"), "b").join(side("a"), "a").filter(likely).select("a", "b"))
    links = lambda pairs: pairs.filter(F.col("common") * 100 >= F.col("union") * percent).select("a", "b")
    edges = cut(links(_compared(sift(first), sets)))
    labels = connected_components(edges)
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"component_{name}"))
    apart = stars.select(F.col("centre").alias("a"), F.col("rep").alias("b")).join(first.withColumnRenamed("a", "tested"), "b").filter("a <> tested").select("a", "b")
    apart = apart.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")
    second = sift(apart)
    if not second.isEmpty():
        edges = cut(edges.union(links(_compared(second, sets))))
        labels = connected_components(edges)

    placed = members.join(centre, "key").filter("rep <> centre").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key", "rep", "members", F.coalesce("component", "rep").alias("component"))
    placed = cut(placed)
    mixed = cut(placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key"))
    cells = F.greatest(F.lit(1), F.ceil(F.col("members") / block)).cast("int")
    full = known.select(*own, "set_key").join(sets, "rep")
    row = placed.join(mixed, "key", "left_semi").join(full, "rep").withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int"))
    spread = row.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(
        "key", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "rep", "component", "n", "odd", "hashes")
    named = lambda name: spread.select("key", "i", "j", *[F.col(x).alias(y) for x, y in (("rep", name), ("component", f"component_{name}"), ("n", f"n_{name}"), ("odd", f"odd_{name}"), ("hashes", f"set_{name}"))])
    common = F.size(F.array_intersect("set_a", "set_b"))
    linked = common * 100 >= (F.size("set_a") + F.size("set_b") - common) * percent
    more = cut(named("a").join(named("b"), ["key", "i", "j"]).filter((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & likely & linked).select("a", "b").distinct())
    if not more.isEmpty():
        labels = connected_components(edges.union(more))

    final = classes.select("set_key", "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n", "set_key", F.col("doc_id").isNull().alias("apart")).join(cut(final), "set_key", "left")
    component = F.when(~F.col("apart"), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op6_odd_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
