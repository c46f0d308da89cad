import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from statweave.llm import runs

WORD = re.compile(r"[^ \t-\r]+")


def brute(w, ratio=4, least=6):
    """(start, length, period) of every run, by start and period: every period is tried at every place."""
    found = {}
    for q in range(1, len(w) // ratio + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, ratio * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng):
    w = []
    while rng.random() < 0.8:
        if rng.random() < 0.5:
            block = [rng.randint(0, rng.choice([1, 2, 3, 9])) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 40]))]
            n = len(block) * rng.choice([1, 3, 4, 5, 9])
            w += (block * 9)[:max(1, n - rng.randint(0, len(block)))]
        else:
            w += [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
    return w


def test_find_runs_as_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        texts = [periodic(rng) for _ in range(rng.randint(1, 5))]
        first = np.cumsum([0] + [len(t) for t in texts])
        for ratio, least in ((4, 6), (2, 2), (3, 10)):
            got = runs.find_runs(np.array([x for t in texts for x in t], np.int64), first, ratio, least)
            assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, t in enumerate(texts) for r in brute(t, ratio, least)]


def test_extensions_as_compared_word_by_word():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 40):
        w = np.concatenate([np.tile(rng.integers(0, letters, 90), 6), rng.integers(0, letters, 300), [-1]])
        lce = runs.CoverLce(w)
        i, j = rng.integers(0, len(w), (2, 2000))
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        assert lce(i, j).tolist() == [next(t for t in range(len(w)) if w[a + t] != w[b + t]) for a, b in zip(i, j)]


def test_cover_reaches_every_pair_of_places():
    assert (runs._SHIFT < runs.MODULUS).all() and all((a + t) % 31 in runs.COVER and (b + t) % 31 in runs.COVER for a, row in enumerate(runs._SHIFT) for b, t in enumerate(row))


def test_periodic_runs_of_texts(spark, corpus, docs, no_docs):
    rows = [(i, t) for i, t in corpus] + [(500, "a b " * 9_000), (501, "x\x0bx x\tx x\nx x"), (502, "aéb " * 5 + "  " * 7), (503, "A a A a A a A a"), (504, "the end " + "na " * 6)]
    frame = spark.createDataFrame([(i, t, "mine", 3) for i, t in rows], "doc_id long, text string, runs string, n_words int").repartition(3)
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(frame).collect())
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        found = brute(w) if len(w) < 5_000 else {400: [], 402: [(0, 20_000, 1)], 500: [(0, 18_000, 2)]}[i]
        want[i, len(w), tuple(found), collapsed(w, found)] += 1
    assert got == want
    assert runs.periodic_runs(docs).columns == ["doc_id", "lang", "source", "n_chars", "score", "spans", "rep", "n_words", "runs", "collapsed"]
    assert runs.periodic_runs(no_docs).count() == 0


def test_query_as_plain_python(spark, corpus, tmp_path):
    rows = [r for r in corpus if r[1] is None or len(r[1]) < 5_000] + [(i, f"w{i} " + " ".join(f"t{k * i % 17}" for k in range(i % 90))) for i in range(1_000, 1_200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in runs.op12_cover_runs(spark, str(tmp_path)).collect())
    want, planted = Counter(), 0
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(("" if i is None else str(i)).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            planted += 1
        found = brute(w)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        line = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want[i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest()] += 1
    assert planted > 10 and got == want


def test_planted_periods_leave_other_texts(spark):
    rows = spark.createDataFrame([(i, f"a  b\tc {i} d e f") for i in range(300)], "doc_id long, text string")
    out = runs.with_planted_periods(rows).join(rows.withColumnRenamed("text", "old"), "doc_id").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    assert out.filter("h % 10 <> 0 AND text <> old").count() == 0 and out.filter("h % 10 = 0 AND text <> old").count() > 0
