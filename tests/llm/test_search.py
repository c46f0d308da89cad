import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from statweave.llm import search
from statweave.llm.shared import cut

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """Counter of (item, rank, doc, score)."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    total, words = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in set(items):
        scored = []
        for i, b in bags:
            n = sum(b.values())
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * (50 + 50 * n * total // words))) for t in set(terms(text)) if b[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for r, (s, none, i) in enumerate(sorted(scored)[:k]):
            out[item, r + 1, None if none else i, -s] += 1
    return out


def frames(spark, docs, items):
    index = cut(search.index_documents(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, n int").repartition(3)))
    return index, spark.createDataFrame([(*r, 0.5) for r in items], "item_id string, text string, score double")


def test_ranking_as_brute_force(spark, corpus):
    rng = random.Random(4)
    docs = corpus + [(600 + i, corpus[i % 60][1]) for i in range(40)] + [(700, "Ünï-çode ÜNÏ 12a_b É"), (701, "rare " * 300 + "tail"), (None, corpus[2][1])]
    items = [(f"i{n}", " ".join(rng.choice((corpus[rng.randrange(60)][1] or "x").split()) for _ in range(rng.choice([1, 4, 30])))) for n in range(25)]
    items += [("same", "ran tel"), ("same", "ran tel"), ("same", "vor dun"), (None, corpus[3][1]), ("null", None), ("empty", ""), ("none", "-- !!"), ("absent", "qqqqq"), ("case", "RARE çode ünï"), ("long", corpus[40][1] * 3)]
    index, asked = frames(spark, docs, items)
    for k, size in ((50, 1 << 20), (3, 400), (1_000, 1 << 20)):
        got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in search.rank_documents(index, asked, k=k, block_bytes=size).collect())
        assert got == brute(docs, [(i, t) for i, t in items if t is not None], k), (k, size)


def test_empty_sides(spark):
    index, asked = frames(spark, [(1, "a b"), (2, None), (3, "")], [("i", "a")])
    assert [tuple(r)[:3] for r in search.rank_documents(index, asked).collect()] == [("i", 1, 1)]
    assert search.rank_documents(index.filter("false"), asked).count() == 0 and search.rank_documents(index.filter("doc_id > 1"), asked).count() == 0
    out = search.rank_documents(index, asked.filter("false"))
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_sketch_is_never_below_a_term(corpus):
    for _, text in corpus:
        words, first = search.word_hashes(pa.array([text], pa.string()), breaks=search._BREAKS)
        found, tf, sketch = search._counted(words)
        assert (sketch[search._places(found, len(sketch))] >= np.minimum(tf, search.MANY)).all()
        assert len(sketch) >= search.ROOM * len(found) and len(words) == len(terms(text)) == tf.sum()


def test_few_documents_are_scored_exactly(spark, monkeypatch):
    """Bounds order the work: an item whose passage is in few documents leads to few exact scores."""
    rng = np.random.default_rng(1)
    docs = pa.table({"doc_id": np.arange(3_000), "text": [" ".join(f"w{x}" for x in rng.integers(0, 5_000, 60)) for _ in range(3_000)]}).to_pandas()
    index = cut(search.index_documents(spark.createDataFrame(docs).coalesce(1)))
    rows = index.collect()
    item = docs.text[7].split()[:30]
    words, _ = search.word_hashes(pa.array([" ".join(item)]), breaks=search._BREAKS)
    hit = [sum(np.frombuffer(r.sketch, np.uint8)[search._places(np.unique(words), len(r.sketch))].min(0) > 0) for r in rows]
    exact = [len(np.intersect1d(words, np.frombuffer(r.terms, "<u8"))) for r in rows]
    assert all(h >= e for h, e in zip(hit, exact)) and np.mean(np.array(hit) - exact) < 0.07 * 30
