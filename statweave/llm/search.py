"""Ranked lexical search: a max-sketch of every document bounds its score for a whole block of queries, and exact scores are made in descending order of bounds.

A document's impact of a term rises with the term's occurrences alone (its length is the document's), so the sketch keeps, at each hashed coordinate, the most occurrences
of any of its terms there; every term has two coordinates. The lesser of what a query's term finds at its two is never less than the truth; a document is scored exactly only while its bound reaches the k-th
best score so far."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructType

from statweave.llm.shared import cut, table, text_bytes, word_hashes

#: Terms are runs of ASCII letters and digits and of any character beyond ASCII.
_BREAKS = np.ones(256, dtype=bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: A sketch has at least eight coordinates per distinct term; the value MANY stands for that many occurrences or more, whose impact stays below MOST.
ROOM, MANY, MOST = 8, 255, 1_000_000
#: Bytes of text hashed together, and bounds held together in a task.
SLICE_BYTES, BOUNDS = 1 << 20, 1 << 21


def _places(terms: np.ndarray, size: int) -> np.ndarray:
    """The two coordinates of each term in a sketch of this size, a power of two."""
    return np.stack([terms & np.uint64(size - 1), (terms >> np.uint64(32)) & np.uint64(size - 1)]).astype(np.int64)


def _counted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms ascending, their occurrences, and the sketch."""
    terms, tf = np.unique(words, return_counts=True)
    size = 1 << max(6, (ROOM * len(terms) - 1).bit_length() if len(terms) else 0)
    sketch = np.zeros(size, np.uint8)
    rising = np.argsort(tf, kind="stable")                              # the last of equal coordinates is their maximum
    sketch[_places(terms[rising], size).T.ravel()] = np.repeat(np.minimum(tf[rising], MANY), 2)
    return terms, tf.astype("<u4"), sketch


def index_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id long, n long (terms with repeats), sketch (bytes), terms (ascending 64-bit hashes as bytes), tf (32-bit counts as bytes).

    The whole text is read; null and empty texts have no terms; repeated rows and null ids are rows of their own. Nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ends = text_bytes(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_BYTES, side="right")) - 1)
                words, first = word_hashes(batch.column(1).slice(i, j - i), breaks=_BREAKS)
                rows = [_counted(words[a:b]) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (2, 0, 1))],
                                                 ["doc_id", "n", "sketch", "terms", "tf"])
                i = j
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, sketch binary, terms binary, tf binary")


def _frequencies(index: DataFrame, asked: np.ndarray) -> np.ndarray:
    """In how many documents each of these ascending terms occurs."""
    near = np.zeros(1 << 20, bool)
    near[(asked & np.uint64(len(near) - 1)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(asked), np.int64)
        for batch in batches:
            raw, _ = _values(batch.column(0))
            terms = raw.view("<u8")
            terms = terms[near[(terms & np.uint64(len(near) - 1)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(asked, terms), len(asked) - 1)
            count += np.bincount(at[asked[at] == terms], minlength=len(asked))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], ["term", "df"])
    df = np.zeros(len(asked), np.int64)
    for row in index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).toLocalIterator():
        df[row[0]] = row[1]
    return df


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], "<i8")[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return np.ascontiguousarray(raw), ends - ends[0]


class _Best:
    """The k best (score, doc) of one query so far; documents without an id come after all others."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a document must reach."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        on = score > 0
        score, doc, known = np.concatenate([self.score, score[on]]), np.concatenate([self.doc, doc[on]]), np.concatenate([self.known, known[on]])
        order = np.lexsort((doc, ~known, -score))[:self.k]
        self.score, self.doc, self.known = score[order], doc[order], known[order]


def _search(index: DataFrame, queries: list[np.ndarray], k: int) -> DataFrame:
    """query (its number), doc_id, score: the k best documents of each partition of the index for each of these arrays of distinct terms."""
    asked = np.unique(np.concatenate(queries))
    df = _frequencies(index, asked)
    total = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    docs, length = int(total[0]), max(int(total[1]), 1)
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)     # a term of no document adds nothing
    lists = [np.searchsorted(asked, q) for q in queries]
    starts = np.cumsum([0] + [len(q) for q in lists])[:-1]
    flat = np.concatenate(lists)
    count = np.arange(MANY + 1, dtype=np.int64)
    places: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in lists]
        for whole in batches:
            rows = max(1, BOUNDS // len(lists))
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                known = np.asarray(batch.column(0).is_valid())
                doc = np.asarray(batch.column(0).fill_null(0))
                norm = 20 * (50 + 50 * np.asarray(batch.column(1)) * docs // length)
                (sketch, s), (terms, t), (tf, _) = (_values(batch.column(i)) for i in (2, 3, 4))
                terms, tf, t = terms.view("<u8"), tf.view("<u4"), t // 8
                bound = np.empty((len(lists), batch.num_rows), np.int64)
                for d in range(batch.num_rows):
                    impact = 1_000_000_000 * count // (1000 * count + norm[d])
                    impact[MANY] = MOST
                    mine = sketch[s[d]:s[d + 1]]
                    if len(mine) not in places:
                        places[len(mine)] = _places(asked, len(mine))
                    one, two = places[len(mine)]
                    bound[:, d] = np.add.reduceat((impact[np.minimum(mine[one], mine[two])] * weight)[flat], starts)
                for q, top in enumerate(best):
                    on = np.flatnonzero(bound[q] >= top.least())
                    on = on[np.argsort(-bound[q, on], kind="stable")]
                    at = 0
                    while at < len(on) and bound[q, on[at]] >= top.least():
                        some = on[at:at + max(8, k // 2)]
                        some = some[bound[q, some] >= top.least()]
                        score = np.zeros(len(some), np.int64)
                        for x, d in enumerate(some):
                            mine = terms[t[d]:t[d + 1]]
                            place = np.minimum(np.searchsorted(mine, asked[lists[q]]), len(mine) - 1)
                            hit = mine[place] == asked[lists[q]]
                            f = tf[t[d] + place[hit]].astype(np.int64)
                            score[x] = np.sum(weight[lists[q][hit]] * (1_000_000_000 * f // (1000 * f + norm[d])))
                        top.add(score, doc[some], known[some])
                        at += len(some)
        for q, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.score), q)), pa.array(top.doc, mask=~top.known), pa.array(top.score)], ["query", "doc_id", "score"])
    return index.select("doc_id", "n", "sketch", "terms", "tf").mapInArrow(run, "query long, doc_id long, score long")


def rank_documents(index: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """The k best documents of an index (as `index_documents` gives, written) for every item: item_id, rank, doc_id, score, scores above 0 only, equal scores by doc_id, rows
    without an id last.

    Items equal in id and text are one; an id with several texts is ranked once for each. Items whose text is null, empty or without terms have no rows, as is the case without documents.
    Items are asked in blocks of about block_bytes of text (at least one whole item), which is what a task and the driver hold of them; the index is read twice a block."""
    spark = index.sparkSession
    asked = cut(items.select(F.col(item_id), F.col(text).cast("string").alias("text")).where(F.col(text).isNotNull()).distinct())
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    kind = asked.schema[0].dataType
    schema = StructType().add("item_id", kind).add("query", LongType()).add("doc_id", LongType()).add("score", LongType())
    best, found = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()), []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64(*asked.columns), F.lit(blocks)) == b).collect()
        words, first = word_hashes(pa.array([r[1] for r in rows], pa.string()), breaks=_BREAKS)
        queries = [(r[0], np.unique(words[i:j])) for r, i, j in zip(rows, first, first[1:]) if j > i]
        if not queries:
            continue
        ids = pa.array([q[0] for q in queries], to_arrow_type(kind))

        def name(batches: Iterator[pa.RecordBatch], ids: pa.Array = ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([ids.take(batch.column(0)), *batch.columns], ["item_id", "query", "doc_id", "score"])
        found.append(_search(index, [q[1] for q in queries], k).mapInArrow(name, schema).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
    out = spark.createDataFrame([], schema.add("rank", "integer"))
    for part in (found if len(found) < 2 else map(cut, found)):
        out = out.union(part)
    return out.select("item_id", "rank", "doc_id", "score")


def op11_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(cut(index_documents(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format('text')} AS ts FROM documents WHERE text IS NOT NULL),
z AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, CAST(sum(len(ts)) AS BIGINT) AS len_all FROM d),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, z GROUP BY term, docs),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS.format('text')} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
t AS (SELECT DISTINCT q, item_id, term FROM (SELECT q, item_id, unnest(ts) AS term FROM i)),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * docs) // len_all AS m FROM d, z WHERE len(ts) > 0),
s AS (SELECT q, item_id, f.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM t JOIN f USING (term) JOIN w USING (term) JOIN m ON m.r = f.r GROUP BY q, item_id, f.r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
