"""Toxicity by weak supervision: lexicon and pattern voters, a generative model of their accuracies and correlations, and a linear classifier of its posterior labels."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm.shared import crc_of_id, cut, mix, shingles, table, word_hashes

# A first lexicon of English insults; the lexicons of other voters are induced.
SEED = frozenset("asshole bastard bitch clown cretin disgusting dumb dumbass fool freak garbage hate idiot idiotic imbecile jerk kill loser moron moronic pathetic pig scum shit shut stupid sucker trash ugly "
                 "useless vermin weirdo worthless".split())
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"[A-ZÀ-Þ]{3,}")
_BANGS = re.compile(r"!{2,}")
#: Voters on a document, by place in a vote.
VOTERS = ("seed lexicon", "lexicon 0", "lexicon 1", "lexicon 2", "lexicon 3", "prefixes 0", "prefixes 1", "several words", "many words", "one word in a hundred", "one word in thirty", "shouting", "exclamations", "no word of any lexicon", "label")
WORD_LEXICONS, PREFIX_LEXICONS = 4, 2
#: How often the label voter is taken to be right where it votes; this anchors the classes, so it is not estimated.
TRUST = 1 - 1e-6
#: Numbers and shares of distinct words in any lexicon that make features.
_HITS, _RATES = (1, 2, 4, 8), (0.003, 0.01, 0.02, 0.03, 0.05)


def terms(word: str) -> tuple[str, ...]:
    """A word's terms: itself and its beginnings of four and five letters."""
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 5 else (word, word[:4] + "*") if len(word) > 4 else (word,)


@dataclass
class Lexicons:
    """Induced terms, a bounded number, with the voter (place in VOTERS) that owns each, and all terms of the classifier."""
    words: dict[str, int] = field(default_factory=dict)
    prefixes: dict[str, int] = field(default_factory=dict)
    features: dict[str, int] = field(default_factory=dict)


class Reader:
    """Votes and features of texts, with a memo of words; a full memo is emptied."""

    def __init__(self, lexicons: Lexicons, most: int = 120_000):
        self.lexicons, self.most = lexicons, most
        self._memo: dict[str, tuple[tuple[int, ...], int]] = {}

    def _look(self, word: str) -> tuple[tuple[int, ...], int]:
        """(features, the voters it moves as bits) of a word."""
        parts = terms(word)
        found = tuple(f for t in parts if (f := self.lexicons.features.get(t)) is not None)
        bits = word in SEED
        if (v := self.lexicons.words.get(word)) is not None:
            bits |= 1 << v
        for p in parts[1:]:
            if (v := self.lexicons.prefixes.get(p)) is not None:
                bits |= 1 << v
        if len(self._memo) >= self.most:
            self._memo.clear()
        self._memo[word] = out = (found, int(bits))
        return out

    def votes(self, text: str | None) -> list[int]:
        """Votes without the label's on a whole text; null counts as empty."""
        text = text or ""
        bits = hits = 0
        get = self._memo.get
        words = set(_WORD.findall(text.lower()))
        for word in words:
            moved = (get(word) or self._look(word))[1]
            if moved:
                bits |= moved
                hits += 1
        rate = hits / max(1, len(words))
        return [bits >> k & 1 for k in range(1 + WORD_LEXICONS + PREFIX_LEXICONS)] + [
            int(hits >= 2), int(hits >= 4), int(rate >= 0.01), int(rate >= 0.03), int(len(_SHOUT.findall(text)) >= 5), int(_BANGS.search(text) is not None), -int(hits == 0)]

    def features(self, text: str | None) -> list[int]:
        """Features of a whole text; null counts as empty."""
        hits = 0
        found: set[int] = set()
        get = self._memo.get
        words = set(_WORD.findall((text or "").lower()))
        for word in words:
            terms_, moved = get(word) or self._look(word)
            if terms_:
                found.update(terms_)
            if moved:
                hits += 1
        rate, n = hits / max(1, len(words)), len(self.lexicons.features)
        return sorted(found) + [n + k for k, least in enumerate(_HITS) if hits >= least] + [n + len(_HITS) + k for k, least in enumerate(_RATES) if rate >= least]

    def read(self, text: str | None) -> tuple[list[int], list[int]]:
        return self.votes(text), self.features(text)


def induce(sample: DataFrame, most_terms: int = 4_096, least: int = 5, ratio: float = 6.0) -> Lexicons:
    """Lexicons and classifier terms from labelled rows (text, toxic, again): terms with the largest z of their log odds between toxic and other texts.

    Of equal texts with the same `again` (null: none) that lie in one partition one counts. The counts are a table; only the `most_terms` best and what makes lexicons of them come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = [*(counts[0].keys() | counts[1].keys())]
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["term", "yes", "no"])
            for c in counts:
                c.clear()
            return out

        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for text, toxic, again in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text.as_py() or ""
                if again is not None:
                    if (key := (again, hash(text))) in seen:
                        continue
                    seen.add(key)
                words = set(_WORD.findall(text.lower()))
                counts[toxic].update({"", *(t for w in words for t in terms(w))})      # "" counts the texts
                if len(counts[0]) + len(counts[1]) > 1_000_000:
                    yield flush()
        yield flush()

    counted = sample.select("text", F.col("toxic").cast("int"), "again").mapInArrow(run, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    counted = cut(counted.filter((F.col("yes") + F.col("no") >= least) | (F.col("term") == "")))
    yes, no = (counted.filter("term = ''").select("yes", "no").first() or (0, 0))
    odds = F.log((F.col("yes") + 0.5) / (yes + 1.0)) - F.log((F.col("no") + 0.5) / (no + 1.0))
    spread = F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    best = counted.filter("term <> ''").select("term", "yes", "no", odds.alias("odds"), (odds / spread).alias("z")).orderBy(F.abs("z").desc(), "term").limit(most_terms).collect()
    out = Lexicons(features={r.term: k for k, r in enumerate(best)})
    strong = [r for r in best if r.yes >= least and r.odds >= np.log(ratio) and r.z >= 3]
    for k, r in enumerate(x for x in strong if not x.term.endswith("*") and len(x.term) > 2):
        out.words[r.term] = 1 + k % WORD_LEXICONS
    for k, r in enumerate(x for x in strong if x.term.endswith("*")):
        out.prefixes[r.term] = 1 + WORD_LEXICONS + k % PREFIX_LEXICONS
    return out


@dataclass
class LabelModel:
    """P(vote | class) of each voter for votes -1, 0, 1, its weight (below 1 where it repeats other voters), and the share of class 1."""
    chance: np.ndarray                                                 # voters x 2 x 3
    weight: np.ndarray
    correlation: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(np.array([1 - self.prior, self.prior]))[None, :] + sum(
            self.weight[i] * np.log(self.chance[i][:, votes[:, i] + 1]).T for i in range(votes.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """Accuracies and correlations of voters from the table of all vote patterns and their counts.

    Expectation-maximisation with independent voters gives posteriors; the correlation that two voters keep within the classes (those of the label voter, where
    it votes on any row) shrinks both their weights, 1 / (1 + sum of correlations), and expectation-maximisation goes on with these. The label voter is neither shrunk nor
    estimated, but taken to be right as often as TRUST says."""
    n = votes.shape[1]
    chance = np.tile(np.array([[0.25, 0.7, 0.05], [0.05, 0.55, 0.4]]), (n, 1, 1))
    wrong = 0.5 * (1 - TRUST)
    chance[-1] = [[0.5 - wrong, 0.5, wrong], [wrong, 0.5, 0.5 - wrong]]
    model = LabelModel(chance, np.ones(n), np.eye(n), 0.1)
    if not len(votes):
        return model
    for stage in range(2):
        for _ in range(rounds):
            p = model.posterior(votes)
            mass = np.stack([counts * (1 - p), counts * p])
            model.prior = float(np.clip(mass[1].sum() / counts.sum(), 0.005, 0.995))
            for i in range(n - 1):
                for v in (-1, 0, 1):
                    on = votes[:, i] == v
                    model.chance[i, :, v + 1] = mass[:, on].sum(1) + 0.5
                model.chance[i] /= model.chance[i].sum(1, keepdims=True)
        if stage == 0:
            total = np.zeros((n, n))
            said = votes[:, -1] != 0                                  # where some rows' labels are known these tell which votes go together within a class
            for m in np.stack([counts * (votes[:, -1] == y) for y in (-1, 1)]) if said.any() else mass:
                if m.sum() > 0:
                    centred = votes - (m[:, None] * votes).sum(0) / m.sum()
                    cov = (centred * m[:, None]).T @ centred / m.sum()
                    sd = np.sqrt(np.maximum(np.diagonal(cov), 1e-9))
                    total += cov / sd / sd[:, None] / 2
            np.fill_diagonal(total, 1)
            model.correlation = total
            own = np.maximum(total, 0)[:-1, :-1]
            model.weight[:-1] = 1 / own.sum(1)
    return model


def train_linear(rows: list[list[int]], target: np.ndarray, width: int, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic classifier on binary features with soft labels, by accelerated gradient steps."""
    lengths = np.array([len(r) for r in rows])
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(lengths.sum()))
    row = np.repeat(np.arange(len(rows)), lengths)
    w = np.zeros(width + 1)
    ahead, step = w.copy(), 4.0 / (1 + max(1.0, float(np.mean(lengths))))
    for k in range(rounds):
        z = np.bincount(row, weights=ahead[flat], minlength=len(rows)) + ahead[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        grad = np.append(np.bincount(flat, weights=g[row], minlength=width), g.sum()) + ridge * np.append(ahead[:-1], 0)
        new = ahead - step * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def _least_shingles(h: np.ndarray, first: np.ndarray, size: int = 5, words: int = 1 << 17) -> np.ndarray:
    """The least of each text's `shingles`, 0 for a text without words; whole texts of about this many words together."""
    out = np.zeros(len(first) - 1, np.uint64)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(first, first[a] + words, side="right")) - 1)
        part, edge = h[first[a]:first[b]], first[a:b + 1] - first[a]
        full = np.flatnonzero(np.diff(edge) >= size)
        if len(full):
            roll = np.full(len(part) - size + 1, np.uint64(size), dtype=np.uint64)
            for k in range(size):
                roll = mix(roll * np.uint64(0xD1342543DE82EF95) + part[k:len(part) - size + 1 + k])
            inside = np.zeros(len(roll) + 1, np.int64)
            inside[edge[full]] = 1
            np.add.at(inside, edge[full + 1] - size + 1, -1)              # runs across an end do not count
            keep = np.cumsum(inside[:-1]) > 0
            starts = np.concatenate([[0], np.cumsum(keep)])[edge[full]]
            out[a + full] = np.minimum.reduceat(roll[keep], starts)
        for i in np.flatnonzero((np.diff(edge) > 0) & (np.diff(edge) < size)):
            out[a + i] = shingles(part[edge[i]:edge[i + 1]])[0]
        a = b
    return out


def _once(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents (doc_id, toxic: null without a label, many) of which most copies and near copies are left out: the smallest doc_id of those with the same least shingle hash and label,
    so that words of a text that is there many times count once; many says that there are others. Texts are read where they lie, and only ids and hashes shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_least_shingles(*word_hashes(batch.column(1))).view(np.int64))], ["doc_id", "least"])

    marked = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, least long")
    groups = marked.join(known, "doc_id", "left").groupBy("least", "toxic").agg(F.min("doc_id").alias("doc_id"), (F.count("*") > 1).alias("many"))
    return groups.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("many").alias("many"))


@dataclass
class ToxicityModel:
    lexicons: Lexicons
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 30_000, most_terms: int = 4_096) -> ToxicityModel:
    """From documents (doc_id, text) and labels (doc_id, toxic) of rows that may be learnt from.

    Lexicons count the terms of all labelled rows, and the label model the votes on all documents, the label's wherever there is one. At most sample_rows rows, those with the smallest hashes of
    doc_id, train the classifier: a bounded sample, so it is broadcast. Up to half of them have labels, more where too few have none; the label model's posterior of the others' votes is what they
    teach. Near copies count once in lexicons and classifier. Labels that are null or belong to a null doc_id say nothing; of several for a document the largest counts. Without labels or documents
    the scores are all alike."""
    spark = docs.sparkSession
    known = cut(labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    chosen = cut(_once(docs, known))
    whole = docs.select("doc_id", "text").join(chosen.filter("toxic IS NOT NULL").hint("shuffle_hash"), "doc_id")
    lexicons = induce(whole.select("text", "toxic", F.when(F.col("many"), F.col("doc_id")).alias("again")), most_terms)
    counted = chosen.agg(F.count("toxic"), F.count(F.lit(1))).first()
    with_label = min(counted[0], max(sample_rows // 2, sample_rows - (counted[1] - counted[0])))
    least = [chosen.filter(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "toxic")
             for which, n in (("toxic IS NOT NULL", with_label), ("toxic IS NULL", sample_rows - with_label))]
    some = cut(least[0].unionByName(least[1]))
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    held = spark.sparkContext.broadcast(lexicons)

    def read_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for batch in batches:
            codes = [sum((v + 1) * 3 ** k for k, v in enumerate(reader.votes(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32())], ["doc_id", "votes"])

    def read_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for batch in batches:
            got = [reader.read(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int32())), batch.column(1)], ["votes", "features", "toxic"])

    cast = docs.select("doc_id", "text").mapInArrow(read_votes, "doc_id long, votes int").join(known, "doc_id", "left")
    tally = cast.groupBy("votes", "toxic").agg(F.count("*").alias("n")).collect()      # at most 3 * 2 ** (len(VOTERS) - 1) rows
    rows = sample.select("text", "toxic").mapInArrow(read_sample, "votes array<int>, features array<int>, toxic int").limit(2 * sample_rows).toArrow()
    said = [(*v, 0 if t is None else 1 if t else -1) for v, t in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist())]
    table_ = sorted(((*(r.votes // 3 ** k % 3 - 1 for k in range(len(VOTERS) - 1)), 0 if r.toxic is None else 1 if r.toxic else -1), r.n) for r in tally)
    votes = np.array([v for v, _ in table_], dtype=np.int64).reshape(len(table_), len(VOTERS))
    model = label_model(votes, np.array([n for _, n in table_], dtype=np.float64))
    width = len(lexicons.features) + len(_HITS) + len(_RATES)
    if counted[0]:
        weights = train_linear(rows.column(1).to_pylist(), model.posterior(np.array(said, dtype=np.int64)), width)
    else:
        weights = np.zeros(width + 1)
    return ToxicityModel(lexicons, model, weights)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score, the classifier's probability that the whole text (null: empty) is toxic. Text alone decides; repeated rows score alike, and no rows give none."""
    held = docs.sparkSession.sparkContext.broadcast((model.lexicons, model.weights))
    others = [c for c in docs.columns if c not in ("text", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons, weights = held.value
        reader = Reader(lexicons)
        for batch in batches:
            z = np.array([weights[-1] + weights[reader.features(t.as_py())].sum() for t in batch.column("text")], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], [*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType
    kept = docs.select(*others, "text")
    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("score", DoubleType())).select(*[c for c in docs.columns if c != "score"], "score")


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from."""
    return labels.filter(crc_of_id(F.col("doc_id")) % 3 != 1)


def op2_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, learnable(table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
