"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation-maximisation estimates how reliable each is, and a
span classifier trained on the resulting labels decides which candidates join the spans of the base patterns."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm.shared import table

# The base patterns, by kind. Possessive and anchored so that matching is linear and does not recurse, with the same leftmost matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Candidates beyond the base patterns.
MORE = {
    "phone": r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9])(?:[A-Z]{4}[A-Z0-9]{16}|[A-Za-z_]{3,24} ?[=:] ?\"?[A-Za-z0-9/+_-]{12,64}\"?)(?![A-Za-z0-9])",
}
KINDS = ("email", "ip", "card", "phone", "secret")
# Gazetteers and context words.
KEY_PREFIXES = ("AKIA", "ASIA")
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "auth")
CUES = "phone|tel|telephone|call|mobile|fax|contact|whatsapp|password|passwd|secret|token|key|login|credential|account"
AGAINST = "version|page|order|isbn|issn|number|table|figure|total|item|ref|nr|no"
#: Characters before a candidate that the context labeler sees.
CONTEXT = 40


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.substr(turned, i, F.lit(1)).cast("int")).otherwise(
        F.substr(turned, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(turned, i, F.lit(1)) > "4", 9).otherwise(0)))
    return total % 10 == 0


def passes(kind: str, text: Column) -> Column:
    """The base rule on a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    n = F.length(_digits(text))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), _luhn(_digits(text))).otherwise(False)


def matches(text: Column, pattern: str, hint: Column, keep=None) -> Column:
    """All matches of a pattern as structs: start, end (code points, exclusive), match, before (up to CONTEXT characters). hint: a cheap condition that every text with a match meets.

    Splitting at the pattern gives the text between the matches, so lengths add up to places; keep drops matches as they are listed."""
    empty = F.expr("cast(array() as array<struct<start: int, end: int, match: string, before: string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), F.right(x["gap"], F.lit(CONTEXT)).alias("before")))
        more = F.concat(acc["out"], span)
        return F.struct(end.alias("at"), (more if keep is None else F.when(keep(x["match"]), more).otherwise(acc["out"])).alias("out"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    walked = F.aggregate(F.filter(pairs, lambda x: x["match"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(hint & text.rlike(pattern), walked).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """docs and the arrays base_<kind> (matches that pass the base rule) and more_<kind> (further candidates that overlap none of them)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    hints = {"email": F.instr(text, "@") > 0, "ip": digit, "card": digit, "phone": F.instr(text, "+") > 0}
    base = docs.select("*", *[matches(text, BASE[k], hints[k], lambda m, k=k: passes(k, m)).alias(f"base_{k}") for k in BASE])
    taken = F.concat(*[F.col(f"base_{k}") for k in BASE])
    free = lambda spans: F.filter(spans, lambda x: ~F.exists(taken, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return base.select("*", *[F.when(digit | (F.lit(k == "secret") & text.rlike("[=:]")), free(matches(text, MORE[k], F.lit(True)))).otherwise(F.expr("cast(array() as array<struct<start: int, end: int, match: string, before: string>>)"))
                              .alias(f"more_{k}") for k in MORE])


def voters(kind: str, x: Column) -> list[Column]:
    """Votes on a candidate: 1 personal, -1 not, 0 no opinion. Regex (shape), regex (digits), gazetteer, context for, context against, neighbour."""
    match, before = x["match"], F.lower(x["before"])
    digits = _digits(match)
    vote = lambda yes, no=None: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)
    if kind == "phone":
        shape = vote(match.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$"), match.rlike(r"^[0-9]{3} [0-9]{3} [0-9]{4}$"))
        spread = vote(~digits.rlike(r"^[01]"), digits.rlike(r"^[01]"))
        listed = vote(F.substr(digits, F.lit(4), F.lit(3)) == "555")
    else:
        name = F.lower(F.regexp_extract(match, r"^([A-Za-z_]+) ?[=:]", 1))
        value = F.regexp_replace(match, r"^[A-Za-z_]+ ?[=:] ?", "")
        shape = vote(match.rlike(r"^[A-Z0-9]{20}$") | match.rlike(r"[=:] ?\"?[A-Za-z0-9/+_-]{16,}\"?$"), value.rlike(r"^[a-z]+$"))
        spread = vote(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), ~value.rlike("[0-9]"))
        listed = vote(F.substr(match, F.lit(1), F.lit(4)).isin(*KEY_PREFIXES) | name.isin(*SECRET_NAMES))
    cue = vote(before.rlike(rf"\b(?:{CUES})\b"))
    against = F.when(before.rlike(rf"\b(?:{AGAINST})\b[ .:#]*$"), -1).otherwise(0)
    neighbour = vote(before.rlike(r"(^|\s)$"), before.rlike(r"[/_#@.-]$"))
    return [shape, spread, listed, cue, against, neighbour]


VOTERS = 6


def features(kind: str, x: Column) -> list[Column]:
    """What the classifier sees of a candidate: its votes' raw conditions are not among them; a bounded number of values."""
    match, before = x["match"], F.lower(x["before"])
    return [F.lit(KINDS.index(kind)), F.least(F.length(match) / 4, F.lit(15)).cast("int"), match.rlike("[0-9]").cast("int"), match.rlike("[A-Z]").cast("int"), match.rlike("[a-z]").cast("int"),
            match.rlike("[=:]").cast("int"), match.rlike("[()]").cast("int"), before.rlike(r"[a-z]\s$").cast("int"), before.rlike(r"[:=]\s?$").cast("int"), before.rlike(rf"\b(?:{CUES})\b").cast("int")]


def _bound(f, kind: str):
    return lambda x: f(kind, x)


@dataclass
class SpanModel:
    reliability: list[tuple[float, float]]            # of each voter: P(its vote is 1 | personal and it votes), P(its vote is -1 | not personal and it votes)
    prior: float
    weights: list[dict[int, float]]                   # of each feature's values
    bias: float


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.7) -> tuple[list[list[dict[int, float]]], float, list[float]]:
    """Vote patterns with their counts: of each voter P(vote | not personal), P(vote | personal), the prior, and each pattern's posterior. Smoothed by one vote either way."""
    if not patterns:
        return [], prior, []
    n = len(patterns[0][0])
    # to begin with, a voter that votes is right four times in five
    table_ = [[{-1: 0.4, 0: 0.5, 1: 0.1}, {-1: 0.1, 0: 0.5, 1: 0.4}] for _ in range(n)]
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for votes, _ in patterns:
            logs = [math.log(p) + sum(math.log(table_[i][y][v]) for i, v in enumerate(votes)) for y, p in ((0, 1 - prior), (1, prior))]
            post.append(1 / (1 + math.exp(max(-700.0, min(700.0, logs[0] - logs[1])))))
        mass = [sum(c * (1 - p) for (_, c), p in zip(patterns, post)), sum(c * p for (_, c), p in zip(patterns, post))]
        prior = min(0.99, max(0.01, mass[1] / sum(mass)))
        for i in range(n):
            for y in (0, 1):
                got = {-1: 0.8 + 0.2 * (y == 0), 0: 1.0, 1: 0.8 + 0.2 * (y == 1)}
                for (votes, c), p in zip(patterns, post):
                    got[votes[i]] += c * (p if y else 1 - p)
                total = sum(got.values())
                table_[i][y] = {v: x / total for v, x in got.items()}
    return table_, prior, post


def logistic(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[list[dict[int, float]], float]:
    """Weights of categorical features from (features, weight of label 1, weight of label 0) by gradient steps on the mean log loss."""
    if not rows:
        return [], 0.0
    weights: list[dict[int, float]] = [{} for _ in rows[0][0]]
    bias, total = 0.0, sum(a + b for _, a, b in rows)
    for _ in range(rounds):
        steps: list[dict[int, float]] = [{} for _ in weights]
        shift = 0.0
        for x, yes, no in rows:
            z = bias + sum(w.get(v, 0.0) for w, v in zip(weights, x))
            g = (yes - (yes + no) / (1 + math.exp(-max(-60.0, min(60.0, z))))) / total
            shift += g
            for s, v in zip(steps, x):
                s[v] = s.get(v, 0.0) + g
        bias += rate * shift
        for w, s in zip(weights, steps):
            for v, g in s.items():
                w[v] = w.get(v, 0.0) + rate * (g - ridge * w.get(v, 0.0))
    return weights, bias


def fit_spans(docs: DataFrame) -> SpanModel:
    """Reliabilities and classifier from the candidates of all documents. Only counts of (votes, features) come to the driver: 3 ** VOTERS patterns a kind times the features' values, a bounded number."""
    found = candidates(docs.select("text")).select(*[f"more_{k}" for k in MORE])
    pick = lambda k, x: F.struct(F.array(*voters(k, x)).alias("votes"), F.array(*features(k, x)).alias("features"))
    rows = found.select(F.explode(F.concat(*[F.transform(f"more_{k}", _bound(pick, k)) for k in MORE])).alias("c")).groupBy("c.votes", "c.features").agg(F.count("*").alias("n")).collect()
    votes: dict[tuple[int, ...], int] = {}
    for r in rows:
        votes[tuple(r.votes)] = votes.get(tuple(r.votes), 0) + r.n
    patterns = sorted(votes.items())
    table_, prior, post = expectation_maximisation(patterns)
    label = {p: q for (p, _), q in zip(patterns, post)}
    sums: dict[tuple[int, ...], list[float]] = {}
    for r in rows:
        s = sums.setdefault(tuple(r.features), [0.0, 0.0])
        s[0] += r.n * label[tuple(r.votes)]
        s[1] += r.n * (1 - label[tuple(r.votes)])
    weights, bias = logistic(sorted((f, a, b) for f, (a, b) in sums.items()))
    right = lambda v, y: v[1][1] / max(1e-12, v[1][1] + v[1][-1]) if y else v[0][-1] / max(1e-12, v[0][1] + v[0][-1])
    return SpanModel([(right(v, 1), right(v, 0)) for v in table_], prior, weights, bias)


def _accepted(kind: str, model: SpanModel) -> Column:
    def decide(x: Column) -> Column:
        z = F.lit(float(model.bias))
        for w, f in zip(model.weights, features(kind, x)):
            for v, g in sorted(w.items()):
                z = z + F.when(f == v, float(g)).otherwise(0.0)
        return z > 0

    return F.filter(f"more_{kind}", decide)


def find_spans(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """docs and `spans`, arrays of (kind as a number in KINDS, start, end) by kind and start, and `base`, those of the base patterns alone.

    Null and empty texts have no spans, a null doc_id changes nothing, repeated rows are found alike, and other columns come along (but base_*, more_*, spans and base, which
    are made anew). Texts are looked at whole, without Python."""
    model = model or fit_spans(docs)
    mine = [c for c in docs.columns if not c.startswith(("base_", "more_")) and c not in ("spans", "base")]
    found = candidates(docs.select(*mine))
    named = lambda spans, kind: F.transform(spans, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    base = F.concat(*[named(F.col(f"base_{k}"), k) for k in BASE])
    more = F.concat(*[named(_accepted(k, model), k) for k in MORE])
    return found.select(*mine, base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """docs with each span of personal data replaced by [KIND]; overlapping spans become one, named after the first. n_chars follows the text where both are there;
    all other columns stay as they are, whatever their names."""
    found = find_spans(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.expr("cast(array() as array<struct<start: int, end: int, kind: int>>)")

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))))
        return F.when((F.size(acc) > 0) & (last["end"] > s["start"]), longer).otherwise(F.concat(acc, F.array(s)))

    row = found.select("_row", "text", F.aggregate(ordered, empty, merge).alias("_spans"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("_spans", i)["end"])
    parts = F.transform("_spans", lambda s, i: F.concat(F.substr(F.col("text"), before(i) + 1, s["start"] - before(i)), F.element_at(names, s["kind"] + 1)))
    tail = F.substr(F.col("text"), F.try_element_at("_spans", F.lit(-1))["end"] + 1)
    some = F.size("_spans") > 0
    out = row.select("_row", some.alias("_some"), F.when(some, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text")).alias("_text"))

    def column(name: str, kind: str) -> Column:
        if name == "text":
            return F.col("_text").alias(name)
        own = F.col("_row").getField(name)
        return (F.when(F.col("_some"), F.length("_text").cast(kind)).otherwise(own) if name == "n_chars" else own).alias(name)

    return out.select(*[column(c, t) for c, t in docs.dtypes])


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs)
    listed = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base_count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[base_count(k) for k in BASE], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), count("secret"))
