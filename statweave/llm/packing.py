"""Order-preserving packing of tokenised documents into windows by dynamic programming."""
from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from statweave.llm.shared import table

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SLICE_CHARS = 1 << 20


class ChunkCodec:
    """Token ids of texts, by a memo of the ids of space-separated chunks.

    A space between two characters that are no white space always begins a pre-token of this vocabulary's splitting rule, so the ids of the chunks, joined,
    are the ids of the text. Texts with other white space beside a space are split at such spaces only. A full memo takes no more chunks."""

    def __init__(self, ranks_path: str, pattern: str, most: int = 100_000):
        import base64

        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        self._ends = np.zeros(len(ranks) + 1, dtype=bool)           # ids that may end a sentence
        self._line = np.zeros(len(ranks) + 1, dtype=bool)
        self._blank = np.zeros(len(ranks) + 1, dtype=bool)          # ids that begin with white space
        for word, k in ranks.items():
            self._ends[k], self._line[k], self._blank[k] = word[-1:] in (b".", b"!", b"?"), word[-1:] == b"\n", word[:1] in (b" ", b"\n")
        self._space = np.zeros(len(ranks) + 1, dtype=bool)          # ids that begin with a space, as a chunk's first id does and no other
        for word, k in ranks.items():
            self._space[k] = word[:1] == b" "
        self._most = most
        codec = self

        class Memo(dict):
            def __missing__(self, chunk: str) -> int:
                k = len(codec._start) + len(codec._new)
                codec._new.append(chunk)
                if " " in chunk:                                    # only where texts are split at safe spaces
                    codec._spaced.add(k)
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    codec._odd.add(k)
                if k < most and len(chunk) <= 48:
                    self[chunk] = k
                return k

        class First(dict):
            def __missing__(self, chunk: str) -> int:
                k = len(codec._start) + len(codec._new)
                codec._apart[k] = chunk
                codec._new.append("")
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    codec._odd.add(k)
                if k < most and len(chunk) <= 48:
                    self[chunk] = k
                return k

        self._inner, self._first = Memo(), First()
        self._new: list[str] = []
        self._apart: dict[int, str] = {}                            # entries that begin a text
        self._spaced: set[int] = set()                              # new entries with a space inside
        self._odd: set[int] = set()                                  # entries with white space at an edge, or empty
        self._flat, self._start, self._length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode_new(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the new entries, and how many each has: those between spaces in one call, the others one by one."""
        first = len(self._start)
        lone = sorted(x for x in {*self._apart, *self._odd, *self._spaced} if x >= first)
        ids = {x: self._encoding.encode(self._apart[x] if x in self._apart else " " + self._new[x - first], allowed_special="all") for x in lone}
        plain = np.ones(len(self._new), dtype=bool)
        plain[np.array(lone, dtype=np.int64) - first] = False
        text = "".join(" " + x for x, p in zip(self._new, plain) if p) if lone else " " + " ".join(self._new)
        joined = np.array(self._encoding.encode(text, allowed_special="all") if plain.any() else [], dtype=np.uint32)
        count = np.zeros(len(self._new), np.int64)
        count[plain] = np.diff(np.append(np.flatnonzero(self._space[joined]), len(joined)))
        count[~plain] = [len(ids[x]) for x in lone]
        flat = np.zeros(int(count.sum()), np.uint32)
        flat[np.repeat(plain, count)] = joined
        flat[np.repeat(~plain, count)] = list(chain.from_iterable(ids[x] for x in lone))
        return flat, count

    def _chunks(self, text: str, begins: bool, safe: bool) -> list[int]:
        parts = _SAFE_SPACE.split(text) if safe else text.split(" ")
        if begins:
            return [self._first[parts[0]], *map(self._inner.__getitem__, parts[1:])]
        return list(map(self._inner.__getitem__, parts))

    def encode(self, parts: list[tuple[bool, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts or slices of texts (is it a beginning, text): all ids joined, ids of each part, positions in all ids after which a sentence ends."""
        found = [self._chunks(x, begins, False) for begins, x in parts]
        if self._odd:
            found = [f if self._odd.isdisjoint(f) else self._chunks(x, begins, True) for f, (begins, x) in zip(found, parts)]
        more, new = self._encode_new() if self._new else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        at = len(self._flat) + np.cumsum(new) - new
        flat, start, length = np.concatenate([self._flat, more]), np.concatenate([self._start, at]), np.concatenate([self._length, new])
        k = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        n = length[k]
        after = np.cumsum(n)
        ids = flat[np.repeat(start[k] - (after - n), n) + np.arange(after[-1])]
        tokens = np.diff(after[np.cumsum([len(f) for f in found]) - 1], prepend=0)
        ends = self._line[ids]
        ends[:-1] |= self._ends[ids[:-1]] & self._blank[ids[1:]]
        if len(self._start) < self._most:                           # else what is new lies beyond the memo and goes
            self._flat, self._start, self._length = flat, start, length
        else:
            self._odd = {x for x in self._odd if x < len(self._start)}
        self._new, self._apart, self._spaced = [], {}, set()
        return ids, tokens, np.flatnonzero(ends) + 1


def slices(text: str) -> Iterator[tuple[bool, str]]:
    """(is it the text's beginning, part): parts of about a million characters that may be encoded apart. The space between two belongs to the second and is left out."""
    at, begins = 0, True
    while len(text) - at > _SLICE_CHARS:
        m = _SAFE_SPACE.search(text, at + _SLICE_CHARS)
        if m is None:
            break
        yield begins, text[at:m.start()]
        at, begins = m.end(), False
    yield begins, text[at:]


def window_cuts(n: int, ends: np.ndarray, penalties: np.ndarray, window: int, hard: float, last: bool) -> list[int]:
    """Cuts 0 < c1 < c2 ... of n tokens that make windows of at most `window` and the least padding plus penalties.

    ends and penalties: where a cut is welcome, ascending; elsewhere a cut costs `hard`, and is considered at every window / 32 tokens where no other is near.
    The least cost of a cut at p is penalty + window - p + min over earlier cuts q >= p - window of (cost(q) + q): a sliding minimum, kept in a monotone
    queue. With last, the cuts end with n; else what follows the last cut stays open, without a cost, for the tokens that come next."""
    inside = (ends > 0) & (ends < n)
    p, w = ends[inside], penalties[inside]
    gaps = np.diff(np.concatenate([[0], p, [n]]))
    step = max(1, window // 32)
    if (gaps > step).any():
        left, wide = np.concatenate([[0], p])[gaps > step], gaps[gaps > step]
        count = (wide - 1) // step
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        more = np.repeat(left, count) + (within + 1) * step
        p, w = np.concatenate([p, more]), np.concatenate([w, np.full(len(more), hard)])
        order = np.argsort(p, kind="stable")
        p, w = p[order], w[order]
    spots = [0, *p.tolist(), n]
    cost = [0.0, *w.tolist(), 0.0]
    before = [0] * len(spots)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])             # (cost + position, index), ascending in both
    best_open, open_at = (float("inf"), 0), 0
    for j in range(1, len(spots)):
        at = spots[j]
        low = at - window
        while spots[queue[0][1]] < low:
            queue.popleft()
        value, before[j] = queue[0]
        value += cost[j] + window - at
        if j == len(spots) - 1:
            break
        if at >= n - window and (value, -at) < best_open:
            best_open, open_at = (value, -at), j
        key = value + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = len(spots) - 1 if last else open_at
    cuts = []
    while j > 0:
        cuts.append(spots[j])
        j = before[j]
    return cuts[::-1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Stream:
    """Tokens of one partition's documents that are not packed yet, from stream position `base`."""

    def __init__(self, window: int, sentence: float, hard: float, keep_ids: bool, part: int):
        self.window, self.sentence, self.hard, self.keep_ids = window, sentence, hard, keep_ids
        self.next_sequence = part << 33
        self.ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.base = self.size = 0
        self.doc_ids: list = []
        self.doc_start: list[int] = []
        self.doc_tokens: list[int] = []

    def begin(self, doc_id) -> None:
        self.doc_ids.append(doc_id)
        self.doc_start.append(self.base + self.size)
        self.doc_tokens.append(-1)

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids.append(ids)
        self.ends.append(ends + (self.base + self.size))
        self.size += len(ids)

    def finish(self) -> None:
        self.doc_tokens[-1] = self.base + self.size - self.doc_start[-1]

    def pack(self, last: bool) -> pa.RecordBatch | None:
        if not self.size:
            return None
        ids = np.concatenate(self.ids)
        starts = np.array(self.doc_start, dtype=np.int64)
        doc_ends = starts[1:] - self.base
        soft = np.concatenate([np.zeros(0, np.int64), *self.ends]) - self.base
        soft = soft[(soft > 0) & ~np.isin(soft, doc_ends)]
        spots = np.concatenate([doc_ends, soft])
        worth = np.concatenate([np.zeros(len(doc_ends)), np.full(len(soft), self.sentence)])
        order = np.argsort(spots, kind="stable")
        spots, first = np.unique(spots[order], return_index=True)
        cuts = np.array(window_cuts(self.size, spots, worth[order][first], self.window, self.hard, last), dtype=np.int64)
        if not len(cuts):
            self.ids = [ids]
            return None
        done = cuts[-1]
        heads = np.concatenate([[0], cuts[:-1]])
        edges = np.unique(np.concatenate([heads, np.maximum(starts - self.base, 0)]))
        edges = edges[edges < done]
        stops = np.append(edges[1:], done)
        doc = np.searchsorted(starts - self.base, edges, side="right") - 1
        sequence = np.searchsorted(heads, edges, side="right") - 1
        blob = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(blob[4 * a:4 * b]) for a, b in zip(edges.tolist(), stops.tolist())]
        columns = [pa.array([self.doc_ids[d] for d in doc], pa.int64()), pa.array(edges + self.base - starts[doc]), pa.array(stops - edges), pa.array(crc, pa.int64()),
                   pa.array(np.array(self.doc_tokens, dtype=np.int64)[doc]), pa.array(self.next_sequence + sequence), pa.array(edges - heads[sequence])]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(edges, done), pa.int32()), pa.array(ids[:done].astype(np.int32))))
            names.append("ids")
        self.next_sequence += len(heads)
        keep = int(np.searchsorted(starts - self.base, done, side="right")) - 1
        self.doc_ids, self.doc_start, self.doc_tokens = self.doc_ids[keep:], self.doc_start[keep:], self.doc_tokens[keep:]
        self.ends = [(soft[soft > done] + self.base)]
        self.ids = [ids[done:]]
        self.base, self.size = self.base + int(done), self.size - int(done)
        return pa.RecordBatch.from_arrays(columns, names)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, window: int = 2048, end_id: int = 1, sentence_penalty: float = 4.0, hard_penalty: float = 32.0,
                   block_tokens: int = 1 << 19, keep_ids: bool = False) -> DataFrame:
    """Documents, in the order of their rows, cut into windows of at most `window` tokens with the least padding plus penalties.

    A cut between documents is free, one after a sentence (a chunk that ends with . ! ? or a line end) costs sentence_penalty tokens of padding, any other
    hard_penalty (tried every window / 32 tokens). Every partition is packed by itself, block by block; a block's open window goes on in the next, so only a partition's last window is short.
    Null text counts as empty: the document is its end token alone. Null and repeated doc_id are rows like others. Other columns are ignored; no rows give no rows.
    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(ranks_path, pattern)                    # its memo ends with the task
        stream = _Stream(window, sentence_penalty, hard_penalty, keep_ids, TaskContext.get().partitionId())
        tail = np.array([end_id], dtype=np.uint32)

        def groups() -> Iterator[list[tuple]]:
            """(doc_id, first part, last part, part), about a million characters together."""
            group, chars = [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    parts = list(slices(text.as_py() or ""))
                    for k, (begins, part) in enumerate(parts):
                        group.append((doc_id, begins, k == len(parts) - 1, part))
                        chars += len(part)
                        if chars >= _SLICE_CHARS:
                            yield group
                            group, chars = [], 0
            if group:
                yield group

        for group in groups():
            ids, counts, ends = codec.encode([(begins, part) for _, begins, _, part in group])
            at = 0
            bounds = np.searchsorted(ends, np.concatenate([[0], np.cumsum(counts)]), side="right")
            for k, (doc_id, begins, finishes, part) in enumerate(group):
                if begins:
                    stream.begin(doc_id)
                n = int(counts[k])
                stream.add(ids[at:at + n], ends[bounds[k]:bounds[k + 1]] - at)
                at += n
                if finishes:
                    stream.add(tail, np.zeros(0, np.int64))
                    stream.finish()
            # a document whose end is not there yet has no size to report: such a stream waits
            if stream.size >= block_tokens and stream.doc_tokens[-1] >= 0 and (out := stream.pack(False)) is not None:
                yield out
        if (out := stream.pack(True)) is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if keep_ids else ""))


def ranks_and_pattern(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """The ranks of byte_bpe_50k.json (the same vocabulary) and its splitting rule."""
    import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *ranks_and_pattern())
