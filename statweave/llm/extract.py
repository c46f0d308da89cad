"""Main text of web pages: a linear-chain conditional random field labels the leaf blocks of a page's element tree, and Viterbi decoding picks the article's."""
from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from statweave.llm.labelled_pages import labelled_pages
from statweave.llm.shared import table

# How HTML nests.
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main "
                   "menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_HIDDEN = frozenset("iframe noembed noframes script style svg template textarea title".split())
_ENDS_BLOCK = frozenset(("hr",))
#: An element that closes an open one of its kind, and the containers that this does not look beyond.
_CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
           "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_SECTION = frozenset("article aside blockquote body figure footer form header main nav noscript ol section table ul dl".split())

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in _HIDDEN}
_BINS = (1, 2, 4, 8, 16, 32, 64, 128)


@dataclass(slots=True)
class Block:
    """A leaf block: its text, the open elements around it as (tag, attributes), and how many of its characters are in links."""
    text: str
    path: tuple[tuple[str, str], ...]
    linked: int


def leaf_blocks(page: str) -> tuple[list[Block], str]:
    """The page's leaf blocks in order, and its title. Unclosed and stray tags are read as browsers do: a block ends an open paragraph, an end tag closes what is open inside it."""
    blocks: list[Block] = []
    path: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, in_link, title, at = 0, False, "", 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append(Block(text, tuple(path), min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in _HIDDEN:
            if not end and not attributes.endswith("/"):
                stop = _END[name].search(page, at)
                if name == "title" and not title:
                    title = " ".join(entities.unescape(page[at:stop.start() if stop else n]).split())
                at = stop.end() if stop else n
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = not end
        elif name in _ENDS_BLOCK:
            flush()
        elif name in _BLOCK:
            flush()
            if end:
                for k in range(len(path) - 1, -1, -1):
                    if path[k][0] == name:
                        del path[k:]
                        in_link = False
                        break
                    if path[k][0] in ("td", "th", "table") and name not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "body", "html"):
                        break
                continue
            if path and (path[-1][0] == "p" or path[-1][0][0] == name[0] == "h" and path[-1][0][1:].isdigit() and name[1:].isdigit()):
                path.pop()
            if name in _CLOSES:
                kinds, walls = _CLOSES[name]
                for k in range(len(path) - 1, -1, -1):
                    if path[k][0] in walls:
                        break
                    if path[k][0] in kinds:
                        del path[k:]
            path.append((name, attributes.strip()))
    flush()
    return blocks, title


def _tokens(attributes: str) -> list[list[str]]:
    """Words of the values that name an element, a list per value."""
    return [[t.lower() for t in _TOKEN.findall(m[2] or m[3] or m[4] or "")] for m in _NAMED.finditer(attributes)]


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    """What the elements around a block tell: all tags and naming words above it, those of the nearest named element and section, its own tag."""
    out, nearest, section = set(), None, "none"
    for tag, attributes in path:
        out.add("a:" + tag)
        if tag in _SECTION:
            section = tag
        if attributes:
            named = _tokens(attributes)
            if any(named):
                nearest = named
            for t in (t for value in named for t in value):
                out.add("c:" + t)
                if len(t) > 4:
                    out.add("q:" + t[:4])
            if _UNSEEN.search(attributes):
                out.add("hidden")
    for value in nearest or ():
        for t in value:
            out.add("n:" + t)
            if len(t) > 4:
                out.add("m:" + t[:4])
        if value:
            out.add("l:" + value[-1])
    own, above = (path[-1][0] if path else "none"), (path[-2][0] if len(path) > 1 else "none")
    out.update(("s:" + section, "b:" + own, f"b:{above}>{own}", f"s:{section}>{own}"))
    return sorted(out)


def _bin(x: float) -> int:
    return sum(x >= b for b in _BINS)


def text_features(block: Block, number: int, count: int, title: str, words_known: frozenset[str]) -> list[str]:
    """What a block's text and place tell; of its words only those that the model knows."""
    text = block.text
    words = text.split(" ")
    size, own = _bin(len(words)), block.path[-1][0] if block.path else "none"
    share = block.linked / len(text)
    link = 0 if share == 0 else 1 if share < 0.25 else 2 if share < 0.5 else 3 if share < 0.9 else 4
    ends = text[-1] in ".!?…。"
    out = ["one", f"words:{size}", f"link:{link}", f"words:{size}:{link}", f"{own}:words:{size}", f"ends:{ends}", f"{own}:ends:{ends}:{link}", f"commas:{_bin(text.count(','))}",
           f"stops:{_bin(text.count('. ') + text.count('! ') + text.count('? '))}", f"place:{8 * number // count}", "start:" + ("upper" if text[0].isupper() else "lower" if text[0].islower() else "digit" if text[0].isdigit() else "sign")]
    if number < 2:
        out.append(f"first:{number}")
    if count - number <= 2:
        out.append(f"last:{count - number}")
    if title and (text == title or title.startswith(text) or text.startswith(title)):
        out += ["title", "title:" + own]
    for sign in "©|·»›→" if link else "©":
        if sign in text:
            out.append(f"sign:{sign}:{link}")
    if len(words) <= 32:
        out += ["w:" + w for w in {w.strip(".,!?:;()").lower() for w in words} if w in words_known]
    return out


@dataclass
class Model:
    """Weights of the field: of features for `article` against `rest`, of transitions (from, to), of the first and the last block's label."""
    weights: dict[str, float]
    words: frozenset[str]
    moves: np.ndarray
    first: np.ndarray
    last: np.ndarray


def label_blocks(blocks: list[Block], text: str) -> list[int]:
    """1 for the blocks that make up a page's known main text, matched from the last to the first."""
    wanted = text.split("\n\n") if text else []
    out = [0] * len(blocks)
    for k in range(len(blocks) - 1, -1, -1):
        if wanted and blocks[k].text == wanted[-1]:
            out[k] = 1
            wanted.pop()
    return out


def fit(pages: Iterable[tuple[str, str]], rounds: int = 200, rate: float = 0.1, decay: float = 5e-4, least: int = 3) -> Model:
    """Maximum-likelihood weights from labelled pages (html, main text), with a Gaussian prior; a feature needs `least` blocks. The pages are held in memory: give a bounded number."""
    read = []
    for page, text in pages:
        blocks, title = leaf_blocks(page)
        if blocks:
            read.append((blocks, title, label_blocks(blocks, text)))
    seen = [Counter(), Counter()]                                    # blocks of the rest and of articles that hold a word
    for blocks, _, labels in read:
        for b, y in zip(blocks, labels):
            seen[y].update({w.strip(".,!?:;()").lower() for w in b.text.split(" ")})
    words = frozenset(w for w, c in seen[0].items() if c >= 20 and c > 3 * seen[1][w])
    lists = [[path_features(b.path) + text_features(b, i, len(blocks), title, words) for i, b in enumerate(blocks)] for blocks, title, _ in read]
    count = Counter(f for page in lists for block in page for f in block)
    number = {f: i for i, f in enumerate(sorted(f for f, c in count.items() if c >= least))}
    flat = [[number[f] for f in block if f in number] for page in lists for block in page]
    ids, starts = np.concatenate([np.array(x, np.int64) for x in flat]), np.cumsum([0] + [len(x) for x in flat])[:-1]
    owner = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    sizes = np.array([len(x[0]) for x in read])
    longest = int(sizes.max())
    y = np.zeros((len(read), longest), np.int64)
    inside = np.arange(longest) < sizes[:, None]
    y[inside] = np.concatenate([np.array(x[2]) for x in read])
    theta = np.zeros(len(number) + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = _gradient(theta, ids, starts, owner, inside, y) / len(read) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    rest = theta[len(number):]
    return Model({f: float(theta[i]) for f, i in number.items()}, words, rest[:4].reshape(2, 2), rest[4:6], rest[6:8])


def _gradient(theta, ids, starts, owner, inside, y) -> np.ndarray:
    """Of the log-likelihood: observed minus expected counts, by forward and backward sums over all pages together."""
    pages, longest = inside.shape
    rows, size = np.arange(pages), inside.sum(1)
    score = np.zeros((pages, longest, 2))
    score[inside, 1] = np.add.reduceat(theta[ids], starts)
    moves, first, last = theta[-8:-4].reshape(2, 2), theta[-4:-2], theta[-2:]
    score[:, 0] += first
    score[rows, size - 1] += last
    ahead, back = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0]
    for t in range(1, longest):
        ahead[:, t] = np.where(inside[:, t, None], score[:, t] + np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]), 0)
    for t in range(longest - 2, -1, -1):
        x = score[:, t + 1] + back[:, t + 1]
        back[:, t] = np.where(inside[:, t + 1, None], np.logaddexp(moves[:, 0] + x[:, :1], moves[:, 1] + x[:, 1:]), 0)
    total = np.logaddexp(ahead[rows, size - 1, 0], ahead[rows, size - 1, 1])
    belief = np.where(inside[:, :, None], np.exp(ahead + back - total[:, None, None]), 0)
    grad = np.zeros_like(theta)
    np.add.at(grad, ids, (y[inside] - belief[inside, 1])[owner])
    pair = inside[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            joint = np.exp(np.where(pair, ahead[:, :-1, a] + moves[a, b] + score[:, 1:, b] + back[:, 1:, b] - total[:, None], -np.inf))
            grad[len(theta) - 8 + 2 * a + b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() - joint.sum()
        grad[len(theta) - 4 + a] = (y[:, 0] == a).sum() - belief[:, 0, a].sum()
        grad[len(theta) - 2 + a] = (y[rows, size - 1] == a).sum() - belief[rows, size - 1, a].sum()
    return grad


class Reader:
    """Decodes pages with a model; a full memo of paths is emptied."""

    def __init__(self, model: Model, most: int = 20_000):
        self.model, self.most, self._memo = model, most, {}

    def _path(self, path) -> float:
        value = self._memo.get(path)
        if value is None:
            if len(self._memo) >= self.most:
                self._memo.clear()
            get = self.model.weights.get
            value = self._memo[path] = sum(get(f, 0.0) for f in path_features(path))
        return value

    def labels(self, blocks: list[Block], title: str) -> list[int]:
        """The likeliest labels of all blocks together."""
        get, words = self.model.weights.get, self.model.words
        (m00, m01), (m10, m11) = self.model.moves.tolist()
        came, rest, main = [], *self.model.first.tolist()
        for i, b in enumerate(blocks):
            if i:
                to_rest, to_main = rest + m00 >= main + m10, rest + m01 >= main + m11          # from the rest?
                came.append((to_rest, to_main))
                rest, main = (rest + m00 if to_rest else main + m10), (rest + m01 if to_main else main + m11)
            main += self._path(b.path) + sum(get(f, 0.0) for f in text_features(b, i, len(blocks), title, words))
        label = int(main + self.model.last[1] > rest + self.model.last[0])
        out = [label] * len(blocks)
        for i in range(len(blocks) - 1, 0, -1):
            label = 0 if came[i - 1][label] else 1
            out[i - 1] = label
        return out

    def main_text(self, page: str | None) -> str:
        blocks, title = leaf_blocks(page or "")
        return "\n\n".join(b.text for b, y in zip(blocks, self.labels(blocks, title)) if y) if blocks else ""


def main_texts(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """Every row of pages with `text`, the article of its page, in place of the html: blocks joined by two line ends, references decoded, white space within a block one space.

    Null and empty pages, and pages without an article, have an empty text. Whole pages are read, repeated rows are rows of their own, a column named `text` is replaced. Nothing is shuffled."""
    keep = [c for c in pages.columns if c not in (html, "text")]
    source = pages.select(F.col(html).cast("string").alias("_html"), *keep)
    schema = StructType([*(f for f in source.schema.fields if f.name != "_html")]).add("text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([reader.main_text(x.as_py()) for x in part.column(0)], pa.string())], schema.names)
    return source.mapInArrow(run, schema)


def op13_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"), fit(labelled_pages())).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: For the tables given, whose pages mark the article as such and close all but paragraphs.
OP13_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, [trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
        '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#x27;|&#39;', chr(39), 'g'), '&amp;', '&'), '\s+', ' ', 'g')) FOR x IN regexp_split_to_array(body, '</?(?:p|h1)>')] AS parts FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
