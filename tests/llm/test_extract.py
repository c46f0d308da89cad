import itertools
import random
from collections import Counter

import numpy as np
import pytest

from statweave.llm import extract
from statweave.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return extract.fit(labelled_pages())


def texts(page):
    return [b.text for b in extract.leaf_blocks(page)[0]]


def test_leaf_blocks_of_untidy_pages():
    assert texts("<p><b>one<br>two<p>three</b> <i>x</i>&amp;y&nbsp;&eacute;&#233;&#x1F600;</p></div> tail") == ["one two", "three x&y éé\U0001F600", "tail"]
    assert texts("<ul><li>a<li>b <ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<script>'<p>no</p>'</script>x<!-- <p>no</p> --><STYLE>p{}</STYLE><textarea><p>no</textarea>y<br/>z") == ["xy z"]
    assert texts("a < b && c > d <3 &lt;p&gt; &am &amp &quot") == ['a < b && c > d <3 <p> &am & "']
    assert texts("<div title='a > b' class=\"x\">in</div><div title=\"open>in2</div>") == ["in", "in2"]
    assert texts("<p>one<script>never closed <p>two") == ["one"] and texts("x<!-- open <p>y") == ["x"] and texts("") == [] and texts("<p></p> \n<div>") == []
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d<hr>e") == ["a", "b", "c", "d", "e"]
    assert texts("<p>ends in a tag <div class='x'") == ["ends in a tag"]
    path = [b.path for b in extract.leaf_blocks("<body><div class='a'><p>1<div>2</div></div><h1>3<h2>4")[0]]
    assert [[t for t, _ in p] for p in path] == [["body", "div", "p"], ["body", "div", "div"], ["body", "h1"], ["body", "h2"]]
    assert extract.leaf_blocks("<title> A &amp;\n B</title><p>x")[1] == "A & B"
    assert [b.linked for b in extract.leaf_blocks("<p><a href=x>ab</a> cd</p><div><a>ef</div>gh")[0]] == [2, 2, 0]


def test_many_open_tags_and_quotes_take_linear_time():
    assert len(texts("<div class=\"" * 5_000 + "x" + "<p>y" * 20_000)) > 0
    assert texts("<" * 100_000 + " z") == ["<" * 100_000 + " z"]


def field(rng, n):
    blocks = [extract.Block(rng.choice(["Home", "A sentence here.", "many words " * 9]), (("body", ""), (rng.choice(["p", "div"]), rng.choice(["", "class=ad"]))), 0) for _ in range(n)]
    feats = [extract.path_features(b.path) + extract.text_features(b, i, n, "", frozenset()) for i, b in enumerate(blocks)]
    return blocks, feats


def score(model, feats, labels):
    s = model.first[labels[0]] + model.last[labels[-1]] + sum(model.moves[a][b] for a, b in zip(labels, labels[1:]))
    return s + sum(model.weights.get(f, 0.0) for fs, y in zip(feats, labels) if y for f in fs)


def test_viterbi_is_the_best_of_all_labelings():
    rng = random.Random(1)
    for n in (1, 2, 5, 8):
        for _ in range(15):
            blocks, feats = field(rng, n)
            model = extract.Model({f: rng.gauss(0, 1) for fs in feats for f in fs}, frozenset(), np.array([[rng.gauss(0, 2) for _ in "ab"] for _ in "ab"]), np.array([rng.gauss(0, 1), 0.3]), np.array([0.1, rng.gauss(0, 1)]))
            best = max(itertools.product((0, 1), repeat=n), key=lambda y: score(model, feats, y))
            assert abs(score(model, feats, extract.Reader(model, most=1).labels(blocks, "")) - score(model, feats, best)) < 1e-9


def test_gradient_is_that_of_the_likelihood_over_all_labelings():
    rng = np.random.default_rng(2)
    sizes, features = [3, 1, 4], 5
    flat = [sorted(rng.choice(features, 2, replace=False).tolist()) for _ in range(sum(sizes))]
    ids, starts = np.concatenate([np.array(x) for x in flat]), np.cumsum([0] + [len(x) for x in flat])[:-1]
    inside = np.arange(4) < np.array(sizes)[:, None]
    y = np.where(inside, rng.integers(0, 2, inside.shape), 0)

    def likelihood(theta):
        model = extract.Model({i: theta[i] for i in range(features)}, frozenset(), theta[-8:-4].reshape(2, 2), theta[-4:-2], theta[-2:])
        out, at = 0.0, 0
        for page, n in enumerate(sizes):
            feats = flat[at:at + n]
            at += n
            out += score(model, feats, y[page, :n].tolist()) - np.logaddexp.reduce([score(model, feats, z) for z in itertools.product((0, 1), repeat=n)])
        return out
    theta = rng.normal(size=features + 8)
    got = extract._gradient(theta, ids, starts, np.repeat(np.arange(len(flat)), 2), inside, y)
    want = [(likelihood(theta + d) - likelihood(theta - d)) / 2e-5 for d in np.eye(len(theta)) * 1e-5]
    assert np.allclose(got, want, atol=1e-6)


def test_labels_of_labelled_pages_and_held_out_accuracy(model):
    hit, right, n = Counter(), 0, 0
    reader = extract.Reader(model)
    for page, text in labelled_pages(400, seed=99):
        blocks, title = extract.leaf_blocks(page)
        y = extract.label_blocks(blocks, text)
        assert "\n\n".join(b.text for b, v in zip(blocks, y) if v) == text
        got = reader.labels(blocks, title)
        hit.update(zip(y, got))
        right, n = right + (got == y), n + 1
    assert hit[1, 1] / (hit[1, 1] + hit[0, 1]) > 0.98 and hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.98 and right / n > 0.9


PARTS = {
    "menu": '<div class="nav-links"><ul><li><a href="/">Startpage</a></li><li><a href="/b">Politics</a></li></ul></div>',
    "cookie notice": '<div id="cookie-consent"><p>We would like to use cookies, as everybody does, to know you better. Please agree to it.</p><button>Fine</button></div>',
    "sidebar": '<aside><h3>Most read</h3><ul><li><a href="/1">A story about a bear that went away</a></li></ul></aside>',
    "search form": '<form action="/s"><label>Search this site</label><input><button>Go</button></form>',
    "reader comments": '<div class="comments"><h3>Comments</h3><div class="comment"><span>ann</span><p>I do not agree with any of this, sadly. It was better before, when all was well.</p></div></div>',
    "footer": '<footer><p>© 2024 The Paper. All rights reserved, in all countries.</p></footer>'}


@pytest.mark.parametrize("inner", ["article", 'div class="post-content"', "main"])
def test_parts_of_a_page_that_are_not_the_article(model, inner):
    reader = extract.Reader(model)
    body = ["The bear has left", "The bear left the forest on Monday, after many years in which it had lived there.", "Why?", "Nobody knows, said the ranger, and looked away for a while. Then it rained."]
    main = f'<{inner}><h1>{body[0]}</h1><p>{body[1]}</p><div class="advertisement">Buy our honey now, it is good.</div><h2>{body[2]}</h2><p>{body[3]}</p></{inner.split(" ")[0]}>'
    page = "<html><head><title>The bear has left</title></head><body>" + "".join(PARTS[p] for p in ("cookie notice", "menu", "search form")) + main + "".join(PARTS[p] for p in ("reader comments", "sidebar", "footer")) + "</body></html>"
    assert reader.main_text(page).split("\n\n") == body


def test_rows_of_any_kind(spark, model):
    rows = [(1, "u", "<article><h1>Title</h1><p>One sentence of the article, and more of it.</p></article>"), (2, None, None), (3, "e", ""), (None, "n", "<article><p>A page without an id has a text, as others have.</p></article>"), (1, "u", "<article><h1>Title</h1><p>One sentence of the article, and more of it.</p></article>"),
            (4, "long", "<article>" + "<p>Many paragraphs make a long page, of course.</p>" * 20_000 + "</article>"), (5, "s", "<script>only()</script>")]
    frame = spark.createDataFrame([(*r, "mine", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(2)
    out = extract.main_texts(frame, model)
    assert out.columns == ["page_id", "url", "n_chars", "text"]
    got = Counter((r.page_id, r.url, r.text) for r in out.collect())
    article = "Title\n\nOne sentence of the article, and more of it."
    assert got[1, "u", article] == 2 and got[2, None, ""] == 1 and got[3, "e", ""] == 1 and got[5, "s", ""] == 1
    assert got[None, "n", "A page without an id has a text, as others have."] == 1 and got[4, "long", "\n\n".join(["Many paragraphs make a long page, of course."] * 20_000)] == 1
    assert extract.main_texts(frame.filter("false"), model).count() == 0
