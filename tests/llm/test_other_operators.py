import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statweave.llm import chat, topk, warc
from statweave.llm.shared import shared_folder, shingles, word_hashes

# exact top k ------------------------------------------------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)], 0) for i in range(300)]                       # many ties
    rows += [(400, None, 0), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] * 6, 0), (404, [0.5, 0.25], 0), (406, [1.0, 1.0], 0), (408, [], 0), (410, [1e15] * 6, 0),
             (7, rows[7][1], 0), (None, rows[3][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    q = topk.quantised(frame, scale=4)
    out = topk.top_k(q, q.filter("vec_id % 2 = 0"), k=4, query_block=40, shard_rows=50, groups=3).collect()
    data = [(i, [int(np.floor(x * 4)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for i, v in data:
        if i % 2 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, u)), j) for j, u in data if j != i and len(u) == len(v)))
            want[i] = [(k + 1, j, -x) for k, (x, j) in enumerate(s[:4])]
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert dict(got) == {i: v for i, v in want.items() if v and abs(v[0][2]) < 2 ** 62}
    assert topk.top_k(q.filter("false"), q, k=3).count() == 0 and topk.top_k(q, q.filter("false"), k=3).count() == 0


# WARC -------------------------------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>\r\n\r\nWARC/1.1\r\n" if i % 3 else f"é<p>{i}</p>") for i in range(40)]
    rows += [(50, None, None), (51, "http://e/\r\nX: y", ""), (52, "u", "long " * 100_000), (None, "http://n", "no id"), (3, "http://h/3", rows[3][2]), (53, "u", "<p>1</p>\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, digest string"), rows


def test_warc_round_trip(spark, pages):
    frame, rows = pages
    out = warc.captures_of_pages(spark, frame.repartition(3)).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max([x for x in (last.get(h or ""), i) if x is not None], default=None)
    want, got = Counter(), Counter()
    for i, u, h in rows:
        kind = "response" if i == last[h or ""] else "revisit"
        sha = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        want[i, None if u is None else u.replace("\r", "%0D").replace("\n", "%0A"), kind, len((h or "").encode()), sha, (h or "") if kind == "response" else None, last[h or ""] if kind == "revisit" else None] += 1
    for r in out:
        a = r.answer
        body = bytes(a.block).partition(b"\r\n\r\n")[2].decode()
        fields = dict(x.split(": ") for x in bytes(r.metadata.block).decode().split("\r\n") if x)
        number = lambda k: int(fields[k]) if k in fields else None
        got[number("page-id"), a.url, a.warc_type, a.payload_bytes, a.computed_digest or a.payload_digest, body if a.warc_type == "response" else None, number("refers-to-page")] += 1
        assert r.request is not None and a.payload_digest == (a.computed_digest or a.payload_digest)
    assert got == want


def test_warc_minimum_and_no_rows(spark, pages):
    frame, _ = pages
    kinds = Counter(r.answer.warc_type for r in warc.captures_of_pages(spark, frame, minimum=10 ** 6, blocks=False).select("answer").collect())
    assert set(kinds) == {"response"}
    assert warc.captures_of_pages(spark, frame.filter("false")).count() == 0


def test_warc_reads_plain_files_and_members(spark, tmp_path):
    record = lambda body: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:" + body[:1] + b">\r\nContent-Length: %d\r\n\r\n" % (len(body) + 19) + b"HTTP/1.1 200 OK\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record(b"1\r\n\r\n") + record(b"2"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(b"3")) + gzip.compress(record(b"4" * 3_000_000)))
    got = warc.read_records(spark, f"file://{tmp_path}").collect()
    assert sorted(bytes(r.block)[19:24] for r in got) == [b"1\r\n\r\n", b"2", b"3", b"44444"] and sorted(r.payload_bytes for r in got) == [1, 1, 5, 3_000_000]


# chat -------------------------------------------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["</s>", "[INST] ", " [/INST]", "<s>", "<<SYS>>", " <</SYS>>", "[TURN]", "\\", "\\\\", "\\e", "é", "\n", "text", " ", "<", "</", "]", "n"]
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", "tool\nx", None]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(7)))))
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (99, None, "assistant", "first"), (99, 0, "user", "second"), (98, 1, "assistant", "same"), (98, 1, "assistant", "same")]
    rows += [(97, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    frame = spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, segments string").repartition(5)
    formatted = chat.format_conversations(frame)
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in formatted.select("conv_id", chat.read_turns(text).alias("turns")).collect()}
    want = defaultdict(list)
    for c, t, role, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want[c].append((role or "", x or ""))
    assert got == dict(want)
    examples = defaultdict(list)
    for r in chat.expand(formatted).select("*", chat.unescaped(F.col("target")).alias("reply")).collect():
        examples[r.conv_id].append((r.example, r.context, r.reply))
    for c, turns in want.items():
        found = sorted(examples.get(c, []))
        assert [x[2] for x in found] == [x for role, x in turns if role == "assistant"]
        assert all(b[1].startswith(a[1]) for a, b in zip(found, found[1:]))
    assert chat.format_conversations(frame.filter("false")).count() == 0


def test_op8_reads_everything_from_its_examples(spark, tmp_path, monkeypatch):
    rows = [(1, 0, "user", "q [INST]"), (1, 1, "assistant", "a\\b"), (1, 2, "assistant", ""), (1, 3, "user", "more"), (2, 0, "system", "s"), (None, 0, "assistant", "lone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op8_prefix_target_expansion(spark, str(tmp_path)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (4, 3), 2: (1, 0), None: (1, 4), -1: (2, 21)}
    chain = chat.steps(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert sorted((r.example, r.target) for r in chain.filter("conv_id = 1").collect()) == [(2, "a\\\\b"), (4, ""), (7, None)]
    true = chat.steps
    monkeypatch.setattr(chat, "steps", lambda formatted: true(formatted).withColumn("added", F.concat(F.col("added"), F.lit("<s>"))))
    bad = {r.conv_id: r for r in chat.op8_prefix_target_expansion(spark, str(tmp_path)).collect()}
    assert all(bad[k].turns_sha256 != r.turns_sha256 and bad[k].formatted_chars > r.formatted_chars for k, r in got.items())


def test_op8_makes_and_reads_every_whole_context(spark, tmp_path, monkeypatch):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn <{t}</s>é") for t in range(12)] + [(2, 0, "user", "no reply"), (3, 0, "assistant", ""), (3, 1, "assistant", "</"), (3, 2, "assistant", "s>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    formatted = chat.format_conversations(frame)
    text = {r.conv_id: r.text for r in formatted.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text")).collect()}
    through = {(r.conv_id, r.example): hashlib.sha256((r.context + r.target).encode()).hexdigest() for r in chat.expand(formatted).collect()}
    chain = chat.steps(formatted).collect()
    assert {(r.conv_id, r.example): r.through for r in chain if r.target is not None} == through and len(through) == 9
    assert {r.conv_id: "".join(s.added + (s.target or "") for s in sorted(chain, key=lambda s: s.example) if s.conv_id == r.conv_id) for r in chain} == text
    true = chat.expand
    lost = F.when(F.col("example") < 15, F.col("context")).otherwise(F.regexp_replace("context", "turn <0", "turn <"))                    # late contexts lack a character of the first turn
    monkeypatch.setattr(chat, "expand", lambda *a, **k: true(*a, **k).withColumn("context", lost))
    with pytest.raises(Exception, match="not what precedes it in conversation 1"):
        chat.op8_prefix_target_expansion(spark, str(tmp_path)).collect()


# shared -----------------------------------------------------------------------------------------------------------------------------------------------------


def test_word_hashes_and_shingles():
    import pyarrow as pa
    texts = ["Ab  cd\x0bEF\x1c", None, "", "ab", "É é", "x", " ab", "a b c d e f", "A B C D E", "y " * 3]
    h, first, begin, end = word_hashes(pa.array(texts), spans=True)
    seen = {}
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        assert first[i + 1] - first[i] == len(words)
        for w, k in zip(words, h[first[i]:first[i + 1]]):
            assert seen.setdefault(w, k) == k
    assert len(set(seen.values())) == len(seen) and (end > begin).all()
    five = lambda i: shingles(h[first[i]:first[i + 1]])
    assert len(five(7)) == 2 and set(five(8)) < set(five(7)) and len(five(1)) == 0 and len(five(3)) == 1


def test_shared_folder_is_new(spark):
    assert shared_folder(spark) != shared_folder(spark)
