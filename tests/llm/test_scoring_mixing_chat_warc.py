import io
import math
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from galena.llm import chat, lm_scoring, mixing, warc
from galena.llm.common import scratch


def test_scores_are_those_of_brute_force(spark, docs, prose):
    p = lm_scoring.Params()
    rows = [(k, " ".join(prose.rng.choice(prose.vocabulary[: 60 if k % 3 else 300]) for _ in range(prose.rng.randint(1, 60)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "12 -- 3"), (503, rows[0][1]), (503, rows[0][1]), (None, rows[1][1]), (504, "ka lo " * 20_000)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 120, 2)] + [(0, 1, 0), (None, 1, 0), (777, 1, 1)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    words = {n: [w for w in (t or "").lower().split() if w.isalpha()] for n, (_, t) in enumerate(rows)}
    uni, pair, hist = ({m: Counter() for m in "tb"} for _ in range(3))
    for n, (i, _) in enumerate(rows):
        for m in "tb" if i is not None and i in good else "b":
            uni[m].update(words[n])
            pair[m].update(zip(["<s>", *words[n]], words[n], strict=False))
            hist[m].update(["<s>", *words[n]][: len(words[n])])
    def counts(own):
        return {"h": Counter(["<s>", *own][: len(own)]), "p": Counter(zip(["<s>", *own], own, strict=False)), "w": Counter(own), "n": len(own)}

    total = {m: sum(uni[m].values()) for m in "tb"}

    def share(h, w, m, left):
        """The share of w after h in model m of the documents other than one with these counts."""
        followed = hist[m][h] - left["h"][h]
        unigram = (uni[m][w] - left["w"][w] + 1) / (total[m] - left["n"] + len(uni["b"]))
        return p.weight * (pair[m][h, w] - left["p"][h, w]) / followed + (1 - p.weight) * unigram if followed else unigram

    # the shares of all words after a history are one
    for h in ("<s>", "ka", *list(hist["b"])[:3]):
        for own in ([], words[5]):
            assert sum(share(h, w, "b", counts(own)) for w in uni["b"]) == pytest.approx(1)
    clashing = docs(rows).withColumns({c: F.lit(1) for c in ("score", "words", "block", "good", "pair")})
    want = []
    for n, (i, _) in enumerate(rows):
        mine = {"t": counts(words[n] if i is not None and i in good else []), "b": counts(words[n])}
        each = [[-math.log(share(h, w, m, mine[m])) for h, w in zip(["<s>", *words[n]], words[n], strict=False)] for m in "tb"]
        want.append((i, len(words[n]), *(np.mean(e) if e else None for e in each)))
    want.sort(key=lambda r: (str(r[0]), r[1]))
    for size, keys in ((lm_scoring.BLOCK_CHARS, lm_scoring.BUCKET_KEYS), (500, 300)):
        got = sorted(lm_scoring.score(clashing, labels, p, size, keys).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert (g.doc_id, g.n_tokens) == w[:2]
            if w[1]:
                assert g.loss_target == pytest.approx(w[2], abs=2e-6) and g.loss_background == pytest.approx(w[3], abs=2e-6) and g.score == pytest.approx(w[2] - w[3], abs=2e-6)
            else:
                assert g.score is None and g.loss_target is None
    assert lm_scoring.score(docs([]), labels).count() == 0
    assert lm_scoring.score(docs([(1, None), (None, "")]), labels).count() == 2
    texts = docs([(1, "a b"), (2, None)]).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert [r.n_tokens for r in lm_scoring.score(texts, labels.limit(0)).orderBy("doc_id").collect()] == [2, 0]


def corpus(prose):
    rng = prose.rng
    return [(k, prose.text(int(rng.lognormvariate(3.5, 0.8)) + 1), rng.choice(["en", "de", None]), rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None])) for k in range(1500)]


def test_rates_meet_the_constraints_and_those_of_direct_minimisation(spark, docs, prose):
    rows = [*corpus(prose), (9000, None, "en", "a"), (9001, "", "en", "b")]
    targets = {"a": 2.0, "b": 2.0, "c": 1.0, None: 1.0, "absent": 5.0}
    got = mixing.rates(docs(rows).withColumn("rate", F.lit(3)), targets).collect()
    assert len(got) == len(rows)
    n, r = np.array([g.n_tokens for g in got], float), np.array([g.rate for g in got])
    some = n > 0
    assert all(g.rate == 1 and g.copies == 1 for g in got if g.n_tokens == 0)
    shares = {s: sum(n[i] * r[i] for i, g in enumerate(got) if g.source == s and some[i]) / n.sum() for s in ("a", "b", "c", None)}
    assert shares == pytest.approx({"a": 2 / 6, "b": 2 / 6, "c": 1 / 6, None: 1 / 6}, abs=1e-6)
    assert all(abs(g.copies - g.rate) < 1 for g in got)
    assert sum(g.copies * g.n_tokens for g in got) == pytest.approx(n.sum(), rel=0.1)
    # gradient descent on the same dual, row by row
    z = np.log1p(n[some])
    m = n[some] / n.sum()
    z = (z - m @ z) / math.sqrt(m @ z**2 - (m @ z) ** 2)
    who = [g for g, k in zip(got, some, strict=True) if k]
    tongue = {v: sum(m[i] for i, g in enumerate(who) if g.lang == v) ** 0.7 for v in ("en", "de", None)}
    x = np.column_stack([*([g.source == s for g in who] for s in shares), *([g.lang == v for g in who] for v in tongue), z]).astype(float)
    want = np.array([2 / 6, 2 / 6, 1 / 6, 1 / 6, *(v / sum(tongue.values()) for v in tongue.values()), 0])
    ridge = np.array([0] * 4 + [mixing.RIDGE] * 4)
    theta = np.zeros(8)
    for _ in range(60):
        w = m * np.exp(x @ theta)
        theta -= np.linalg.lstsq((x.T * w) @ x + np.diag(ridge), x.T @ w - want + ridge * theta, rcond=1e-13)[0]
    assert r[some] == pytest.approx(np.exp(x @ theta), rel=1e-4)


def test_rates_without_a_target_and_with_many_sources(spark, docs, prose):
    rows = corpus(prose)
    assert {r.rate for r in mixing.rates(docs(rows), targets={"absent": 1.0}).where("n_tokens > 0").collect()} == {0.0}
    assert {r.copies for r in mixing.rates(docs(rows), targets={"a": 0.0}).where("n_tokens > 0").collect()} == {0}
    many = docs([(i, t, lang, f"{s}{i % 60}") for i, t, lang, s in rows])
    found = mixing.rates(many).collect()
    tokens, kept = Counter(), Counter()
    for r in found:
        tokens[r.source] += r.n_tokens
        kept[r.source] += r.n_tokens * r.rate
    whole = sum(n**0.5 for n in tokens.values())
    for s, n in kept.items():
        assert n / sum(tokens.values()) == pytest.approx(tokens[s] ** 0.5 / whole, rel=1e-5)


def test_mixed_repeats_rows_by_their_copies(spark, docs, prose):
    rows = corpus(prose)[:300]
    frame = docs(rows).withColumn("copies", F.lit(9)).withColumn("copy", F.lit("x"))
    copies = {r.doc_id: r.copies for r in mixing.rates(docs(rows), {"a": 1, "b": 0, "c": 4, None: 1}).collect()}
    out = mixing.mixed(frame, {"a": 1, "b": 0, "c": 4, None: 1})
    assert out.columns[:7] == frame.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == {k: v for k, v in copies.items() if v}
    assert not any(r.source == "b" for r in out.collect())
    assert mixing.rates(docs([])).count() == 0
    assert mixing.mixed(docs([(1, None), (2, "")])).count() == 2


def test_chats(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b <|end|>"), (1, None, None, None), (2, 0, "user", ""), (2, 0, "user", ""), (None, 0, "system", "s"), (None, 1, "system", "s"), (3, 5, "b", "x"), (3, 5, "a", "y")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("chat", F.lit(1)).withColumn("turns", F.lit(2)).withColumn("runs", F.lit(2))
    found = chat.format_chats(frame).collect()
    assert len(found) == 5
    got = {r.conv_id: (r.n_turns, r.n_messages, r.chat) for r in found}
    assert got == {
        1: (4, 3, "<|user|>\na\n\nb < |end|><|end|>\n<|assistant|>\nc<|end|>\n<|unknown|>\n<|end|>\n"),
        2: (2, 1, "<|user|>\n\n\n<|end|>\n"),
        None: (1, 1, "<|system|>\ns<|end|>\n"),
        3: (2, 2, "<|a|>\ny<|end|>\n<|b|>\nx<|end|>\n"),
    }
    assert chat.format_chats(frame.limit(0)).count() == 0
    many = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t" * 1000).alias("text"))
    r = chat.format_chats(many).first()
    assert (r.n_turns, r.n_messages, len(r.chat)) == (3000, 1, 3000 * 1002 - 2 + len("<|user|>\n<|end|>\n"))


def archive(records, dictionary=None, packed=True):
    out = b""
    data = None
    if dictionary:
        data = zstandard.ZstdCompressionDict(dictionary)
        content = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
        out += struct.pack("<II", warc.DICTIONARY, len(content)) + content
    encoder = zstandard.ZstdCompressor(dict_data=data)
    return out + b"".join(encoder.compress(r) for r in records)


def good(k, block=b"body"):
    return warc.record("resource", f"<urn:page:{k}>", "2024-01-01T00:00:00Z", block, f"http://x/{k}")


def test_frames_with_dictionaries_and_skippable_frames():
    records = [good(k, b"text of page %d " % k * (k % 30)) for k in range(400)]
    trained = zstandard.train_dictionary(4096, records).as_bytes()
    for data in (archive(records), archive(records, trained), archive(records, trained, False)):
        assert [c for _, c, e in warc.Frames(io.BytesIO(data))] == records
    odd = archive(records[:2]) + struct.pack("<II", 0x184D2A50, 3) + b"abc" + archive(records[2:4])
    assert [c for _, c, e in warc.Frames(io.BytesIO(odd))] == records[:4]
    assert list(warc.Frames(io.BytesIO(b""))) == []


def test_broken_archives_give_rows_with_errors(spark, tmp_path):
    whole = archive([good(1), good(2)])
    wrong = [
        good(3).replace(b"WARC/1.1", b"HTTP/1.1"),
        good(4).replace(b"WARC-Date", b"X-Date"),
        good(5).replace(b"Content-Length: 4", b"Content-Length: 400"),
        good(6).replace(b"Content-Length: 4", b"Content-Length: 2"),
        good(7).replace(b"Content-Length: 4", b"Content-Length: four"),
        good(8).replace(b"WARC-Date:", b"WARC Date"),
        good(8).replace(b"Content-Length: 4", b"Content-Length: 99999999999999999999999"),
        good(8).replace(b"Content-Length: 4", b"Content-Length: " + b"9" * 5000),
    ]
    files = {"a": whole, "b": archive(wrong) + archive([good(9)]), "c": whole[:-3], "d": whole + b"junk and more", "e": b"", "f": struct.pack("<II", warc.DICTIONARY, 90) + b"short", "g": whole[:20] + b"\x99\x98" + whole[22:]}
    for name, data in files.items():
        (tmp_path / f"{name}.warc.zst").write_bytes(data)
    got = warc.read_archives(warc.list_archives(spark, str(tmp_path))).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.place):
        by[r.path.rsplit("/", 1)[1][0]].append(r)
    assert [r.error for r in by["a"]] == [None, None]
    assert bytes(by["a"][0].block) == b"body" and by["a"][1].uri == "http://x/2"
    assert [r.error is None for r in by["b"]] == [False] * 8 + [True]
    assert by["b"][6].content_length is None and by["b"][7].content_length is None
    assert [r.error is None for r in by["c"]] == [True, False]
    assert [r.error is None for r in by["d"]] == [True, True, False]
    assert not by["e"] and [r.error is None for r in by["f"]] == [False]
    assert by["g"][-1].error or len(by["g"]) == 2


def test_blocks_that_are_not_utf8(spark):
    frame = spark.createDataFrame([(1, "äß".encode()), (2, "äß".encode("latin-1")), (3, None), (4, b"")], "k int, block binary")
    got = {r.k: r.text for r in frame.select("k", warc.text_of(F.col("block")).alias("text")).collect()}
    assert got == {1: "äß", 2: "äß", 3: None, 4: ""}


def test_records_that_are_too_large(monkeypatch):
    monkeypatch.setattr(warc, "RECORD_BYTES", 1000)
    found = list(warc.Frames(io.BytesIO(archive([good(1), good(2, b"x" * 100_000), good(3)]))))
    assert [e is None for _, _, e in found] == [True, False, True]


def test_round_trip(spark):
    rows = [(k, f"http://x/{k}\r\nEvil: 1" if k % 7 == 0 else f"http://x/{k}", f"<p>é page {k}</p>" * (k % 40)) for k in range(600)] + [(700, None, "x"), (701, "u", None), (None, "u", "y"), (702, "u", "r\r\n\r\n"), (702, "u", "r\r\n\r\n"), (703, "u", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("block", F.lit(1)).repartition(3)
    found = warc.read_archives(warc.write_archives(pages, scratch(spark, "test"))).collect()
    assert all(r.error is None for r in found)
    got = Counter((r.record_id, r.uri, bytes(r.block).decode()) for r in found)
    want = Counter((f"<urn:page:{'' if i is None else i}>", u and u.replace("\r", "%0D").replace("\n", "%0A"), h or "") for i, u, h in rows)
    assert got == want
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch(spark, "test"))).count() == 0
