from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from galena.llm import decontamination, kernels, language, licenses, toxicity

BAD = ["grobnik", "fulmort", "skazzle", "wrent"]


def labelled(prose, n, first=0):
    rows, labels = [], []
    for k in range(n):
        words = prose.text(prose.rng.randint(30, 200)).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(prose.rng.randrange(len(words)), prose.rng.choice(BAD))
        rows.append((first + k, " ".join(words)))
        labels.append((first + k, 1, int(toxic)))
    return rows, labels


def test_toxic_documents_are_found_in_held_out_ones(spark, docs, prose):
    rows, labels = labelled(prose, 500)
    fit, rest = labels[:300], labels[300:]
    frame = spark.createDataFrame([*fit, (None, 1, 1), (fit[0][0], 0, 1)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    truth = {i: t for i, _, t in rest}
    odd = [(9001, None), (9002, ""), (9003, "!?."), (9004, rows[1][1] + " " + "ka lo mer " * 60_000), (None, rows[0][1]), (9005, rows[0][1]), (9005, rows[0][1])]
    found = toxicity.score(docs(rows + odd).withColumn("score", F.lit(1)).withColumn("toxic", F.lit(5)), frame).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r.doc_id: r.is_toxic for r in found}
    assert np.mean([by[i] == bool(t) for i, t in truth.items()]) > 0.97
    assert [by[k] for k in (9001, 9002, 9003, 9004, None, 9005)] == [False, False, False, False, True, True]
    kept = toxicity.keep_clean(docs(rows + odd).withColumn("toxicity", F.lit(1)), frame)
    assert kept.columns[-1] == "toxicity"
    assert sorted((r.doc_id or -1) for r in kept.select("doc_id").collect()) == sorted((r.doc_id or -1) for r in found if not r.is_toxic)


def gram_counts(text, orders, bits):
    """Buckets of the n-grams of one text, gram by gram."""
    plain = "".join(c if c.isalnum() else " " for c in f" {text.lower()} ")
    while "  " in plain:
        plain = plain.replace("  ", " ")
    out = Counter()
    for k, n in enumerate(orders):
        for i in range(len(plain) - n + 1):
            h = 0
            for c in plain[i : i + n]:
                h = (h * 0x01000193 + (ord(c) + 0x9E37) * 0x85EBCA6B) % 2**32
            b = (h ^ h >> 15) * (0x2C1B3C6D + 2 * n) % 2**32
            out[k << bits | (b ^ b >> 13) * 0x9E3779B1 % 2**32 >> 32 - bits] += 1
    return out


def test_toxicity_is_that_of_brute_force(spark, docs, prose):
    rows, labels = labelled(prose, 200)
    p = toxicity.Params()
    texts, marks = [t for _, t in rows], [t for _, _, t in labels]
    model = toxicity.fit(texts, marks, p)
    counts = [gram_counts(t, p.orders, p.bits) for t in texts]
    train = [k for k in range(len(texts)) if k % 5 != 4]
    seen = {c: Counter(b for k in train if marks[k] == c for b in counts[k]) for c in (0, 1)}
    size = {c: sum(marks[k] == c for k in train) for c in (0, 1)}
    for b, ratio in zip(model.buckets[:500].tolist(), model.ratios[:500], strict=True):
        want = np.log((seen[1][b] + p.alpha) / (size[1] + 2 * p.alpha)) - np.log((seen[0][b] + p.alpha) / (size[0] + 2 * p.alpha))
        assert ratio == pytest.approx(want)
    weight = dict(zip(model.buckets.tolist(), model.weights, strict=True))
    want = {k: sum(weight.get(b, 0) * n for b, n in c.items()) / (sum(c.values()) + p.prior) - model.threshold for k, c in enumerate(counts)}
    got = toxicity.with_score(docs([(k, t) for k, t in enumerate(texts)]), model, "score")
    for r in got.collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-5)


def test_samples_take_ids_of_any_type_and_one_text_an_id(spark, docs, prose):
    rows, labels = labelled(prose, 40)
    frame = docs([*rows, *((0, f"other {k} words") for k in range(30))]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    first = toxicity.sample(frame, marks)
    assert len(first[0]) == 40 and first == toxicity.sample(frame.repartition(7), marks)
    assert toxicity.score(frame, marks).count() == 70
    langs = language.sample(frame)
    assert len(langs[0]) == 40 and langs == language.sample(frame.repartition(5))


def test_toxicity_without_labels_or_documents(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs([(1, "a"), (2, None)]), none).collect()
    assert [(r.score, r.is_toxic) for r in got] == [(None, False)] * 2
    assert toxicity.keep_clean(docs([(1, "a"), (2, None)]), none).count() == 2
    assert toxicity.score(docs([]), none).count() == 0


def sellers(pattern, text):
    """Least edits between the pattern and a part of the text."""
    text, slope = np.asarray(text), np.arange(len(text) + 1)
    cost = np.zeros(len(text) + 1, int)
    for p in pattern:
        step = cost + 1
        step[1:] = np.minimum(step[1:], cost[:-1] + (text != p))
        cost = np.minimum.accumulate(step - slope) + slope
    return cost.min()


def edited(rng, text, n, letters):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 2)] = [rng.choice(letters)] if kind else []
    return "".join(out)


def test_leaks_are_those_of_brute_force(spark, docs, prose):
    rng, letters = prose.rng, "abcdefgh ij"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, text(rng.choice([25, 30, 80, 140, 260]))) for i in range(12)] + [(50, None), (51, "short"), (52, "")]
    rows = []
    for k in range(60):
        whole = rng.choice(items[:12])[1]
        at = rng.randrange(max(1, len(whole) - 120))
        rows.append((k, f"{text(rng.randrange(200))} {edited(rng, whole[at : at + 160], rng.randrange(14), letters)} {text(rng.randrange(200))}"))
    rows += [(90, None), (91, ""), (92, items[3][1].upper().replace(" ", " - ")), (None, items[3][1]), (93, text(300_000) + items[4][1]), (94, items[4][1]), (94, items[4][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    frame = docs(rows).withColumn("item_id", F.lit("x")).withColumn("leaking", F.lit(True))
    got = sorted([tuple(r) for r in decontamination.leaks(frame, bench).collect()], key=str)
    windows = decontamination.windows([i for i in items if i[1]])
    edits = decontamination.budget(windows.lengths, windows.p)
    want = []
    for doc, t in rows:
        if not t or len(t) > 10_000:
            continue
        codes = kernels.padded([t])[0].tolist()
        by = {}
        for k, w in enumerate(windows.texts):
            if (e := sellers(w.tolist(), codes)) <= edits[k]:
                n, least = by.get(windows.items[k], (0, 99))
                by[windows.items[k]] = n + 1, min(least, int(e))
        want += [(doc, windows.ids[i], n, e) for i, (n, e) in by.items()]
    assert len(want) > 25
    assert [g for g in got if g[0] != 93] == sorted(want, key=str)
    assert {g[1] for g in got if g[0] == 93} >= {4}
    kept = decontamination.keep_unleaked(frame, bench)
    assert kept.columns == frame.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([r for r in rows if r[0] not in {g[0] for g in got}], key=str)
    # in parts, as a large benchmark goes
    small = decontamination.Params(part_chars=200)
    assert len(decontamination.parts(bench, small)) > 3
    assert sorted([tuple(r) for r in decontamination.leaks(frame, bench, small).collect()], key=str) == got
    assert decontamination.leaks(frame, bench.limit(0)).count() == 0
    assert decontamination.keep_unleaked(frame, bench.limit(0)).count() == len(rows)
    assert decontamination.leaks(frame.limit(0), bench).count() == 0


def test_every_part_as_long_as_a_window_is_found(prose, monkeypatch):
    item, other = prose.text(60), prose.text(40)
    scanner = decontamination.Scanner(decontamination.windows([(1, item), (2, other)]))
    parts = [item[s : s + 100] for s in range(len(item) - 99)]
    assert len(parts) > 200
    around = [f"qxj zzk {x} wwy jjq" for x in parts]
    whole = scanner.scan(around)
    assert set(whole[0].tolist()) == set(range(len(parts)))
    # a text's bands are the same when counted in many shares
    long = [" ".join(around[::40] + [other] * 3)]
    want = [x.tolist() for x in scanner.scan(long)]
    monkeypatch.setattr(decontamination, "ENTRIES", 50)
    assert [x.tolist() for x in scanner.scan(long)] == want and want[1] == [0, 1]
    assert [x.tolist() for x in scanner.scan(around)] == [x.tolist() for x in whole]


def test_notices_are_those_of_a_search_without_seeds(spark, docs, prose):
    rng, wanted = prose.rng, licenses.notices()
    letters = "abcdefghij lnrst"
    rows = []
    for k in range(14):
        n = rng.choice(list(licenses.NOTICES.values()))
        rows.append((k, f"{prose.text(rng.randrange(40))} {edited(rng, n, rng.randrange(len(n) // 8), letters)}\n{prose.text(rng.randrange(40))} {rng.choice([n, '', n.upper()])}"))
    rows += [(900, None), (901, ""), (902, "ALL\tRIGHTS\nReserved"), (None, "all rights reserved"), (903, "all rights reserved " * 8), (904, "Licensed under the Apache License, Version 2.0"), (904, "Licensed under the Apache License, Version 2.0")]
    want = []
    for i, t in rows:
        plain = (t or "").translate(licenses.PLAIN)
        for n in wanted:
            pattern = regex.compile(f"(?e)(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}")
            want += [(i, n.name, m.start(), m.end(), sum(m.fuzzy_counts)) for m in pattern.finditer(plain)]
    got = [tuple(r) for r in licenses.scan(docs(rows).withColumn("notice", F.lit(1)).withColumn("start", F.lit(1))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(docs([])).count() == 0


def test_every_license_line_of_the_documents_is_found(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect()]
    lines = {x for t in texts for x in t.split("\n") if regex.search(r"(?i)licen[sc]e|rights reserved", x)}
    assert "Licensed under CC BY-NC 4.0." in lines and len(lines) >= 5
    searcher = licenses.Searcher(licenses.notices())
    assert [x for x in lines if not searcher.search(x)] == []
    names = lambda t: {r[0] for r in searcher.search(t)}
    for terms in ("BY 4.0", "BY-SA 3.0", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND", "0 1.0"):
        short = "CC0 1.0" if terms == "0 1.0" else f"CC {terms}"
        assert names(f"Licensed under {short}.") and names(f"This page is available under {short.replace(' BY', '-BY')}"), terms
    assert "cc-by-nc" in names("Licensed under CC BY-NC 4.0.") and not any(n.startswith("cc0") for n in names("Licensed under CC BY-NC 4.0."))
    assert not any(n.startswith("cc-by") for n in names("Licensed under CC0."))
    assert not names("access by road, 1fcc0a9")


def test_languages_of_held_out_documents(spark, docs, prose):
    syllables = {"aa": "ka lo mer ti sun", "bb": "ka zu mer xi wob", "cc": "dra vel lo po ni", "dd": "qua wob sun ni ti"}
    rng, rows, truth = prose.rng, [], {}
    for k in range(400):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(15, 120)))
        known = k < 240
        rows.append((k, text, lang if known else None))
        if not known:
            truth[k] = lang
    odd = [(900, None, "aa"), (901, "", None), (902, "?!", "bb"), (None, rows[0][1], None), (903, "ka lo mer " * 50_000, None)]
    frame = docs(rows + odd).withColumn("language", F.lit(1)).withColumn("gap", F.lit("x"))
    got = {r.doc_id: r for r in language.identify(frame).collect()}
    assert len(got) == len(rows) + len(odd)
    assert np.mean([got[k].language == v for k, v in truth.items()]) > 0.97
    assert [(got[k].language, got[k].ambiguous) for k in (900, 901, 902)] == [(None, True)] * 3
    assert got[903].language == "aa"
    one = language.identify(docs([(1, "a b"), (2, None)])).collect()
    assert [(r.language, r.ambiguous) for r in one] == [(None, True)] * 2
    assert language.identify(docs([])).count() == 0


def test_languages_are_those_of_brute_force(prose):
    texts = [" ".join(prose.rng.choice(v.split()) for _ in range(60)) for v in ("ka lo mer", "zu xi wob", "dra vel po")] * 20
    texts = [t + f" {k}" for k, t in enumerate(texts)]
    p = language.Params(steps=40)
    model = language.fit(texts, ["aa", "bb", "cc"] * 20, p)
    for text, margin in zip(texts[:9], language.margins(texts[:9], model), strict=True):
        counts = gram_counts(text, p.orders, p.bits)
        want = sum(model.table[b] * n for b, n in counts.items()) / sum(counts.values()) + model.bias
        assert margin == pytest.approx(want, abs=1e-4)
        loss = [sum(w * np.log1p(np.exp(-m * c)) for w, m, c in zip(model.weight, margin, code, strict=True)) for code in model.code]
        best, gap = language.decode(margin[None], model)
        assert best[0] == int(np.argmin(loss)) and gap[0] == pytest.approx(np.diff(sorted(loss))[0], abs=1e-9)
    # equal losses: the first in the alphabet, and ambiguous
    best, gap = language.decode(np.zeros((1, model.code.shape[1])), model)
    assert best[0] == 0 and gap[0] == pytest.approx(0)


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9, 20):
        code = language.codewords(k)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 4)
        assert set(np.unique(code)) == {-1, 1}
