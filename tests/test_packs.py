"""Layers of files, packs within budgets and their rendering."""

import json
import random

import pytest
from pyspark.sql import functions as F

from galena.functions import ids
from galena.functions.tokens import counted, encoding, token_count
from galena.operators import layers, packs
from galena.sources import parse

TS = 'export function format(name) {\n  const p = "hi ";\n  return p + name;\n}\n\nexport class Greeter {\n  greet(name) {\n    return format(name);\n  }\n}\n'
PY = "def foo(x):\n    return bar(x)\n\nclass Animal:\n    def speak(self):\n        return 2\n"
CANDIDATES = "path string, cost_full bigint, cost_skeleton bigint, cost_outline bigint, importance double, pinned boolean"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def rendered(spark, *named):
    rows = [(p, "typescript" if p.endswith("ts") else "python" if p.endswith("py") else "unknown", c) for p, c in named]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    return packs.rendered(parse.parse_files(files), files)


def one(packed):
    return {r.path: r for r in packed.files.collect()}


def test_layers_by_budget(spark):
    files = rendered(spark, ("greet.ts", TS)).cache()
    assert one(packs.compress(files, budget=100_000))["greet.ts"].layer == "full"
    tiny = packs.compress(files, budget=1)
    assert one(tiny)["greet.ts"].layer == "omit" and tiny.total == 0 and tiny.fits
    pinned = packs.compress(files, budget=1, always_full=["*.ts"])
    assert one(pinned)["greet.ts"].layer == "full" and not pinned.fits


def test_skeletons_keep_signatures_and_can_be_expanded(spark):
    packed = packs.compress(rendered(spark, ("greet.ts", TS), ("notes.txt", "a b")), strategy="skeleton")
    content = one(packed)["greet.ts"].content
    assert "function format(name) { // … cv:" in content and "class Greeter {\n  greet(name) { // …" in content
    assert 'const p = "hi "' not in content
    assert one(packed)["notes.txt"].content == "a b"
    entries = {r.name: r for r in packed.expand.collect()}
    assert entries["format"].id == ids.short_id("greet.ts", "format") and "Greeter::greet" in entries
    files = spark.createDataFrame([("greet.ts", TS)], "path string, content string")
    text = {r.name: r.text for r in packs.expanded(packed.expand, files).collect()}
    assert text["format"].startswith("function format") and 'const p = "hi "' in text["format"]


def test_outlines_are_indented_by_scope(spark):
    content = one(packs.compress(rendered(spark, ("animal.py", PY)), strategy="outline"))["animal.py"].content
    assert content == "def foo(x)\nclass Animal\n  def speak(self)"


def test_rendering(spark):
    rows = [("src/a.ts", "typescript", "full", "x < 1 && y\n```js\n", 3), ("src/lib/b.py", "python", "outline", "def b()", 2), ("gone.md", "unknown", "omit", "", 0), ("ä\"b.txt", "unknown", "full", 'say "no"\n', 2)]
    files = spark.createDataFrame(rows, "path string, language string, layer string, content string, tokens bigint")
    packed = packs.Compressed(files, spark.createDataFrame([], "id string"), 7, 10)
    xml, markdown, data = packs.render(packed, "xml"), packs.render(packed, "markdown"), json.loads(packs.render(packed, "json"))
    assert 'token_count="7" expandable="0"' in xml and "x &lt; 1 &amp;&amp; y" in xml and "<file path=\"gone.md\"" not in xml
    assert "````typescript\nx < 1" in markdown and "### src/lib/b.py  `[outline]`" in markdown and markdown.endswith("```")
    assert [f["path"] for f in data["files"]] == ['ä"b.txt', "src/a.ts", "src/lib/b.py"] and data["files"][0]["content"] == 'say "no"\n'
    assert data["directoryStructure"].split("\n") == ["src/", "  lib/", "    b.py  [outline]", "  a.ts  [full]", 'ä"b.txt  [full]', "gone.md  [omit]"]
    nothing = packs.Compressed(files.limit(0), spark.createDataFrame([], "id string"), 0, 10)
    assert json.loads(packs.render(nothing, "json"))["files"] == []
    assert packs.render(nothing, "xml").endswith("<files>\n</files>\n</galena>")
    with pytest.raises(ValueError):
        packs.render(packed, "pdf")
    plain = [r.line for r in packs.tree_lines(files.where("path like 'src%'"), show_layers=False).orderBy("place").collect()]
    assert plain == ["src/", "  lib/", "    b.py", "  a.ts"]


@pytest.mark.parametrize("seed", range(3))
def test_distributed_layers_are_those_of_the_sequence(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        full = rng.randint(1, 60)
        skeleton = rng.randint(1, full + 5)  # a skeleton may cost more than the file
        rows.append((f"f{k:03}", full, skeleton, rng.randint(0, skeleton), float(rng.randint(0, 20)), rng.random() < 0.05))
    frame = spark.createDataFrame(rows, CANDIDATES).repartition(5).cache()
    whole = sum(r[1] for r in rows)
    for strategy, budget in (("auto", whole // 2), ("auto", whole // 9), ("auto", whole), ("auto", 5), ("skeleton", whole // 4), ("outline", whole // 8), ("full", whole // 3)):
        want, total, _ = layers.select_layers(rows, budget, strategy)
        got = layers.backfilled(frame, budget, strategy).collect()
        assert {r.path: layers.LAYERS[r.layer] for r in got} == want, (strategy, budget)
        assert sum(r.cost for r in got) == total


def test_layers_of_a_million_files(spark):
    n = 1_000_000
    cost = F.col("id") % 97 + 3
    frame = spark.range(n).select(F.col("id").cast("string").alias("path"), cost.alias("cost_full"), F.floor(cost / 3).alias("cost_skeleton"), F.floor(cost / 10).alias("cost_outline"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("importance"))
    total = frame.agg(F.sum("cost_full")).first()[0]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        runs = [layers.downgraded(frame, total // 6).agg(F.sum("cost"), F.sum(F.hash("path", "layer").cast("bigint"))).first() for _ in range(2)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1] and total // 6 - 100 < runs[0][0] <= total // 6


def test_token_counts(spark):
    texts = ["", None, "hello world", "def f(x): return 1", "äöü <|endoftext|>", "a\n\n  b"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.n for r in frame.select(token_count(F.col("text"), VOCABULARY).alias("n")).collect()]
    assert got == [len(encoding(VOCABULARY).encode_ordinary(t)) if t else 0 for t in texts] and got[2] == 2
    told, cache = counted(frame.unionAll(frame), "text", "n", VOCABULARY)
    assert told.count() == 12 and cache.count() == 5
    kept = cache.withColumn("tokens", F.lit(99).cast("bigint")).where("key not like '%:0:%'")
    again, more = counted(frame, "text", "n", VOCABULARY, spark.createDataFrame(kept.collect(), kept.schema))
    assert sorted(r.n for r in again.collect()) == [0, 0, 99, 99, 99, 99] and more.count() == 5


def test_placeholders_of_a_long_file_take_time_in_proportion(spark):
    import time

    n = 60_000
    content = "".join(f"def é{k:05}(x):\n    return é{k:05}(x)\n\n" for k in range(n))
    size = len(content) // n
    entries = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("f.py").alias("path"), F.col("id").cast("string").alias("name"), (F.col("id") * size).cast("int").alias("start_byte"), (F.col("id") * size + size - 2).cast("int").alias("end_byte"))
    files = spark.createDataFrame([("f.py", content)], "path string, content string")
    began = time.monotonic()
    found = packs.expanded(entries, files)
    want = F.format_string("def é%05d(x):\n    return é%05d(x)", F.col("id").cast("int"), F.col("id").cast("int"))
    assert found.agg(F.count_if(F.col("text") == want), F.count("*")).first()[:] == (n, n)
    assert time.monotonic() - began < 20
    other = spark.createDataFrame([("a", "g.py", "n", None, 3), ("b", "g.py", "m", 2, 1), ("c", "h.py", "o", 0, 1)], "id string, path string, name string, start_byte int, end_byte int")
    files = spark.createDataFrame([("g.py", "abc"), ("h.py", None)], "path string, content string")
    assert {r.id: r.text for r in packs.expanded(other, files).collect()} == {"a": None, "b": "", "c": None}
