"""The operators on micro-fixtures whose results are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.functions import ids, text
from galena.operators import graph, layers, observe, rank, resolve, search
from galena.sources import files, store

NODES = "id string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_byte int, end_byte int, pagerank double"
EDGES = "edge_id bigint, source string, target string, kind string, line int, provenance string"


def nodes(spark, rows):
    """From (id, name, qualified name, file[, first line, last line])."""
    full = [(*r[:4], "python", *(r[4:6] if len(r) > 4 else (k * 10 + 1, k * 10 + 5)), k * 100, k * 100 + 50, 0.0) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, NODES)


def edges(spark, pairs):
    return spark.createDataFrame([(k + 1, a, b, "calls", k, "heuristic") for k, (a, b) in enumerate(pairs)], EDGES)


def test_scalars(spark):
    frame = spark.createDataFrame([("hello\n", "abc\nde12\n", "XMLParser fooBar", "a/b.c.PY")], "a string, b string, c string, p string")
    m = text.metrics(F.col("b"))
    r = frame.select(ids.blob_hash(F.col("a")).alias("h"), m["num_lines"].alias("n"), m["max_line"].alias("m"), text.split_camel(F.col("c")).alias("c"), text.language(F.col("p")).alias("l"), text.escape_xml(F.lit("<&>")).alias("x"), text.fence(F.lit("a ```` b")).alias("f"), text.occurrences(F.lit("aaaa"), "aa").alias("o")).first()
    assert tuple(r) == ("ce013625030ba8dba906f756967f9e9ca394464a", 3, 4, "XML Parser foo Bar", "python", "&lt;&amp;&gt;", "`````", 3)
    assert text.query_words("getUser_byID  x") == ["get", "user", "by", "id", "x"]


def test_validity(spark):
    rows = [("a.ts", "x" * 5000), ("b.ts", "1234567890\n" * 50), ("c.ts", "!?!?\n" * 40), ("d.ts", "let a = 1;" + " y" * 200), ("e.md", "| a b c |" + " word" * 200), ("f.ts", "")]
    got = {r.path: r.ok for r in spark.createDataFrame(rows, "path string, body string").select("path", text.is_valid(F.col("body"), F.col("path")).alias("ok")).collect()}
    assert got == {"a.ts": False, "b.ts": False, "c.ts": False, "d.ts": False, "e.md": True, "f.ts": True}


def test_references_find_the_innermost_symbol_and_the_nearest_name(spark):
    n = nodes(spark, [("o", "outer", "outer", "f", 2, 20), ("i", "inner", "outer::inner", "f", 5, 9), ("s", "one", "one", "f", 15, 15), ("g", "helper", "helper", "g", 1, 3), ("h", "helper", "helper", "f", 30, 31), ("z", "only", "only", "g", 5, 6)])
    points = spark.createDataFrame([(1, "f", 1), (2, "f", 6), (3, "f", 15), (4, "f", 19)], "ref_id bigint, file_path string, line int")
    assert {r.ref_id: r.from_node_id for r in resolve.innermost(points, n).collect()} == {1: None, 2: "i", 3: "s", 4: "o"}
    refs = [("o", "helper", "f", 6), ("o", "helper", "f", 6), ("o", "only", "f", 7), ("o", "nothing", "f", 8), (None, "helper", "f", 1), ("z", "helper", "g", 5)]
    frame = spark.createDataFrame([(a, b, c, "python", d, None) for a, b, c, d in refs], "from_node_id string, reference_name string, file_path string, language string, line int, col int")
    found, stats = resolve.resolve(frame, n)
    assert {(r.source, r.target, r.line) for r in found.collect()} == {("o", "h", 6), ("o", "z", 7), ("z", "g", 5)}
    assert tuple(stats.first()) == (4, 1)
    again, _ = resolve.resolve(frame, n, found)
    assert again.count() == 0
    assert sorted(r.edge_id for r in resolve.numbered(found, 10).collect()) == [10, 11, 12]


def test_symbols_that_share_lines_are_not_pairs_with_all_points(spark):
    import time

    # 40 000 symbols and points in 50 lines of one file: as pairs 1.6 billion
    n = spark.range(40_000).select(F.col("id").cast("string").alias("id"), F.lit("f").alias("file_path"), (F.col("id") % 50 + 1).cast("int").alias("start_line"), (F.col("id") % 50 + 6).cast("int").alias("end_line"), F.lit(0).alias("start_byte"), F.lit(0).alias("end_byte"), F.col("id").alias("place"))
    points = spark.range(40_000).select(F.col("id").alias("ref_id"), F.lit("f").alias("file_path"), (F.col("id") % 56 + 1).cast("int").alias("line"))
    began = time.monotonic()
    # start doesn't decide between equal sizes, but offsets and place do: the least place around the line
    wrong = resolve.innermost(points, n, order="place").join(points, "ref_id").where(F.col("from_node_id").cast("int") != F.greatest(F.col("line") - 6, F.lit(0)))
    assert wrong.count() == 0 and time.monotonic() - began < 30
    far = nodes(spark, [("all", "a", "a", "f", 1, 1000), ("mid", "m", "m", "f", 100, 300), ("low", "l", "l", "f", 250, 310), ("one", "o", "o", "f", 128, 128)])
    points = spark.createDataFrame([(k, "f", k) for k in (1, 127, 128, 129, 200, 250, 256, 301, 999, 1001)], "ref_id bigint, file_path string, line int")
    assert {r.ref_id: r.from_node_id for r in resolve.innermost(points, far).collect()} == {1: "all", 127: "mid", 128: "one", 129: "mid", 200: "mid", 250: "low", 256: "low", 301: "low", 999: "all", 1001: None}


def test_walks(spark):
    n = nodes(spark, [(x, x, x, "f") for x in "abcd"])
    e = edges(spark, [("a", "b"), ("b", "c"), ("b", "c")])
    w = graph.walk(e, "c", 2)
    assert {(r.id, r.depth) for r in w.nodes.collect()} == {("c", 0), ("b", 1), ("a", 2)}
    assert not w.truncated and w.edges.count() == 3
    assert {r.id for r in graph.walk(e, "c", 1).nodes.collect()} == {"c", "b"}
    assert {r.id for r in graph.walk(e, "a", 3, reverse=False).nodes.collect()} == {"a", "b", "c"}
    many = edges(spark, [(f"x{k}", "t") for k in range(205)])
    capped = graph.walk(many, "t", 1)
    assert capped.truncated and capped.nodes.count() == 201
    assert graph.induced(n.withColumn("pagerank", F.ascii("id").cast("double")), e, 2)[1].count() == 0
    seeds = spark.createDataFrame([("a",), ("c",)], "id string")
    assert {(r.id, r.hop) for r in graph.hops(e, seeds, 2).collect()} == {("b", 1), ("a", 2), ("c", 2)}


def test_impact_drills_down_into_scopes(spark):
    n = nodes(spark, [("m", "m", "Outer::Inner::m", "f"), ("n", "n", "outer::inner::n", "f"), ("p", "p", "Outer::Other::p", "f"), ("x", "x", "Outer::Inner::x", "g"), ("u", "u", "u", "h"), ("v", "v", "v", "h")])
    e = edges(spark, [("u", "n"), ("v", "u")])
    for cap in (50, None):
        got = {r.id: r.depth for r in graph.impact(n, e, "m", 1, cap).nodes.collect()}
        assert got == {"m": 0, "n": 1, "u": 1}, cap
    assert {r.id: r.depth for r in graph.impact(n, e, "m", 2).nodes.collect()}["v"] == 2
    big = nodes(spark, [(f"k{i:02}", f"k{i}", f"C::k{i}", "f") for i in range(60)])
    assert graph.impact(big, e, "k00", 1).truncated


def test_capped_impact_reads_past_many_lines_of_one_caller(spark):
    n = nodes(spark, [("m", "m", "C::m", "f"), ("r", "r", "D::r", "g"), ("s", "s", "D::s", "g"), ("u", "u", "u", "h"), ("v", "v", "v", "h")])
    # r calls m; the callers of its sibling s: u and the visited m on many lines, then v
    pairs = [("r", "m")] + [("u", "s")] * 60 + [("m", "s")] * 60 + [("v", "s")]
    w = graph.impact(n, edges(spark, pairs), "m", 1)
    assert {r.id: r.depth for r in w.nodes.collect()} == {"m": 0, "r": 1, "s": 1, "u": 1, "v": 1}
    assert not w.truncated and w.edges.count() == len(pairs)
    # the layer has m (its own sibling) and r, so there is room for s and one caller: the edges before the first of the next one stay
    cut = graph.impact(n, edges(spark, [*pairs, ("u", "s")]), "m", 1, 4)
    assert cut.truncated and {r.id for r in cut.nodes.collect()} == {"m", "r", "s", "u"}
    assert cut.edges.count() == len(pairs) - 1


def test_pagerank(spark):
    four = nodes(spark, [(x, x if x != "p" else "_p", x, "f") for x in "abcp"])
    none = rank.pagerank(four, edges(spark, [("a", "zz")]))
    assert (none.iterations, none.converged, none.edge_count) == (1, True, 0)
    assert {round(r.pagerank, 9) for r in none.ranks.collect()} == {0.25}
    assert rank.pagerank(four.limit(0), edges(spark, [("a", "b")])).iterations == 0
    got = rank.pagerank(four, edges(spark, [("a", "b"), ("a", "b"), ("a", "p"), ("c", "b"), ("c", "c")]))
    r = {x.id: x.pagerank for x in got.ranks.collect()}
    assert got.converged and got.edge_count == 5
    assert r["b"] > r["c"] > r["p"]
    # the same by hand
    weight = {("a", "b"): 2 / 3, ("a", "p"): 0.1 / 3, ("c", "b"): 0.5, ("c", "c"): 0.5}
    want = dict.fromkeys("abcp", 0.25)
    for _ in range(got.iterations):
        loose = want["b"] + want["p"]
        want = {v: 0.15 / 4 + 0.85 * sum(want[s] * w for (s, t), w in weight.items() if t == v) + 0.85 * loose / 4 for v in want}
    assert r == pytest.approx(want, abs=1e-12)


def test_search(spark):
    chunks = spark.createDataFrame([("c1", "f", "python", 1, 5, "def handleRequestNow(): pass"), ("c2", "g", "python", 1, 5, "nothing of the kind here"), ("c3", "h", "python", 1, 5, "other words in this one")], "id string, file_path string, language string, start_line int, end_line int, body string")
    n = nodes(spark, [("n1", "a", "a", "f", 1, 4), ("n2", "b", "b", "g", 1, 4)])
    e = edges(spark, [("n2", "n1")])
    for query in ("handleRequestNow", "handlerequestnow", "handleReq"):
        assert [r.id for r in search.bm25(chunks, query, 10).collect()] == ["c1"]
    for query in ("", " ", "x", "absent words"):
        assert search.bm25(chunks, query, 10).count() == 0
    index = search.postings(chunks).cache()
    for query in ("handleRequestNow", "words", "other in words", "absent words", "thiOne", "the kind"):
        assert search.bm25(chunks, query, index=index).collect() == search.bm25(chunks, query).collect()
    got = search.search(chunks, n, e, "handleRequest", 5).collect()
    assert [(r.id, r.bm25_rank, r.graph_rank) for r in got] == [("c1", 1, None), ("c2", None, 1)]
    assert got[1].rrf == pytest.approx(1 / 61)
    assert [r.id for r in search.search(chunks, n, e, "handleRequest", 5, text_weight=0.0).collect()][0] == "c2"
    assert [r.id for r in search.search(chunks, n, e, "handleRequest", 5, depth=0).collect()] == ["c1"]


@pytest.mark.parametrize(
    "candidates, budget, strategy, want, total, fits",
    [
        ([("a", 100, 60, 20, 1000, False), ("b", 100, 60, 20, 500, False)], 1000, "auto", {"a": "full", "b": "full"}, 200, True),
        ([("a", 100, 60, 20, 1000, False), ("b", 100, 60, 20, 500, False)], 150, "auto", {"a": "full", "b": "outline"}, 120, True),
        ([("a", 200, 65, 15, 1000, False), ("b", 200, 65, 15, 500, False)], 80, "auto", {"a": "skeleton", "b": "outline"}, 80, True),
        ([("a", 200, 60, 15, 0, False)], 70, "skeleton", {"a": "skeleton"}, 60, True),
        ([("a", 200, 60, 15, 0, False)], 10, "skeleton", {"a": "omit"}, 0, True),
        ([("a", 200, 60, 15, 0, True), ("b", 100, 40, 10, 0, False)], 50, "auto", {"a": "full", "b": "omit"}, 200, False),
        ([("low", 50, 30, 10, 100, False), ("hi", 50, 30, 10, 1000, False)], 30, "auto", {"hi": "skeleton", "low": "omit"}, 30, True),
    ],
)
def test_layers(candidates, budget, strategy, want, total, fits):
    assert layers.select_layers(candidates, budget, strategy) == (want, total, fits)


def test_treemap(spark):
    frame = spark.createDataFrame([("src/core/a", 100), ("src/core/b", 50), ("src/cli/c", 25), ("README", 10)], "file_path string, token_count bigint")
    got = {r.path: r.tokens for r in observe.treemap(observe.tokens_by_file(frame)).collect()}
    assert got[""] == 185 and got["src"] == 175 and got["src/core"] == 150


def test_a_tree_is_read_with_reasons(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b/c.md": b"# words\n", ".gitignore": b"skip.py\n", "skip.py": b"y = 2\n", "node_modules/z.js": b"z", "p.png": b"\x89PNG", "n.txt": b"a\x00b", "bom.txt": b"\xef\xbb\xbfhello\n", "big.txt": b"w" * 200}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    kept, skipped = files.ingest(spark, str(tmp_path), max_bytes=100)
    assert {r.path: r.content for r in kept.collect() if r.path != ".gitignore"} == {"a.py": "x = 1\n", "b/c.md": "# words\n", "bom.txt": "hello\n"}
    assert {r.path: r.reason for r in skipped.collect()} == {"p.png": "binary-extension", "n.txt": "binary-content", "big.txt": "size-limit"}
    with pytest.raises(NotADirectoryError):
        files.walk(str(tmp_path / "absent"))


def test_snapshots(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/index")
    with pytest.raises(FileNotFoundError):
        s.read("nodes")
    rows = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, git_blob_hash string")
    s.write({"hashes": rows}, {"n": 2})
    s.write({"hashes": store.merged(rows, rows.where("path = 'b'").withColumn("git_blob_hash", F.lit("h3")), rows.where("path = 'b'"), "path")}, {"n": 3})
    now = s.read("hashes")
    assert s.meta()["n"] == 3
    assert {r.path: r.state for r in store.compared(rows, now).collect()} == {"a": "unchanged", "b": "changed"}


def by_hand(nodes, links, start, depth, cap, reverse=True, drill=False):
    """Layers of a walk node by node in the order of insertion; links are (edge_id, source, target, line)."""
    near, far = (2, 1) if reverse else (1, 2)
    place = {n[0]: k for k, n in enumerate(nodes)}
    scope = {n[0]: n[2].rpartition("::")[0].lower() for n in nodes}
    file = {n[0]: n[3] for n in nodes}

    def siblings(i):
        return sorted((n[0] for n in nodes if scope[i] and n[3] == file[i] and n[2].lower().startswith(scope[i] + "::")), key=lambda x: place[x])

    visited, layers, edges, over, frontier = {start}, {start: 0}, [], False, [start]
    for d in range(1, depth + 1):
        own = siblings(start) if drill and d == 1 else []
        seeds = {*frontier, *own}
        step = [x for x in links if x[near] in seeds]
        layer = dict.fromkeys([x[far] for x in step] + own)
        if drill:
            edges += step
            for i in list(layer):
                if len(layer) >= cap:
                    over = True
                    break
                for s in siblings(i):
                    if s in visited or s in layer:
                        continue
                    if len(layer) >= cap:
                        over = True
                        break
                    layer[s] = None
                    for x in [x for x in links if x[2] == s]:
                        if x[1] not in visited and x[1] not in layer:
                            if len(layer) >= cap:
                                over = True
                                break
                            layer[x[1]] = None
                        edges.append(x)
            new = [i for i in layer if i not in visited]
        else:
            new = [i for i in layer if i not in visited]
            over = over or len(new) > cap
            new = new[:cap]
            edges += [x for x in step if x[far] in visited or x[far] in new]
        if not new:
            break
        visited |= set(new)
        layers |= dict.fromkeys(new, d)
        frontier = new
    return layers, {(x[1], x[2], x[3]) for x in edges}, over


@pytest.mark.parametrize("seed", range(2))
def test_capped_walks_are_those_by_hand(spark, seed):
    import random

    rng = random.Random(seed)
    names = [f"n{k:02}" for k in range(40)]
    rows = [(x, x, rng.choice([f"C{k % 4}::{x}", f"c{k % 4}::d::{x}", x]), f"f{k % 2}") for k, x in enumerate(names)]
    links = [(k + 1, rng.choice(names), rng.choice(names), rng.randint(1, 2)) for k in range(70)]
    n = nodes(spark, rows)
    e = spark.createDataFrame([(k, s, t, "calls", line, "heuristic") for k, s, t, line in links], EDGES)
    for cap in (4, 200):
        for walked, want in (
            (graph.walk(e, "n00", 3, cap=cap, nodes=n), by_hand(rows, links, "n00", 3, cap)),
            (graph.walk(e, "n00", 2, reverse=False, cap=cap), by_hand(rows, links, "n00", 2, cap, reverse=False)),
            (graph.impact(n, e, "n00", 2, cap), by_hand(rows, links, "n00", 2, cap, drill=True)),
        ):
            got = ({r.id: r.depth for r in walked.nodes.collect()}, {(r.source, r.target, r.line) for r in walked.edges.collect()}, walked.truncated)
            assert got == want, cap


def test_impact_drills_into_visited_nodes_of_a_layer_too(spark):
    n = nodes(spark, [("m", "m", "m", "f"), ("a", "a", "A::a", "f"), ("b", "b", "A::b", "f"), ("u", "u", "S::u", "g"), ("v", "v", "S::v", "g")])
    e = edges(spark, [("a", "m"), ("u", "b")])
    for cap in (50, None):
        assert {r.id: r.depth for r in graph.impact(n, e, "m", 2, cap).nodes.collect()} == {"m": 0, "a": 1, "b": 1, "u": 1, "v": 2}, cap
    with pytest.raises(ValueError):
        graph.impact(n, e, "absent", 1)
    with pytest.raises(ValueError):
        graph.walk(e, "absent", 1, nodes=n)
    null = spark.createDataFrame([(2, "a", "m", "calls", None, "x"), (1, "a", "m", "calls", -1, "x"), (3, "b", "m", "calls", None, "x")], EDGES)
    assert sorted((r.source, r.line, r.edge_id) for r in resolve.distinct_edges(null).collect()) == [("a", -1, 1), ("b", None, 3)]


def test_siblings_of_many_nodes_of_one_scope_come_once(spark):
    many = spark.range(20_000).select(F.col("id"), F.lit("f").alias("file_path"), F.concat(F.lit("A::"), F.col("id").cast("string")).alias("qualified_name"))
    assert graph.siblings(many, many.withColumn("k", F.col("id") + 5)).agg(F.count("*"), F.min("k"), F.max("k")).first()[:] == (20_000, 5, 5)
    odd = nodes(spark, [("a", "a", "X:::a", "f"), ("b", "b", "x:::C::b", "f"), ("c", "c", "X::c", "f"), ("d", "d", "d", "f"), ("e", "e", "X::e", "g"), ("n", "n", None, "f")])
    found = lambda i: {r.sibling for r in graph.siblings(odd, odd.where(F.col("id") == i).withColumn("k", F.lit(0))).collect()}
    assert [found(i) for i in "abcden"] == [{"a", "b"}, {"b"}, {"a", "b", "c"}, set(), {"e"}, set()]


def test_runs_of_three_characters_are_in_blocks(spark):
    texts = ["abcABC", "", "ab", None, "xéy😀z😀", "aaaa", "bca"]
    want = sorted((g, k) for k, t in enumerate(texts) if t for g in {t.lower()[i : i + 3] for i in range(len(t) - 2)})
    chunks = spark.createDataFrame([(f"{k}", t) for k, t in enumerate(texts)], "id string, body string").coalesce(1)
    for made in (search.grams(chunks), search.postings(chunks)):
        assert sorted((r.gram, int(i)) for r in made.collect() for i in r.ids) == want
    # 2 000 chunks of the same runs: a row a run of a block, not one of a chunk
    many = spark.range(2_000).coalesce(1).select("id", F.lit("some words of a chunk").alias("body"))
    assert search.grams(many).count() == 19 and search.grams(many).agg(F.sum(F.size("ids"))).first()[0] == 38_000


def test_places_over_several_ranges(spark):
    from galena.session import places

    frame = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), "id").repartition(7)
    wrong = places(frame, "place", F.col("k"), F.col("id")).withColumn("want", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("k", "id"))).where("place <> want")
    assert wrong.count() == 0


def test_line_windows_take_time_in_proportion(spark):
    text_of = lambda n: "\n".join(f"line {k}" for k in range(n))
    frame = spark.createDataFrame([(text_of(20_000),)], "t string")
    found = frame.select(F.explode(text.line_windows(F.col("t"), 64)).alias("w")).select("w.*").collect()
    assert "\n".join(r.body for r in found) == text_of(20_000) and all(len(r.body) + 1 >= 64 for r in found[:-1])


def test_a_step_of_pagerank_shuffles_its_sums_alone(spark, monkeypatch):
    plans = []

    def seen(df, *columns, cut_by=rank.cut_by):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return cut_by(df, *columns)

    monkeypatch.setattr(rank, "cut_by", seen)
    nodes = spark.range(50).select("id", F.col("id").cast("string").alias("name"), F.lit("f").alias("file_path"))
    edges = spark.range(200).select((F.col("id") % 40).alias("source"), (F.col("id") * 7 % 50).alias("target"), F.lit("calls").alias("kind"))
    rank.pagerank(nodes, edges, epsilon=0.0, max_iterations=2)
    assert plans[2:] == [1, 1]


def test_siblings_take_each_scope_apart_once(spark):
    names = ["A::B::x", "a::b::C::y", "A::z", "A:::w", "AB::v", "b::A::u", "plain"]
    nodes = spark.createDataFrame([(k, "f", f"f.{k % 2}" if k > 6 else "f", n) for k, n in enumerate(names * 2)], "id long, kind string, file_path string, qualified_name string")
    found = graph.siblings(nodes, nodes.where("id in (0, 4, 6)").withColumn("k", F.col("id")))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # the names of the scopes, not of the symbols
    assert {(r.sibling, r.k) for r in found.collect()} == {(0, 0), (1, 0), (4, 4)}
    found = graph.siblings(nodes, nodes.where("id = 2").withColumn("k", F.lit(1)))
    assert {(r.sibling, r.k) for r in found.collect()} == {(0, 1), (1, 1), (2, 1), (3, 1)}


def test_index_takes_texts_apart_once_and_runs_by_either_way(spark):
    chunks = spark.createDataFrame([("a", "abcabc"), ("b", "xabc")], "id string, body string").coalesce(1)
    plan = search.postings(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" in plan
    rng = np.random.default_rng(7)
    for letters in (1, 3, 300, 0x10F000):  # the last are too many for one number
        codes = rng.integers(0, letters, 200_000).astype(np.uint32)
        chunk = np.sort(rng.integers(0, 9000, len(codes))).astype(np.uint64)
        each, starts, of = search._runs(codes, chunk, chunk[:-2] == chunk[2:])
        bounds = [*starts.tolist(), len(of)]
        found = [(g, c) for k, g in enumerate(each.tolist()) for c in of[bounds[k] : bounds[k + 1]].tolist()]
        a, c = codes.tolist(), chunk.tolist()
        assert sorted(found) == sorted({(a[i] << 42 | a[i + 1] << 21 | a[i + 2], c[i]) for i in range(len(a) - 2) if c[i] == c[i + 2]})
