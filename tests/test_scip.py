"""Decoding and importing SCIP indexes."""

import pytest
from pyspark.sql import functions as F

from galena.session import cut_by
from galena.sources import scip

NODES = "id string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_byte int, end_byte int"
EDGES = "edge_id bigint, source string, target string, kind string, line int, col int, provenance string"


def number(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def message(*parts):
    out = b""
    for field, value in parts:
        if isinstance(value, int):
            out += number(field << 3) + number(value)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += number(field << 3 | 2) + number(len(data)) + data
    return out


def occurrence(symbol, roles=0, plain=None, single=None, several=None):
    parts = [(2, symbol), (3, roles)]
    if plain:
        parts.append((1, b"".join(map(number, plain))))
    if single:
        parts.append((8, message(*enumerate(single, 1))))
    if several:
        parts.append((9, message(*enumerate(several, 1))))
    return message(*parts)


def document(path, occurrences=(), symbols=()):
    return message((4, "x"), (1, path), *((2, o) for o in occurrences), *((3, s) for s in symbols))


def index(*documents):
    return message((1, message((3, "file:///"))), *((2, d) for d in documents))


def test_decoding():
    data = index(document("a\\b.ts", [occurrence("s", 1, [3, 0, 5]), occurrence("t", 8, [3, 1, 7, 2]), occurrence("u", 0, single=[4, 1, 2]), occurrence("v", 1, [9, 9, 9], several=[5, 0, 8, 1]), occurrence("w")], [message((1, "s"), (4, message((1, "t"), (2, 1))), (4, message((1, "u"), (3, 1))))]))
    (doc,) = scip.decode(data)
    assert doc["file_path"] == "a/b.ts"
    assert [(o["symbol"], o["roles"], o["first"], o["last"]) for o in doc["occurrences"]] == [("s", 1, 3, 3), ("t", 8, 3, 7), ("u", 0, 4, 4), ("v", 1, 5, 8), ("w", 0, None, None)]
    assert [(r["target"], r["is_reference"], r["is_implementation"]) for r in doc["relations"]] == [("t", True, False), ("u", False, True)]
    with pytest.raises(ValueError):
        list(scip.decode(data[:-2]))


def test_symbol_names(spark):
    names = {
        "scip-typescript npm p 1.0 src/`a.ts`/Greeter#greet().": "greet",
        "scip-typescript npm p 1.0 src/`a.ts`/format().": "format",
        "scip-java maven p 1.0 com/x/MyClass#myMethod(overload1)().": "myMethod",
        "scip-java maven p 1.0 com/x/MyClass#m(+1).": "m",
        "s n p 1 a/Type#": "Type",
        "s n p 1 a/list[]": "list",
        "s n p 1 a/value.": "value",
        's n p 1 a/"quoted name".': "quoted name",
        "s n p 1 `only`/": "",
        "local 12": "",
        "": "",
    }
    frame = spark.createDataFrame([(k, v) for k, v in names.items()], "symbol string, want string")
    for r in frame.select("symbol", "want", scip.symbol_name(F.col("symbol")).alias("got")).collect():
        assert r.got == r.want, r.symbol


def imported(spark, tmp_path, data, nodes, edges=()):
    (tmp_path / "index.scip").write_bytes(data)
    n = spark.createDataFrame([(i, name, name, f, "ts", a, b, a, b) for i, name, f, a, b in nodes], NODES)
    e = spark.createDataFrame([(k, s, t, "calls", 1, None, p) for k, (s, t, p) in enumerate(edges)], EDGES)
    found = scip.import_index(scip.read_index(spark, f"file://{tmp_path}/index.scip"), n, e)
    return {(r.source, r.target, r.line) for r in found.edges.collect()}, {(r.source, r.target, r.provenance) for r in found.kept.collect()}, found.stats.first().asDict()


def test_import(spark, tmp_path):
    def sym(name):
        return f"s n p 1 `f`/{name}()."

    nodes = [("o", "outer", "f.ts", 1, 20), ("i", "inner", "f.ts", 5, 9), ("h", "helper", "g.ts", 1, 3), ("k", "kept", "k.ts", 1, 3)]
    first = document(
        "f.ts",
        [
            occurrence(sym("outer"), 1, several=[0, 0, 19, 0]),
            occurrence(sym("inner"), 1, several=[4, 0, 8, 0]),
            occurrence("local 1", 1, single=[5, 0, 1]),
            occurrence(sym("helper"), 8, [5, 2, 8]),  # inside inner, whatever the local says
            occurrence(sym("helper"), 8, [5, 9, 12]),  # the same edge
            occurrence(sym("helper"), 8, [15, 2, 8]),  # inside outer
            occurrence(sym("nothing"), 8, [15, 2, 8]),
            occurrence(sym("helper"), 8, [30, 2, 8]),  # outside all
        ],
        [message((1, sym("inner")), (4, message((1, sym("helper")), (3, 1))), (4, message((1, sym("outer")), (4, 1)))), message((1, sym("moved")), (4, message((1, sym("helper")), (2, 1))))],
    )
    second = document("k.ts", [occurrence(sym("nothing"), 8, [1, 1, 1])])
    made, kept, stats = imported(spark, tmp_path, index(first, second), nodes, [("i", "o", "heuristic"), ("k", "h", "heuristic"), ("o", "k", "scip")])
    assert made == {("i", "h", 6), ("o", "h", 16), ("i", "h", 5)}
    assert kept == {("k", "h", "heuristic"), ("o", "k", "scip")}
    assert stats == {"documents": 2, "occurrences": 9, "relationships": 3, "edges_inserted": 3, "edges_replaced": 1}
    with pytest.raises(ValueError):
        imported(spark, tmp_path, index(first), [])


def test_many_references_from_one_line(spark):
    import time

    # each of 30 000 definitions of a document spans six of its 55 lines, and 60 000 references stand on them
    n = spark.range(1, 30_001).select("id", F.lit("n").alias("name"), F.lit("f").alias("file_path"), (F.col("id") % 50 + 1).alias("start_line"))
    e = spark.range(1, 30_001).select(F.col("id").alias("source"), (F.col("id") % 7 + 1).alias("target"), F.lit("calls").alias("kind"), F.lit("heuristic").alias("provenance"))
    row = [F.lit(0).alias("doc"), F.lit("f").alias("file_path")]
    defines = n.select(*row, F.col("id").alias("place"), F.lit("s m p v `f`/n().").alias("symbol"), F.lit(1).alias("roles"), (F.col("start_line") - 1).cast("int").alias("first"), (F.col("start_line") + 4).cast("int").alias("last"))
    refers = spark.range(60_000).select(*row, (F.col("id") + 100_000).alias("place"), F.lit("s m p v `f`/n().").alias("symbol"), F.lit(8).alias("roles"), (F.col("id") % 55).cast("int").alias("first"), (F.col("id") % 55).cast("int").alias("last"))
    related = spark.createDataFrame([], "doc int, file_path string, symbol string, target string, is_reference boolean, is_implementation boolean")
    each = defines.unionByName(refers)
    counted = each.agg(F.lit(1).alias("documents"), F.count("*").alias("occurrences"), F.lit(0).alias("relationships"))
    began = time.monotonic()
    found = scip.import_rows(each, related, counted, n, e)
    # around a line the first definition is the least place of those that start at most five lines above; the target is the node of the first line
    want = set()
    for line in range(55):
        k = min((s - 1 if s > 1 else 50) for s in range(max(1, line - 4), min(50, line + 1) + 1))
        want.add((k, 50, line + 1))
    assert {(r.source, r.target, r.line) for r in found.edges.collect()} == want
    assert found.stats.first()[:] == (1, 90_000, 0, 55, 30_000)
    assert time.monotonic() - began < 60


def test_links_kept_by_source_are_not_shuffled_again(spark, capsys):
    links = cut_by(spark.range(10_000).select((F.col("id") % 100).alias("source"), "id"), "source")
    ends = spark.range(100).select(F.col("id").alias("source"))
    links.join(ends.hint("merge"), "source").groupBy("source").count().explain()
    # only the other side is
    assert capsys.readouterr().out.count("Exchange") == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert [r["count"] for r in links.groupBy("source").count().collect()] == [100] * 100
