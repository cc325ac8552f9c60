"""The engine, its command line and the watch loop over a small tree."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from galena import cli
from galena.engine import Engine
from galena.streaming.watch import Poll, is_watched, watch

FILES = {
    "src/greet.ts": "export function format(name: string) {\n  return name;\n}\n\nexport class Greeter {\n  greet(name: string) {\n    return format(name);\n  }\n}\n",
    "src/lib/animal.py": "def foo(x):\n    return x\n\nclass Animal:\n    def speak(self):\n        return foo(2)\n",
    "README.md": "﻿Some words\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in FILES.items():
        at = tmp_path / "tree" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return tmp_path / "tree"


def test_engine(spark, tree):
    e = Engine(spark, str(tree))
    with pytest.raises(FileNotFoundError):
        e.search("greet")
    assert e.pack(budget=10_000).file_count == 3 and not e.store.exists()
    assert e.sync().symbols == 6 and e.sync_state() is None
    first = e.index()
    assert (first.files_processed, first.files_skipped, first.symbols, first.edges) == (3, 3, 6, 2)
    assert e.rank().converged and e.top_ranked_nodes(1).first().pagerank > 0
    assert e.node_rank("0" * 16) == 0 and e.node_rank(e.resolve_node_id("format")) > 0
    (tree / "src/lib/animal.py").write_text(FILES["src/lib/animal.py"] + "\ndef more():\n    return foo(3)\n")
    (tree / "README.md").unlink()
    again = e.index()
    assert (again.files_processed, again.files_skipped, again.symbols, again.ranked_nodes_before) == (2, 1, 7, 6)
    assert e.sync_state()["changed_files"] == ["src/lib/animal.py"]
    assert [r.qualified_name for r in e.callers(e.resolve_node_id("foo")).collect()] == ["foo", "Animal::speak", "more"]
    assert {r.name for r in e.callees(e.resolve_node_id("greet")).collect()} == {"greet", "format"}
    assert "greet" in {r.name for r in e.impact(e.resolve_node_id("format")).collect()}
    for bad in (lambda: e.callers("0" * 16), lambda: e.impact("0" * 16), lambda: e.resolve_node_id("absent")):
        with pytest.raises(ValueError):
            bad()
    assert e.search("greet", 5).first().file_path == "src/greet.ts"
    found = e.pack_query("greet", depth=1)
    assert found.seed_files == ["src/greet.ts"] and found.expanded_files == []
    assert set(r.path for r in found.packed.files.collect()) == {"src/greet.ts"}
    assert e.pack(restrict_to=[]).file_count == 0
    made = e.pack(strategy="skeleton")
    one = {r.name: r.id for r in made.packed.expand.collect()}
    later = Engine(spark, str(tree))
    assert later.expand(one["foo"]) == "def foo(x):\n    return x"
    with pytest.raises(KeyError):
        later.expand("none")
    assert e.list_expandable()[1]["strategy"] == "skeleton"
    stats = e.stats()
    assert stats["index"]["files"] == 2 and stats["db_size"] > 0 and stats["sync_queue"] == [{"path": "src/lib/animal.py", "status": "parsed"}]
    assert e.graph_data(2)[2].first().truncated and e.node_detail(one["foo"]).first()["of"] == 7
    assert e.token_report()[1] > 0
    with pytest.raises(RuntimeError):
        e.pack_scoped()
    e.close()
    with pytest.raises(RuntimeError):
        e.index()


def test_incremental_index_is_that_of_a_whole_one(spark, tree):
    e = Engine(spark, str(tree))
    e.index()
    (tree / "src/greet.ts").write_text(FILES["src/greet.ts"].replace("format", "shape"))
    (tree / "README.md").unlink()
    e.write_incremental(["src/greet.ts"])

    def told():
        return {n: {tuple(r) for r in e._table(n).select(*c).collect()} for n, c in (("nodes", ("id", "start_line")), ("edges", ("source", "target", "line")), ("chunks", ("id", "body", "token_count")), ("files", ("path", "git_blob_hash", "node_count")))}

    part = told()
    e.index()
    assert part == told()


def test_packs_of_changes(spark, tree):
    git = ["git", "-C", str(tree), "-c", "user.email=a@b", "-c", "user.name=n"]
    subprocess.run([*git, "init", "-q"], check=True)
    subprocess.run([*git, "add", "src", "README.md"], check=True)
    subprocess.run([*git, "commit", "-qm", "first"], check=True)
    e = Engine(spark, str(tree), state=f"file://{tree.parent}/state")
    (tree / "src/caller.ts").write_text("export function other() {\n  return shared();\n}\n")
    (tree / "src/shared.ts").write_text("export function shared() {\n  return 1;\n}\n")
    subprocess.run([*git, "add", "src"], check=True)
    subprocess.run([*git, "commit", "-qm", "second"], check=True)
    e.index()
    (tree / "src/shared.ts").write_text("export function shared() {\n  return 2;\n}\n")
    made = e.pack_scoped(depth=1)
    assert (made.scope, made.seed_files, made.expanded_files) == ("changed", ["src/shared.ts"], ["src/caller.ts"])
    assert e.pack_scoped(since="HEAD~1", depth=0).seed_files == ["src/caller.ts", "src/shared.ts"]
    with pytest.raises(RuntimeError):
        e.pack_scoped(since="no-such-ref")


def test_damaged_sidecars_are_none(spark, tree):
    e = Engine(spark, str(tree))
    e.pack()
    pointer = tree / ".galena/side/parse_cache/_CURRENT"
    pointer.write_text("99 s-x")
    assert e.store.side("parse_cache") is None
    pointer.write_text("1 s-missing")
    assert e.store.side("parse_cache") is None and e.pack().file_count == 3


def test_command_line(spark, tree, capsys):
    def run(*words):
        code = cli.main(["--root", str(tree), *words], spark)
        return code, capsys.readouterr().out

    assert run("search", "greet")[0] == 1
    assert run("index")[1].startswith("3 files")
    assert "iterations" in run("rank", "--damping", "nonsense")[1]
    assert json.loads(run("search", "greet", "--json", "-k", "1")[1])[0]["file_path"] == "src/greet.ts"
    assert run("pack", "-s", "skeleton", "-f", "markdown")[1].startswith("# Repository")
    assert "outline" in run("pack", "-s", "outline", "--list")[1]
    listed = run("pack", "-s", "skeleton", "--symbols")[1].split("\n")[0]
    assert run("expand", listed[:8])[1]
    assert "greet" in run("callers", "format")[1] and "format" in run("callees", "greet")[1] and "greet" in run("impact", "format", "-d", "1")[1]
    assert "3 files" in run("status", "--token-map")[1] and json.loads(run("status", "--json")[1])["index"]["files"] == 3
    out = tree.parent / "pack.xml"
    run("pack", "-o", str(out), "-b", "20")
    assert out.read_text().startswith("<galena ")
    assert cli.format_bytes(2048) == "2.0 KB" and cli.format_timestamp(0) == "never"


def test_watching(spark, tree):
    paths = [("a.ts", True), (".git/x", False), ("node_modules/y/z.js", False), (".galena/s", False), (".galena", False), ("src\\b.ts", True), ("a/.galena", True)]
    frame = spark.createDataFrame(paths, "path string, want boolean")
    assert all(r.want == r.got for r in frame.select("want", is_watched(F.col("path")).alias("got")).collect())
    e = Engine(spark, str(tree), state=f"file://{tree.parent}/state")
    log = tree.parent / "log"
    poll, seen, failed = Poll(str(tree), str(log)), [], []
    assert poll() == []
    (tree / "src/new.ts").write_text("export function fresh() {\n  return 1;\n}\n")
    os.utime(tree / "README.md", (1, 1))
    assert poll() == ["README.md", "src/new.ts"]

    def once():
        watch(e, f"file://{log}", f"file://{tree.parent}/checkpoint", on_reindex=seen.append, on_error=failed.append, once=True).awaitTermination()

    once()
    assert [s["changed_paths"] for s in seen] == [["README.md", "src/new.ts"]] and not failed
    assert e._table("files").count() == 4 and e.top_ranked_nodes(1).first().pagerank > 0
    once()
    assert len(seen) == 1
    (tree / "src/new.ts").unlink()
    poll()
    e.close()
    once()
    assert len(seen) == 1 and isinstance(failed[0], RuntimeError)
