"""The command line: ``python -m galena.cli <verb> [--root DIR]``."""

from __future__ import annotations

import argparse
import json
import math
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import STATE, Engine
from .operators import observe
from .schema import TOKEN_BUDGET


def format_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} GB"


def format_timestamp(seconds: float) -> str:
    return time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(seconds)) if seconds else "never"


def format_node(r) -> str:
    return f"{r.kind} {r.qualified_name or r.name}  {r.file_path}:{r.start_line}  {r.id}"


def number(text: str | None, default: float, name: str) -> float:
    """A finite number, else the default with a warning."""
    try:
        value = float(text) if text is not None else default
    except ValueError:
        value = math.nan
    if math.isfinite(value):
        return value
    print(f"{name} isn't a number, {default} is taken", file=sys.stderr)
    return default


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def cmd_index(e: Engine, a: argparse.Namespace) -> None:
    s = e.index()
    print(f"{s.files_processed} files ({s.files_skipped} unchanged), {s.symbols} symbols, {s.edges} edges, {s.chunks} chunks in {s.duration_ms} ms")
    if s.scip_edges_before and not a.scip:
        print(f"{s.scip_edges_before} imported edges are gone; import them again with --scip")
    if s.ranked_nodes_before:
        print("ranks are 0 again; run rank")
    if a.scip:
        print(json.dumps(e.import_scip(a.scip)))


def cmd_rank(e: Engine, a: argparse.Namespace) -> None:
    found = e.rank(damping=number(a.damping, 0.85, "--damping"), max_iterations=int(number(a.max_iter, 100, "--max-iter")))
    print(f"{found.iterations} iterations, {'converged' if found.converged else 'not converged'}, {found.node_count} nodes, {found.edge_count} edges")
    for r in e.top_ranked_nodes(20).collect():
        print(f"{r.pagerank:.6f}  {format_node(r)}")


def cmd_pack(e: Engine, a: argparse.Namespace) -> None:
    options = {"budget": a.budget, "form": a.format, "strategy": a.strategy, "always_full": a.always_full}
    if a.query:
        made = e.pack_query(a.query, top_k=a.top_k, depth=a.depth, **options)
    elif a.changed or a.since:
        made = e.pack_scoped(since=a.since, depth=a.depth, **options)
    else:
        made = e.pack(**options)
    if a.list:
        for r in made.packed.files.orderBy("path").collect():
            print(f"{r.layer:9} {r.tokens:8} {r.path}")
    elif a.symbols:
        for r in made.packed.expand.orderBy("path", "start_line").collect():
            print(f"{r.id}  {r.name}  {r.path}:{r.start_line}")
    elif a.output:
        Path(a.output).write_text(made.content)
    else:
        print(made.content)
    counts = " ".join(f"{k[0].upper() if k != 'omit' else '-'}:{n}" for k, n in made.layer_counts.items())
    print(f"{made.packed.total} of {a.budget} tokens, {made.file_count} files ({counts})", file=sys.stderr)


def cmd_search(e: Engine, a: argparse.Namespace) -> None:
    found = rows_of(e.search(a.query, a.top_k).select("id", "file_path", "start_line", "end_line", "body", "score", "hop", "rrf", "bm25_rank", "graph_rank", "related_nodes"))
    if a.json:
        print(json.dumps(found))
        return
    for r in found:
        print(f"{r['rrf']:.4f}  bm25 {r['score']:.2f}  {r['file_path']}:{r['start_line']}-{r['end_line']}")


def cmd_expand(e: Engine, a: argparse.Namespace) -> None:
    listed = e.list_expandable()
    if listed is None:
        raise SystemExit("nothing to expand: pack first")
    if a.list or not a.id:
        for r in listed[0].orderBy("path", "start_line").collect():
            print(f"{r.id}  {r.name}  {r.path}:{r.start_line}-{r.end_line}")
        return
    matches = [r.id for r in listed[0].where(F.startswith("id", F.lit(a.id))).limit(2).collect()]
    if len(matches) != 1:
        raise SystemExit(f"{'no' if not matches else 'more than one'} placeholder begins with {a.id}")
    print(json.dumps(e.expand_entry(matches[0])) if a.meta else e.expand(matches[0]))


def _walk(verb: str):
    def run(e: Engine, a: argparse.Namespace) -> None:
        found = getattr(e, verb)(e.resolve_node_id(a.node), a.depth)
        for r in found.collect():
            print(f"{'  ' * r.depth}{format_node(r)}")

    return run


def status(e: Engine) -> dict:
    """What ``status`` tells, as plain values."""
    found = e.stats()
    found["index"] = {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in found["index"].items()}
    found["token_map"] = rows_of(found["token_map"].orderBy("path"))
    return found


def cmd_status(e: Engine, a: argparse.Namespace) -> None:
    found = status(e)
    if a.json:
        print(json.dumps(found))
        return
    one = found["index"]
    print(f"{one['files']} files, {one['symbols']} symbols, {one['edges']} edges, {one['chunks']} chunks, {format_bytes(found['db_size'])}, last {one['last_indexed'] or 'never'}")
    print(" ".join(f"{s} {one[s]}" for s in ("ok", "degraded", "failed", "skipped")))
    print(" ".join(f"{k} {n}" for k, n in sorted(found["languages"].items(), key=lambda x: (-x[1], x[0]))))
    if a.token_map:
        for r in observe.top_leaves(observe.tokens_by_file(e._table("chunks"))).collect():
            print(f"{r.tokens:8} {r.file_path}")


def cmd_watch(e: Engine, a: argparse.Namespace) -> None:
    from .streaming.watch import Poll, watch

    with tempfile.TemporaryDirectory() as at:
        poll = Poll(a.root, f"{at}/log")
        told = watch(e, f"file://{at}/log", f"file://{at}/checkpoint", a.debounce, not a.no_rank, lambda i: print(f"{len(i['changed_paths'])} changes in {i['duration_ms']} ms"), lambda x: print(x, file=sys.stderr))
        try:
            while told.isActive:
                poll()
                time.sleep(a.debounce / 1000)
        except KeyboardInterrupt:
            told.stop()


def cmd_serve(e: Engine, a: argparse.Namespace) -> None:
    """Status and search as JSON over HTTP, one request after another."""
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            at = urlparse(self.path)
            asked = {k: v[0] for k, v in parse_qs(at.query).items()}
            try:
                if at.path == "/api/status":
                    code, body = 200, status(e)
                elif at.path == "/api/search":
                    code, body = 200, rows_of(e.search(asked.get("q", ""), int(asked.get("k", "20"))))
                elif at.path in ("/api/callers", "/api/callees", "/api/impact"):
                    code, body = 200, rows_of(getattr(e, at.path.rpartition("/")[2])(e.resolve_node_id(asked.get("node", "")), int(asked.get("depth", "1"))))
                else:
                    code, body = 404, {"error": "no such page"}
            except (ValueError, KeyError, FileNotFoundError) as x:
                code, body = 400, {"error": str(x)}
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    HTTPServer((a.host, a.port), Handler).serve_forever()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="galena", description=__doc__)
    p.add_argument("--root", default=".")
    p.add_argument("--state", help=f"where the index is; {STATE} below the root")
    p.add_argument("--vocabulary", help="a file of BPE ranks to count tokens by; words without it")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, run) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        v.set_defaults(run=run)
        return v

    verb("index", cmd_index).add_argument("--scip")
    v = verb("rank", cmd_rank)
    v.add_argument("--damping")
    v.add_argument("--max-iter")
    v = verb("pack", cmd_pack)
    v.add_argument("-o", "--output")
    v.add_argument("-f", "--format", choices=("xml", "markdown", "json"), default="xml")
    v.add_argument("-b", "--budget", type=int, default=TOKEN_BUDGET)
    v.add_argument("-s", "--strategy", choices=("auto", "full", "skeleton", "outline"), default="auto")
    v.add_argument("--always-full", action="append")
    v.add_argument("--changed", action="store_true")
    v.add_argument("--since")
    v.add_argument("--query")
    v.add_argument("-k", "--top-k", type=int, default=10)
    v.add_argument("-d", "--depth", type=int, default=2)
    v.add_argument("--list", action="store_true")
    v.add_argument("--symbols", action="store_true")
    v = verb("search", cmd_search)
    v.add_argument("query")
    v.add_argument("-k", "--top-k", type=int, default=20)
    v.add_argument("--json", action="store_true")
    v = verb("expand", cmd_expand)
    v.add_argument("id", nargs="?")
    v.add_argument("--list", action="store_true")
    v.add_argument("--meta", action="store_true")
    for name, depth in (("callers", 1), ("callees", 1), ("impact", 3)):
        v = verb(name, _walk(name))
        v.add_argument("node")
        v.add_argument("-d", "--depth", type=int, default=depth)
    v = verb("status", cmd_status)
    v.add_argument("--token-map", action="store_true")
    v.add_argument("--json", action="store_true")
    v = verb("watch", cmd_watch)
    v.add_argument("--debounce", type=int, default=300)
    v.add_argument("--no-rank", action="store_true")
    v = verb("serve", cmd_serve)
    v.add_argument("-p", "--port", type=int, default=4317)
    v.add_argument("--host", default="127.0.0.1")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("galena").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        with Engine(session, a.root, a.state, a.vocabulary) as e:
            a.run(e, a)
    except (ValueError, KeyError, RuntimeError, FileNotFoundError, NotADirectoryError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 1
    finally:
        if spark is None:
            session.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
