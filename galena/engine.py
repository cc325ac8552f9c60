"""The engine of one source tree: ingest, index, rank, search, walk the call graph and pack.

State is a ``Store`` below the tree, or in any folder that Spark can write. Reading never makes an index: what needs one
raises FileNotFoundError without it, packs do without ranks. A closed engine raises RuntimeError.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, text
from .functions.tokens import counted
from .operators import graph, observe, packs, rank, resolve, search
from .schema import MAX_FILE_BYTES, TOKEN_BUDGET
from .session import cut, small_side
from .sources import files, parse, scip
from .sources.store import Store, merged, pruned

STATE = ".galena"
CHANGED_LISTED = 200


@dataclass(frozen=True)
class IndexStats:
    files_processed: int
    files_skipped: int  # those whose parse was in the cache
    symbols: int
    edges: int
    chunks: int
    duration_ms: int
    scip_edges_before: int = 0
    ranked_nodes_before: int = 0


@dataclass(frozen=True)
class Pack:
    content: str
    packed: packs.Compressed
    layer_counts: dict[str, int]
    scope: str | None = None  # changed, since or query
    scope_arg: str | None = None
    seed_files: list[str] = field(default_factory=list)
    expanded_files: list[str] = field(default_factory=list)

    @property
    def file_count(self) -> int:
        return sum(n for layer, n in self.layer_counts.items() if layer != "omit")


class Engine:
    def __init__(self, spark: SparkSession, root: str, state: str | None = None, vocabulary: str | None = None, **ingest: object) -> None:
        """``vocabulary`` counts tokens (words without it); ``ingest`` are the options of ``files.ingest``."""
        self.spark, self.root, self.vocabulary = spark, root, vocabulary
        self.options = {"max_bytes": MAX_FILE_BYTES} | ingest
        self.store = Store(spark, state or f"file://{Path(root).resolve()}/{STATE}")
        self.closed, self.cache_stats = False, {"hits": 0, "misses": 0, "total": 0}
        self._expand: tuple[DataFrame, dict] | None = None

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.closed = True

    def _open(self) -> Store:
        if self.closed:
            raise RuntimeError("the engine is closed")
        return self.store

    def _table(self, name: str) -> DataFrame:
        return self._open().read(name)

    # reading and parsing

    def ingest(self) -> tuple[DataFrame, DataFrame]:
        """The files (path, size, content) and those skipped (path, reason)."""
        self._open()
        return files.ingest(self.spark, self.root, **self.options)

    def _sources(self) -> DataFrame:
        kept, _ = self.ingest()
        return cut(kept.select("path", "size", "content", text.language(F.col("path")).alias("language"), ids.blob_hash(F.col("content")).alias("git_blob_hash")))

    def parse(self) -> DataFrame:
        return parse.parse_files(self._sources())

    def _parsed(self, sources: DataFrame) -> tuple[DataFrame, list[str]]:
        """The parts of the parsed files, those of unchanged content from the cache, and the first changed paths in order."""
        cache = self._open().side("parse_cache")
        parsed, told = parse.parse_cached(sources, cache)
        parsed = cut(parsed)
        told = cut(told)
        hits = told.where("hit").count()
        total = told.count()
        self.cache_stats = {"hits": hits, "misses": total - hits, "total": total}
        if cache is None or "part" not in cache.columns or total > hits or cache.where("part = 0").count() != total:
            self.store.write_side("parse_cache", parsed)
        return parsed, [r.path for r in told.where("not hit").orderBy("path").limit(CHANGED_LISTED).collect()]

    def token_report(self) -> tuple[DataFrame, int, DataFrame]:
        """Tokens by file, their total and the treemap; works without an index."""
        chunks = parse.parse_parts(self._sources(), ["chunks"]).select(F.explode("chunks").alias("c"), F.col("path").alias("file_path")).select("file_path", "c.body")
        told, cache = counted(chunks, "body", "token_count", self.vocabulary, self._open().side("token_cache"))
        by_file = cut(observe.tokens_by_file(cut(told)))
        self.store.write_side("token_cache", cache)
        return by_file, by_file.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0], observe.treemap(by_file)

    # the index

    def index(self) -> IndexStats:
        """Parse what changed, and write files, nodes, chunks, references and heuristic edges as a new snapshot.

        Ranks begin at 0 again and imported edges go; the numbers of those before are told."""
        began, store = time.monotonic(), self._open()
        before = {"scip": 0, "ranked": 0}
        if store.exists():
            before = {"scip": store.read("edges").where("provenance = 'scip'").count(), "ranked": store.read("nodes").where("pagerank > 0").count()}
        sources = self._sources()
        parsed, changed = self._parsed(sources)
        tables, counts = self.tables(sources, parsed)
        stats = IndexStats(self.cache_stats["total"], self.cache_stats["hits"], counts["nodes"], counts["resolved"], counts["chunks"], 0, before["scip"], before["ranked"])
        took = int(1000 * (time.monotonic() - began))
        state = {"timestamp": time.time(), "duration_ms": took, "files_processed": stats.files_processed, "parse_cache_hits": stats.files_skipped, "parse_cache_misses": self.cache_stats["misses"], "changed_files": changed}
        store.write(tables, {"sync_state": state})
        return replace(stats, duration_ms=took)

    def tables(self, sources: DataFrame, parsed: DataFrame) -> tuple[dict[str, DataFrame], dict[str, int]]:
        """The tables of the index of the parts of parsed files, and how many nodes, chunks and resolved and unresolved references they have."""
        now = F.current_timestamp()
        symbols = parsed.select("language", F.col("path").alias("file_path"), F.explode("symbols").alias("s"))
        nodes = cut(symbols.select("s.id", "s.kind", "s.name", "s.qualified_name", "file_path", "language", "s.start_line", "s.end_line", "s.start_byte", "s.end_byte", "s.signature", "s.docstring", F.lit(None).cast("string").alias("visibility"), F.lit(0.0).alias("pagerank"), now.alias("updated_at")))
        bodies = parsed.select("language", F.col("path").alias("file_path"), F.explode("chunks").alias("c")).select("c.id", "file_path", "language", "c.start_line", "c.end_line", "c.body")
        # of chunks that share an id one stays
        bodies = bodies.groupBy("id").agg(F.max_by(F.struct("file_path", "language", "start_line", "end_line", "body"), "start_line").alias("c")).select("id", "c.*")
        chunks, cache = counted(bodies, "body", "token_count", self.vocabulary, self.store.side("token_cache"))
        chunks = cut(chunks)
        self.store.write_side("token_cache", cache)
        refs = parsed.select("language", F.col("path").alias("file_path"), F.explode("refs").alias("r")).select("file_path", "language", "r.reference_name", "r.line", "r.col")
        refs = cut(refs.withColumn("ref_id", F.monotonically_increasing_id()))
        refs = cut(refs.join(resolve.innermost(refs, nodes), "ref_id").withColumn("reference_kind", F.lit("calls")))
        edges, told = resolve.resolve(refs, nodes)
        edges = cut(resolve.numbered(edges))
        per_file = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("node_count"))
        listed = parsed.where("part = 0").select("path", "parse_status").join(sources.select("path", "language", "size", "git_blob_hash", F.md5("content").alias("content_hash")), "path").join(per_file, "path", "left")
        listed = listed.withColumns({"node_count": F.coalesce("node_count", F.lit(0)), "indexed_at": now})
        stats = told.first()
        counts = {"nodes": nodes.count(), "chunks": chunks.count(), "resolved": stats.resolved, "unresolved": stats.unresolved}
        return {"nodes": nodes, "edges": edges, "chunks": chunks, "files": listed, "unresolved_refs": refs, "postings": search.postings(chunks)}, counts

    def write_incremental(self, changed: list[str]) -> None:
        """Only the rows of some paths anew, and no row of files that are gone."""
        sources = self._sources()
        some = self.spark.createDataFrame([(p,) for p in changed], "path string")
        fresh = sources.join(small_side(some), "path", "left_semi")
        new, _ = self.tables(fresh, parse.parse_parts(fresh))
        old = pruned(self._open().tables(), sources)
        every = {n: merged(old[n], new[n].select(old[n].columns), some.withColumnRenamed("path", k), k) for n, k in (("nodes", "file_path"), ("chunks", "file_path"), ("files", "path"), ("unresolved_refs", "file_path"))}
        edges = resolve.with_ends(old["edges"].join(small_side(new["nodes"].select(F.col("id").alias("source"))), "source", "left_anti").select(old["edges"].columns), every["nodes"])
        refs = cut(every["unresolved_refs"])
        made, _ = resolve.resolve(refs, every["nodes"], edges)
        first = (edges.agg(F.max("edge_id")).first()[0] or 0) + 1
        numbered = resolve.numbered(made, first).withColumn("col", F.col("col").cast("int"))
        every["postings"] = search.postings(every["chunks"])
        self.store.write(every | {"edges": cut(edges.unionByName(numbered.select(edges.columns)))}, {k: v for k, v in self.store.meta().items() if k != "schema_version"})

    def sync(self) -> IndexStats:
        """Warm the parse cache and count; the index stays as it is."""
        began = time.monotonic()
        parsed, _ = self._parsed(self._sources())
        n = parsed.agg(F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("symbols"), F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks")).first()
        return IndexStats(self.cache_stats["total"], self.cache_stats["hits"], n.symbols, 0, n.chunks, int(1000 * (time.monotonic() - began)))

    def sync_state(self) -> dict | None:
        return self._open().meta().get("sync_state") if self.store.exists() else None

    def rank(self, damping: float = 0.85, epsilon: float = 1e-6, max_iterations: int = 100) -> rank.Ranking:
        """PageRank of the nodes, written to them."""
        nodes = self._table("nodes")
        found = rank.pagerank(nodes, self._table("edges"), damping, epsilon, max_iterations)
        self._replace(nodes=rank.written_back(nodes, found.ranks))
        return found

    def import_scip(self, path: str) -> dict[str, int]:
        """Add the edges of a SCIP index and drop the heuristic ones of the files it covers."""
        if not self.store.exists():
            raise ValueError("no nodes: index before importing")
        documents = cut(scip.read_index(self.spark, path))
        edges = self._table("edges")
        found = scip.import_index(documents, self._table("nodes"), edges)
        first = (edges.agg(F.max("edge_id")).first()[0] or 0) + 1
        new = resolve.numbered(found.edges.withColumn("file_path", F.lit("")), first).withColumn("col", F.lit(None).cast("int"))
        stats = found.stats.first().asDict()
        self._replace(edges=cut(found.kept.unionByName(new.select(found.kept.columns))))
        return stats

    def _replace(self, **new: DataFrame) -> None:
        tables = {n: df for n, df in self._open().tables().items() if n != "meta"} | {"postings": self._index()}
        self.store.write(tables | new, {k: v for k, v in self.store.meta().items() if k != "schema_version"})

    # questions

    def _index(self) -> DataFrame:
        """The inverted index, which is written with the chunks."""
        return self._table("postings")

    def search(self, query: str, top_k: int = 20, **options: object) -> DataFrame:
        return search.search(self._table("chunks"), self._table("nodes"), self._table("edges"), query, top_k, index=self._index(), **options)

    def search_debug(self, query: str, top_k: int = 20, **options: object) -> DataFrame:
        return search.search_debug(self._table("chunks"), self._table("nodes"), self._table("edges"), query, top_k, index=self._index(), **options)

    def resolve_node_id(self, name: str) -> str:
        return graph.resolve_id(self._table("nodes"), name)

    def callers_graph(self, node: str, depth: int = 1) -> graph.Walk:
        return graph.walk(self._table("edges"), node, depth, nodes=self._table("nodes"))

    def callees_graph(self, node: str, depth: int = 1) -> graph.Walk:
        return graph.walk(self._table("edges"), node, depth, reverse=False, nodes=self._table("nodes"))

    def impact_graph(self, node: str, depth: int = 3) -> graph.Walk:
        return graph.impact(self._table("nodes"), self._table("edges"), node, depth)

    def callers(self, node: str, depth: int = 1) -> DataFrame:
        return self.callers_graph(node, depth).layers(self._table("nodes"))

    def callees(self, node: str, depth: int = 1) -> DataFrame:
        return self.callees_graph(node, depth).layers(self._table("nodes"))

    def impact(self, node: str, depth: int = 3) -> DataFrame:
        return self.impact_graph(node, depth).layers(self._table("nodes"))

    def top_ranked_nodes(self, n: int = 20, file_path: str | None = None) -> DataFrame:
        return observe.top_nodes(self._table("nodes"), n, file_path)

    def node_rank(self, node: str) -> float:
        """The rank of a node, 0 if there is none."""
        return rank.rank_of(self._table("nodes"), node)

    def graph_data(self, limit: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
        return graph.graph_data(self._table("nodes"), self._table("edges"), limit)

    def node_detail(self, node: str) -> DataFrame:
        return observe.node_detail(self._table("nodes"), F.lit(node))

    def stats(self) -> dict:
        """Sizes, health, languages, tokens by folder and what changed last."""
        t = {n: self._table(n) for n in ("files", "nodes", "edges", "chunks")}
        one = observe.overview(t["files"], t["nodes"], t["edges"], t["chunks"]).first().asDict()
        state = self.sync_state() or {}
        languages = {r.language: r.n for r in observe.language_histogram(t["files"]).collect()}
        return {"index": one, "db_size": self.store.size(), "languages": languages, "token_map": observe.treemap(observe.tokens_by_file(t["chunks"])), "sync_queue": [{"path": p, "status": "parsed"} for p in state.get("changed_files", [])]}

    # packs

    def pack(self, budget: int = TOKEN_BUDGET, form: str = "xml", strategy: str = "auto", always_full: list[str] | None = None, restrict_to: DataFrame | list[str] | None = None) -> Pack:
        """The tree, or some of its files (an empty list: none), within a budget of tokens."""
        sources = self._sources()
        if restrict_to is not None:
            some = self.spark.createDataFrame([(p,) for p in restrict_to], "path string") if isinstance(restrict_to, list) else restrict_to
            sources = sources.join(small_side(some.select(text.plain_path(F.col("path")).alias("path")).distinct()), "path", "left_semi")
            parsed, _ = parse.parse_cached(sources, self._open().side("parse_cache"))
        else:
            parsed, _ = self._parsed(sources)
        ranks = observe.file_importance(self._table("nodes")).withColumnRenamed("file_path", "path") if self.store.exists() else None
        packed = packs.compress(cut(packs.rendered(parse.whole_files(parsed), sources)), ranks, budget, strategy, always_full, self.vocabulary)
        packed = replace(packed, files=cut(packed.files), expand=cut(packed.expand))
        counts = packs.layer_counts(packed.files).first().asDict()
        made = Pack(packs.render(packed, form), packed, counts)
        meta = {"budget": budget, "strategy": strategy, "timestamp": time.time(), "file_count": made.file_count, "token_count": packed.total}
        self.store.write_side("expand_map", packed.expand, meta)
        self._expand = (packed.expand, meta)
        return made

    def pack_preview(self, **options: object) -> tuple[DataFrame, Pack]:
        made = self.pack(**options)
        return packs.preview(made.packed.files), made

    def pack_scoped(self, since: str | None = None, depth: int = 2, **options: object) -> Pack:
        """The changed files and those that the change touches; an error outside a repository or for an unknown ref."""
        changed = files.changed_files(self.root, since)
        if changed is None:
            raise RuntimeError(f"no changes against {since or 'HEAD'}: not a repository, or an unknown ref")
        more = self._beyond(changed, lambda nodes, edges, seeds: graph.touched_files(nodes, edges, seeds, depth)) if depth > 0 else []
        return replace(self.pack(restrict_to=[*changed, *more], **options), scope="since" if since else "changed", scope_arg=since, seed_files=changed, expanded_files=more)

    def pack_query(self, query: str, top_k: int = 10, depth: int = 2, **options: object) -> Pack:
        """The files of the best hits, and of the neighbourhood of these and of what is related to the hits."""
        hits = self.search(query, top_k).select("file_path", "related_nodes").collect()
        seeds = sorted({h.file_path for h in hits})
        related = sorted({n for h in hits for n in h.related_nodes or []})
        more = self._beyond(seeds, lambda nodes, edges, seed: graph.neighbouring_files(nodes, edges, seed, related, depth)) if depth > 0 else []
        return replace(self.pack(restrict_to=[*seeds, *more], **options), scope="query", scope_arg=query, seed_files=seeds, expanded_files=more)

    def _beyond(self, seeds: list[str], reach: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> list[str]:
        if not seeds or not self.store.exists():
            return []
        some = self.spark.createDataFrame([(p,) for p in seeds], "file_path string")
        return sorted(r.file_path for r in reach(self._table("nodes"), self._table("edges"), some).collect())

    def list_expandable(self) -> tuple[DataFrame, dict] | None:
        """The placeholders of the last pack and what it was; None without one."""
        self._open()
        if self._expand is None:
            found = self.store.side("expand_map")
            self._expand = None if found is None else (found, self.store.side_meta("expand_map"))
        return self._expand

    def expand_entry(self, one: str) -> dict:
        listed = self.list_expandable()
        found = listed[0].where(F.col("id") == one).first() if listed else None
        if found is None:
            raise KeyError(f"unknown placeholder: {one}; pack first")
        return found.asDict()

    def expand(self, one: str) -> str:
        """What a placeholder stands for, from the file as it is now (a byte order mark doesn't count)."""
        e = self.expand_entry(one)
        data = Path(self.root, e["path"]).read_bytes().decode("utf-8-sig", "replace")
        return data[e["start_byte"] : e["end_byte"]]

