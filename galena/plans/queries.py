"""The registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import graph, layers, observe, packs, rank, resolve, search
from ..session import cut
from ..streaming.sessions import change_sessions
from . import adapters as A
from . import code  # noqa: F401  its queries register themselves
from .registry import QUERIES, SQL, query
from .registry import bm25_sql as _bm25_sql

__all__ = ["QUERIES", "SQL"]


def big(*columns: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


# search


@query(_bm25_sql(["license"], 60))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(A.whole_chunks(spark, sf_dir), "License", search.recall_size(20)).select("id", F.round("score", 6).alias("score"), "bm25_rank")


@query(_bm25_sql(["apache", "version"], None))
def bm25_two_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(A.whole_chunks(spark, sf_dir), "ApacheVersion of").select("id", F.round("score", 6).alias("score"))


# files


@query("""
SELECT doc_id, len(ls)::INT AS num_lines, list_max(list_transform(ls, lambda x: length(x)))::INT AS max_line,
  round((length(text) - (len(ls) - 1))::DOUBLE / len(ls), 6) AS avg_line,
  round(length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g'))::DOUBLE / greatest(length(text), 1), 6) AS alnum_fraction,
  round(length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / greatest(length(text), 1), 6) AS digit_fraction
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)""")
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.metrics(F.col("text"))
    return A.table(spark, sf_dir, "documents").select("doc_id", *(F.round(c, 6).alias(k) if "_line" != k[-5:] or k == "avg_line" else c.alias(k) for k, c in m.items() if k != "num_lines"), m["num_lines"].alias("num_lines"))


_VALID_SQL = f"""
WITH files AS ({A.FILES_SQL}),
m AS (
  SELECT path, content, len(ls) AS n, list_max(list_transform(ls, lambda x: length(x))) AS longest,
    (length(content) - (len(ls) - 1))::DOUBLE / len(ls) AS average,
    length(regexp_replace(content, '[^0-9A-Za-z]', '', 'g'))::DOUBLE / greatest(length(content), 1) AS alnum,
    length(regexp_replace(content, '[^0-9]', '', 'g'))::DOUBLE / greatest(length(content), 1) AS digits
  FROM (SELECT path, content, string_split(content, chr(10)) AS ls FROM files)),
judged AS (
  SELECT path, content, length(content) = 0 OR ((regexp_matches(path, '\\.(md|txt)$') OR (longest <= 300 AND average <= 150))
    AND alnum >= 0.25 AND n <= 100000 AND digits <= 0.5) AS valid FROM m)"""


@query(_VALID_SQL + " SELECT path, valid FROM judged")
def valid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.files(spark, sf_dir).select("path", text.is_valid(F.col("content"), F.col("path")).alias("valid"))


@query(_VALID_SQL + """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN octet_length(encode(content)) > 20000 THEN 'size-limit' WHEN contains(content, chr(0)) THEN 'binary-content'
    WHEN NOT valid THEN 'invalid-file' ELSE 'kept' END AS reason FROM judged) GROUP BY reason""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import decoded, skip_reason

    raw = A.files(spark, sf_dir).select("path", F.col("content").cast("binary").alias("bytes"))
    return decoded(raw.where("bytes is not null"), 20_000).groupBy(F.coalesce(skip_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
SELECT coalesce(map {{'ts': 'typescript', 'tsx': 'tsx', 'js': 'javascript', 'jsx': 'jsx', 'py': 'python', 'go': 'go', 'rs': 'rust', 'java': 'java'}}[lower(regexp_extract(path, '\\.([^.]*)$', 1))], 'unknown') AS language, count(*) AS n
FROM ({A.FILES_SQL}) GROUP BY 1""")
def detect_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.language_histogram(A.files(spark, sf_dir).select(text.language(F.col("path")).alias("language")))


@query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY lang")
def language_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.language_histogram(A.files(spark, sf_dir))


def _with_status(files: DataFrame) -> DataFrame:
    return files.withColumn("parse_status", F.when(text.language(F.col("path")) == "unknown", "degraded").otherwise("ok"))


@query(f"""
SELECT count(*) FILTER (NOT d) AS ok, count(*) FILTER (d) AS degraded, 0::BIGINT AS failed, 0::BIGINT AS skipped
FROM (SELECT regexp_matches(path, '\\.(md|txt)$') AS d FROM ({A.FILES_SQL}))""")
def health_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.health(_with_status(A.files(spark, sf_dir)))


@query(f"SELECT id, substr(sha1(file_path || ':' || qualified_name), 1, 16) AS symbol_id FROM ({A.NODES_SQL})")
def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nodes(spark, sf_dir).select("id", ids.symbol_id(F.col("file_path"), F.col("qualified_name")).alias("symbol_id"))


@query(f"SELECT count(*) AS rows_in, count(DISTINCT file_path || ':' || qualified_name) AS rows_kept, max(k) AS most FROM (SELECT file_path, qualified_name, count(*) OVER (PARTITION BY file_path, qualified_name) AS k FROM ({A.NODES_SQL}))")
def symbol_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = A.nodes(spark, sf_dir).groupBy(ids.symbol_id(F.col("file_path"), F.col("qualified_name"))).agg(F.count("*").alias("k"))
    return by.agg(F.sum("k").alias("rows_in"), F.count("*").alias("rows_kept"), F.max("k").alias("most"))


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text)) || chr(0) || text)) AS blob_hash FROM documents")
def blob_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", ids.blob_hash(F.col("text")).alias("blob_hash"))


_CAMEL_SQL = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') || 'XMLParser'"


@query(f"SELECT p_partkey AS id, regexp_replace(regexp_replace(c, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') AS words FROM (SELECT p_partkey, {_CAMEL_SQL} AS c FROM part)")
def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.concat(F.array_join(F.transform(F.split("p_name", " "), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), ""), F.lit("XMLParser"))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.split_camel(joined).alias("words"))


@query(A.WINDOWS_SQL)
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.windows(spark, sf_dir).select("doc_id", "id", *big("start_line", "end_line"), "body")


# tokens


def _file_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens stand for words here, so that SQL can count them."""
    return A.files(spark, sf_dir).select(F.col("path").alias("file_path"), F.regexp_count("content", F.lit(r"\S+")).cast("bigint").alias("token_count"))


_TOKENS_SQL = f"SELECT path AS file_path, len(regexp_extract_all(content, '\\S+')) AS tokens FROM ({A.FILES_SQL})"


@query(_TOKENS_SQL)
def token_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.tokens_by_file(_file_tokens(spark, sf_dir))


@query(f"""
WITH t AS ({_TOKENS_SQL}), p AS (SELECT tokens, string_split(file_path, '/') AS ps, unnest(range(len(string_split(file_path, '/')) + 1)) AS k FROM t),
a AS (SELECT array_to_string(ps[1:k], '/') AS path, CASE WHEN k > 0 THEN array_to_string(ps[1:k - 1], '/') END AS parent, k, k = len(ps) AS leaf, tokens FROM p)
SELECT coalesce(path, '') AS path, CASE WHEN k > 0 THEN coalesce(parent, '') END AS parent, k::INT AS depth, bool_or(leaf) AS is_leaf, sum(tokens)::BIGINT AS tokens,
  round(sum(tokens) / (SELECT sum(tokens) FROM t), 9) AS share FROM a GROUP BY path, parent, k""")
def token_treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.treemap(observe.tokens_by_file(_file_tokens(spark, sf_dir))).withColumn("share", F.round("share", 9))


@query(f"""
WITH p AS (SELECT string_split(path, '/') AS ps, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM ({A.FILES_SQL}))
SELECT row_number() OVER (ORDER BY key) AS place, line FROM (
  SELECT DISTINCT list_transform(ps[1:k], lambda x, i: {{'file': k = len(ps) AND i = k, 'name': x}}) AS key, repeat('  ', (k - 1)::INT) || ps[k] || CASE WHEN k = len(ps) THEN '' ELSE '/' END AS line FROM p)""")
def dir_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree without layers, in its order."""
    files = A.files(spark, sf_dir).select("path", F.lit(None).cast("string").alias("layer"))
    return packs.tree_lines(files, show_layers=False).select(F.col("place").cast("bigint").alias("place"), "line")


# containment


_SPANS_SQL = f"WITH w AS ({A.WINDOWS_SQL})"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line windows as symbols, and the whole document around them."""
    w = A.windows(spark, sf_dir)
    inner = w.select("doc_id", "id", F.col("doc_id").alias("file_path"), "start_line", "end_line")
    outer = w.groupBy("doc_id").agg(F.max("end_line").alias("end_line")).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":all")).alias("id"), F.col("doc_id").alias("file_path"), F.lit(1).alias("start_line"), "end_line")
    return inner.unionByName(outer).withColumns({"start_byte": F.col("start_line") * 100, "end_byte": F.col("end_line") * 100})


@query(_SPANS_SQL + """,
spans AS (SELECT doc_id, id, start_line, end_line FROM w UNION ALL SELECT doc_id, doc_id || ':all', 1, max(end_line) FROM w GROUP BY doc_id),
points AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
around AS (SELECT p.doc_id, p.line, s.id, row_number() OVER (PARTITION BY p.doc_id, p.line ORDER BY s.end_line - s.start_line, s.start_line, s.id) AS k
  FROM points p LEFT JOIN spans s ON s.doc_id = p.doc_id AND p.line BETWEEN s.start_line AND s.end_line)
SELECT doc_id, line, id AS symbol FROM around WHERE k = 1""")
def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References stand on every line of every document."""
    n = F.size(text.lines(F.col("text")))
    points = A.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("file_path"), F.explode(F.sequence(F.lit(1), n)).alias("line"))
    points = points.withColumn("ref_id", F.struct("file_path", "line"))
    found = resolve.innermost(points, _spans(spark, sf_dir))
    return found.select(F.col("ref_id.file_path").alias("doc_id"), F.col("ref_id.line").cast("bigint").alias("line"), F.col("from_node_id").alias("symbol"))


@query(_SPANS_SQL + " SELECT a.id AS a_id, b.id AS b_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.start_line <= b.end_line + 1 AND a.end_line + 1 >= b.start_line")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that touch: each is stretched by a line."""
    w = A.windows(spark, sf_dir).select("id", F.col("doc_id").alias("file_path"), "start_line", (F.col("end_line") + 1).alias("end_line"))
    return resolve.overlapping(w, w)


@query(_SPANS_SQL + """,
spans AS (SELECT doc_id, id, start_line, end_line FROM w UNION ALL SELECT doc_id, doc_id || ':all', 1, max(end_line) FROM w GROUP BY doc_id),
around AS (SELECT i.id, o.id AS outer_id, o.start_line AS s, o.end_line AS e FROM spans i JOIN spans o ON i.doc_id = o.doc_id AND o.start_line <= i.start_line AND o.end_line >= i.end_line AND (o.start_line < i.start_line OR o.end_line > i.end_line))
SELECT id, string_agg(outer_id, ' > ' ORDER BY s, e DESC, outer_id) AS scope FROM around GROUP BY id""")
def scip_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strict enclosers of a span, outermost first."""
    return resolve.scopes(_spans(spark, sf_dir)).select("id", F.array_join("scope", " > ").alias("scope"))


# references


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines refer to parts by name, from the part's brand; a fifth of the names mean nothing."""
    line = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    name = F.when(F.col("l_suppkey") % 5 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name"))
    source = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_partkey"))
    return line.join(part, "l_partkey").select(source.alias("from_node_id"), name.alias("reference_name"), F.col("p_brand").alias("file_path"), F.lit("x").alias("language"), F.col("l_linenumber").alias("line"), F.lit(None).cast("int").alias("col"))


_RESOLVE_SQL = f"""
WITH nodes AS ({A.NODES_SQL}),
refs AS (
  SELECT CASE WHEN l_suppkey % 7 <> 0 THEN l_partkey END AS source, p_name || CASE WHEN l_suppkey % 5 = 0 THEN '?' ELSE '' END AS name, p_brand AS file_path, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey),
same AS (SELECT name, file_path, arg_min(id, (start_line, id)) AS id FROM nodes GROUP BY name, file_path),
anywhere AS (SELECT name, arg_min(id, (file_path, start_line, id)) AS id FROM nodes GROUP BY name),
placed AS (SELECT r.source, r.line, coalesce(s.id, a.id) AS target FROM refs r LEFT JOIN same s ON r.name = s.name AND r.file_path = s.file_path LEFT JOIN anywhere a ON r.name = a.name)"""


@query(_RESOLVE_SQL + " SELECT DISTINCT source, target, line FROM placed WHERE source IS NOT NULL AND target IS NOT NULL")
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(_refs(spark, sf_dir), A.nodes(spark, sf_dir))[0].select("source", "target", "line")


@query(_RESOLVE_SQL + " SELECT count(*) FILTER (target IS NOT NULL) AS resolved, count(*) FILTER (target IS NULL) AS unresolved FROM placed WHERE source IS NOT NULL")
def unresolved_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(_refs(spark, sf_dir), A.nodes(spark, sf_dir))[1]


@query(f"SELECT source, target, line, count(*) AS n FROM ({A.LINKS_SQL}) GROUP BY ALL")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.edges(spark, sf_dir)
    return resolve.distinct_edges(e).join(e.groupBy("source", "target", "line").agg(F.count("*").alias("n")), ["source", "target", "line"]).select("source", "target", "line", "n")


# changes of the index


@query("SELECT doc_id FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'de')")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live are the sources that have a German document."""
    from ..sources.store import pruned

    d = A.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), "lang")
    return pruned({"files": d}, d.where("lang = 'de'"))["files"].select("doc_id")


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN upper(md5(text)) ELSE md5(text) END AS content_hash FROM documents")
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French documents have changed: their new rows replace the old ones."""
    from ..sources.store import merged

    old = A.table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("content_hash"))
    new = old.where("lang = 'fr'").withColumn("content_hash", F.upper("content_hash"))
    return merged(old, new, new.select("doc_id"), "doc_id").select("doc_id", "content_hash")


@query(f"WITH live AS (SELECT p_partkey AS id FROM part WHERE p_size > 10) SELECT source, target, line FROM ({A.LINKS_SQL}) WHERE source IN (SELECT id FROM live) AND target IN (SELECT id FROM live)")
def cascade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that start above line 10 are gone."""
    return resolve.with_ends(A.edges(spark, sf_dir), A.nodes(spark, sf_dir).where("start_line > 10")).select("source", "target", "line")


@query(f"SELECT count(*) AS kept FROM ({A.LINKS_SQL}) WHERE target IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#11')")
def orphan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.edges(spark, sf_dir)
    return e.join(A.nodes(spark, sf_dir).where("file_path <> 'Brand#11'").select(F.col("id").alias("target")), "target", "left_semi").agg(F.count("*").alias("kept"))


# ranks


@query(f"SELECT source, count(*) AS out_degree FROM ({A.LINKS_SQL}) GROUP BY source")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.out_degrees(A.edges(spark, sf_dir))


@query("SELECT p_name AS name, count(DISTINCT p_brand) AS n_files FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 17")
def overheated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.overheated(A.nodes(spark, sf_dir), 17)


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.pagerank(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), epsilon=0.0, max_iterations=10, private=F.col("name").startswith("small"), files=17).ranks


def _rank_sql(iterations: int = 10) -> str:
    steps = "".join(f""",
r{k} AS (SELECT n.id, 0.15 / (SELECT c FROM size) + 0.85 * coalesce(i.s, 0) + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE id NOT IN (SELECT source FROM degree)) / (SELECT c FROM size) AS r
  FROM nodes n LEFT JOIN (SELECT f.target, sum(r.r * f.w) AS s FROM flow f JOIN r{k - 1} r ON f.source = r.id GROUP BY f.target) i ON n.id = i.target)""" for k in range(1, iterations + 1))
    return f"""
WITH nodes AS MATERIALIZED ({A.NODES_SQL}), links AS MATERIALIZED ({A.LINKS_SQL}), size AS (SELECT count(*)::DOUBLE AS c FROM nodes),
hot AS (SELECT name FROM nodes GROUP BY name HAVING count(DISTINCT file_path) > 17),
degree AS MATERIALIZED (SELECT source, count(*)::DOUBLE AS d FROM links GROUP BY source),
flow AS MATERIALIZED (SELECT l.source, l.target, (CASE WHEN starts_with(n.name, 'small') THEN 0.1::DOUBLE ELSE 1 END) * (CASE WHEN n.name IN (SELECT name FROM hot) THEN 0.1::DOUBLE ELSE 1 END) / d.d AS w
  FROM links l JOIN degree d ON l.source = d.source JOIN nodes n ON l.target = n.id),
r0 AS (SELECT id, 1 / (SELECT c FROM size) AS r FROM nodes){steps}"""


@query(_rank_sql() + " SELECT id, round(r, 9) AS pagerank FROM r10")
def pagerank_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranking(spark, sf_dir).select("id", F.round("pagerank", 9).alias("pagerank"))


@query(f"SELECT id, pagerank FROM ({A.NODES_SQL}) ORDER BY pagerank DESC, id LIMIT 20")
def top_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.top_nodes(A.nodes(spark, sf_dir), 20).select("id", "pagerank")


@query(f"SELECT id, pagerank, rank() OVER (ORDER BY pagerank DESC) AS rank FROM ({A.NODES_SQL})")
def node_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.global_rank(A.nodes(spark, sf_dir)).select("id", "pagerank", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT file_path, string_agg(id::VARCHAR, ',' ORDER BY k) AS related_nodes FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY pagerank DESC, start_line, id) AS k FROM ({A.NODES_SQL})) WHERE k <= 5 GROUP BY file_path")
def related_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.top_in_file(A.nodes(spark, sf_dir)).select("file_path", F.array_join(F.transform("related_nodes", lambda x: x.cast("string")), ",").alias("related_nodes"))


@query(f"SELECT file_path, max(pagerank) AS importance FROM ({A.NODES_SQL}) GROUP BY file_path")
def file_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.file_importance(A.nodes(spark, sf_dir))


# walks

START = 7
_LINKS = f"WITH e AS MATERIALIZED ({A.LINKS_SQL})"
_STARTS = f"(SELECT max_by(target, (n, -target)) FROM (SELECT target, count(*) AS n FROM ({A.LINKS_SQL}) GROUP BY target))"


def _start(e: DataFrame) -> int:
    """The most called part."""
    return e.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "target").first().target


def _walk_sql(near: str, far: str) -> str:
    return _LINKS + f""", l0 AS (SELECT {_STARTS} AS id),
l1 AS (SELECT DISTINCT {far} AS id FROM e WHERE {near} IN (SELECT id FROM l0) AND {far} NOT IN (SELECT id FROM l0)),
l2 AS (SELECT DISTINCT {far} AS id FROM e WHERE {near} IN (SELECT id FROM l1) AND {far} NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1))
SELECT id, 0 AS depth FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2"""


@query(_walk_sql("target", "source"))
def callers_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.kept_edges(spark, sf_dir)
    return graph.walk(e, _start(e), 2, cap=None, nodes=A.nodes(spark, sf_dir)).nodes


@query(_LINKS + f""", l0 AS (SELECT max_by(source, (n, -source)) AS id FROM (SELECT source, count(*) AS n FROM e GROUP BY source)),
l1 AS (SELECT DISTINCT target AS id FROM e WHERE source IN (SELECT id FROM l0) AND target NOT IN (SELECT id FROM l0)),
l2 AS (SELECT DISTINCT target AS id FROM e WHERE source IN (SELECT id FROM l1) AND target NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1))
SELECT id, 0 AS depth FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2""")
def callees_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.kept_edges(spark, sf_dir)
    return graph.walk(e, e.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source").first().source, 2, reverse=False, cap=None).nodes


_SIBLINGS = f", nodes AS MATERIALIZED ({A.NODES_SQL}), sib AS MATERIALIZED (SELECT a.id, b.id AS sibling FROM nodes a JOIN nodes b ON a.file_path = b.file_path AND starts_with(lower(b.qualified_name), lower(regexp_extract(a.qualified_name, '^(.*)::', 1)) || '::'))"


def _impact_sql() -> str:
    out = _LINKS + _SIBLINGS + f", v0 AS (SELECT {_STARTS} AS id, 0 AS depth), f1 AS (SELECT sibling AS id FROM sib WHERE id IN (SELECT id FROM v0))"
    for d in (1, 2):
        seeds = "SELECT id FROM v0 UNION SELECT id FROM f1" if d == 1 else f"SELECT id FROM v{d - 1} WHERE depth = {d - 1}"
        out += f""", a{d} AS (SELECT source AS id FROM e WHERE target IN ({seeds}){" UNION SELECT id FROM f1" if d == 1 else ""}),
b{d} AS (SELECT sibling AS id FROM sib WHERE id IN (SELECT id FROM a{d}) AND sibling NOT IN (SELECT id FROM v{d - 1} UNION SELECT id FROM a{d})),
c{d} AS (SELECT source AS id FROM e WHERE target IN (SELECT id FROM b{d})),
v{d} AS (SELECT id, depth FROM v{d - 1} UNION ALL SELECT id, {d} FROM (SELECT id FROM a{d} UNION SELECT id FROM b{d} UNION SELECT id FROM c{d}) WHERE id NOT IN (SELECT id FROM v{d - 1}))"""
    return out + " SELECT id, depth FROM v2"


@query(_impact_sql())
def impact_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.kept_edges(spark, sf_dir)
    return graph.impact(A.nodes(spark, sf_dir), e, _start(e), 2, cap=None).nodes


@query()
def callers_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.kept_edges(spark, sf_dir)
    return graph.walk(e, _start(e), 3).nodes


@query()
def impact_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.kept_edges(spark, sf_dir)
    return graph.impact(A.nodes(spark, sf_dir), e, _start(e), 3).nodes


@query(_LINKS + f", top AS (SELECT id FROM ({A.NODES_SQL}) ORDER BY pagerank DESC, id LIMIT 200) SELECT source, target, line FROM e WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.induced(A.nodes(spark, sf_dir), A.edges(spark, sf_dir), 200)[1].select("source", "target", "line")


def _hop_sql(seeds: str, depth: int) -> str:
    """Hops by levels that keep seeds apart; a path longer than the shortest doesn't matter to the minimum."""
    out = f", seeds AS ({seeds}), p0 AS (SELECT id AS seed, id FROM seeds)"
    parts = []
    for name, near, far in (("i", "target", "source"), ("o", "source", "target")):
        for d in range(1, depth + 1):
            before = f"{name}{d - 1}" if d > 1 else "p0"
            out += f", {name}{d} AS (SELECT DISTINCT b.seed, e.{far} AS id FROM {before} b JOIN e ON e.{near} = b.id)"
            parts.append(f"SELECT seed, id, {d} AS hop FROM {name}{d}")
    return out + f", hops AS (SELECT id, min(hop) AS hop FROM ({' UNION ALL '.join(parts)}) WHERE seed <> id GROUP BY id)"


_HOP_SEEDS = f"SELECT id FROM ({A.NODES_SQL}) ORDER BY pagerank DESC, id LIMIT 40"


@query(_LINKS + _hop_sql(_HOP_SEEDS, 2) + " SELECT id, hop FROM hops")
def min_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = cut(A.nodes(spark, sf_dir).orderBy(F.col("pagerank").desc(), "id").limit(40).select("id"))
    return graph.hops(A.kept_edges(spark, sf_dir), seeds, 2)


# fusion: documents are chunks, a document belongs to the part of its number, which is its symbol

_CHUNK_NODES = f"SELECT d.doc_id AS id, n.id AS node, n.pagerank FROM documents d JOIN ({A.NODES_SQL}) n ON d.doc_id + 1 = n.id"
_FUSED_SQL = _LINKS + ", hits AS (" + _bm25_sql(["license"], 60) + ")" + _hop_sql(f"SELECT node AS id FROM ({_CHUNK_NODES}) c JOIN hits h ON c.id = h.id ORDER BY h.bm25_rank LIMIT 40", 2) + f""",
placed AS (SELECT c.id, h.hop, row_number() OVER (ORDER BY h.hop, c.pagerank DESC, c.id) AS graph_rank FROM ({_CHUNK_NODES}) c JOIN hops h ON c.node = h.id),
fused AS (SELECT coalesce(h.id, p.id) AS id, coalesce(h.score, 0) AS score, h.bm25_rank, p.hop, p.graph_rank::INT AS graph_rank,
  coalesce(1.0::DOUBLE / (60 + h.bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + p.graph_rank), 0) AS rrf FROM hits h FULL JOIN placed p ON h.id = p.id)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = A.whole_chunks(spark, sf_dir).withColumns({"file_path": F.col("id"), "start_line": F.lit(1), "end_line": F.lit(5)})
    nodes = A.nodes(spark, sf_dir).withColumns({"file_path": F.col("id") - 1, "start_line": F.lit(1), "end_line": F.lit(5)})
    return search.search_debug(chunks, nodes, A.kept_edges(spark, sf_dir), "License", depth=2)


@query(_FUSED_SQL + " SELECT id, score, bm25_rank, hop, graph_rank, round(rrf, 9) AS rrf FROM fused")
def search_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("id", F.round("score", 6).alias("score"), "bm25_rank", "hop", "graph_rank", F.round("rrf", 9).alias("rrf"))


@query(_FUSED_SQL + " SELECT id, round(rrf, 9) AS rrf FROM fused ORDER BY fused.rrf DESC, bm25_rank NULLS LAST, graph_rank NULLS LAST LIMIT 20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _fused(spark, sf_dir).orderBy(F.col("rrf").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("graph_rank").asc_nulls_last()).limit(20)
    return best.select("id", F.round("rrf", 9).alias("rrf"))


@query(_FUSED_SQL + " SELECT id, hop, graph_rank FROM fused WHERE graph_rank IS NOT NULL")
def graph_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).where("graph_rank is not null").select("id", "hop", "graph_rank")


# scopes


_IMPACT = _impact_sql().removesuffix(" SELECT id, depth FROM v2")


@query(_IMPACT + " SELECT DISTINCT file_path, min(depth) OVER (PARTITION BY file_path) = 0 AS changed FROM v2 JOIN nodes ON v2.id = nodes.id")
def impact_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a changed symbol and of what it touches."""
    e, nodes = A.kept_edges(spark, sf_dir), A.nodes(spark, sf_dir)
    reached = graph.impact(nodes, e, _start(e), 2, cap=None).nodes
    return reached.join(nodes, "id").groupBy("file_path").agg((F.min("depth") == 0).alias("changed"))


@query(_FUSED_SQL + f""", best AS (SELECT id FROM fused ORDER BY rrf DESC, bm25_rank NULLS LAST, graph_rank NULLS LAST LIMIT 10),
seed AS (SELECT node AS id FROM ({_CHUNK_NODES}) WHERE id IN (SELECT id FROM best)),
near AS (SELECT source AS id FROM e WHERE target IN (SELECT id FROM seed) UNION SELECT target FROM e WHERE source IN (SELECT id FROM seed) UNION SELECT id FROM seed)
SELECT id, id IN (SELECT id FROM seed) AS hit FROM near""")
def query_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of the ten best hits with their direct neighbours in the call graph."""
    best = _fused(spark, sf_dir).orderBy(F.col("rrf").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("graph_rank").asc_nulls_last()).limit(10)
    nodes, e = A.nodes(spark, sf_dir), A.kept_edges(spark, sf_dir)
    seed = cut(best.select((F.col("id") + 1).alias("id")).join(nodes, "id", "left_semi"))
    return graph.neighbourhood(e, seed)


# packs


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_count("content", F.lit(r"\S+"))
    full = A.files(spark, sf_dir).where("content is not null").select("doc_id", "path", words.cast("bigint").alias("cost_full"))
    return full.select("path", "cost_full", F.floor(F.col("cost_full") / 3).alias("cost_skeleton"), F.floor(F.col("cost_full") / 10).alias("cost_outline"), (F.pmod(F.col("doc_id") * 7919, F.lit(1_000_003)) + F.col("doc_id") / 1e9).alias("importance"))


_BUDGET_DIVISOR = 6


@query(f"""
WITH c AS (SELECT path, f, f // 3 AS s, f // 10 AS o, (doc_id * 7919) % 1000003 + doc_id / 1e9 AS importance FROM (SELECT doc_id, path, len(regexp_extract_all(content, '\\S+')) AS f FROM ({A.FILES_SQL}))),
total AS (SELECT sum(f) AS t FROM c), steps AS (SELECT path, importance, 1 AS step, f - s AS saved FROM c UNION ALL SELECT path, importance, 2, s - o FROM c UNION ALL SELECT path, importance, 3, o FROM c),
run AS (SELECT path, step, t - coalesce(sum(saved) OVER (ORDER BY importance, path, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > t // {_BUDGET_DIVISOR} AS taken FROM steps, total),
layer AS (SELECT path, coalesce(max(step) FILTER (taken), 0) AS layer FROM run GROUP BY path)
SELECT c.path, layer::INT AS layer, (CASE layer WHEN 0 THEN f WHEN 1 THEN s WHEN 2 THEN o ELSE 0 END)::BIGINT AS cost FROM c JOIN layer ON c.path = layer.path""")
def layer_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents within a sixth of their words."""
    c = _candidates(spark, sf_dir)
    total = c.agg(F.sum("cost_full")).first()[0] or 0
    return layers.downgraded(c, total // _BUDGET_DIVISOR)


@query()
def layer_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages over all documents within a sixth of their words."""
    c = _candidates(spark, sf_dir)
    total = c.agg(F.sum("cost_full")).first()[0] or 0
    return layers.backfilled(c, total // _BUDGET_DIVISOR)


@query("""
SELECT doc_id, '<file path="' || source || '/' || doc_id || '">' || chr(10) || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</file>' AS rendered,
  repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`{3,}'), lambda x: length(x))) + 1, 3))::INT) AS fence FROM documents""")
def pack_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit('<file path="'), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit('">\n'), text.escape_xml(F.col("text")), F.lit("\n</file>")).alias("rendered"), text.fence(F.col("text")).alias("fence"))


# changes and overviews


@query("""
WITH gaps AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
numbered AS (SELECT *, sum((before IS NULL OR ts - before > INTERVAL 1 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gaps)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM numbered GROUP BY user_id, k""")
def change_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of changes of a user, an hour of silence apart."""
    e = A.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("path"), "user_id")
    found = change_sessions(e, "1 hour", "user_id")
    return found.select("user_id", "first", "last", "n", F.array_join("paths", ",").alias("paths"))


@query(f"""
SELECT (SELECT count(*) FROM documents) AS files, (SELECT make_timestamp(max(doc_id) * 1000000) FROM documents) AS last_indexed, (SELECT count(DISTINCT lang) FROM documents) AS languages,
  count(*) FILTER (NOT regexp_matches(path, '\\.(md|txt)$')) AS ok, count(*) FILTER (regexp_matches(path, '\\.(md|txt)$')) AS degraded, 0::BIGINT AS failed, 0::BIGINT AS skipped,
  (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM part WHERE p_retailprice > 0) AS ranked_symbols,
  (SELECT count(*) FROM ({A.LINKS_SQL})) AS edges, 0::BIGINT AS scip_edges, (SELECT count(*) FROM documents) AS chunks, (SELECT sum(n_chars)::BIGINT FROM documents) AS tokens
FROM ({A.FILES_SQL})""")
def file_stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _with_status(A.files(spark, sf_dir)).withColumn("indexed_at", F.timestamp_seconds("doc_id"))
    chunks = A.table(spark, sf_dir, "documents").select(F.col("n_chars").alias("token_count"))
    return observe.overview(files, A.nodes(spark, sf_dir), A.edges(spark, sf_dir), chunks)


@query("""
WITH old AS (SELECT doc_id, md5(text) AS h FROM documents WHERE lang <> 'es'), new AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE lang <> 'de')
SELECT count(*) FILTER (o.h = n.h) AS unchanged, count(*) FILTER (o.h <> n.h) AS changed, count(*) FILTER (o.doc_id IS NULL) AS added, count(*) FILTER (n.doc_id IS NULL) AS removed
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish documents are new, German ones gone and French ones changed."""
    from ..sources.store import compared

    d = A.table(spark, sf_dir, "documents")
    old = d.where("lang <> 'es'").select(F.col("doc_id").alias("path"), F.md5("text").alias("git_blob_hash"))
    new = d.where("lang <> 'de'").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("git_blob_hash"))
    found = compared(old, new)
    return found.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("unchanged", "changed", "added", "removed")))
