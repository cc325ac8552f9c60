"""The driver's tables as those of an index: documents as files, parts as symbols, neighbouring order lines as calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import line_windows
from ..session import cut

EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "md", "PY", "txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language and content; the path's extension goes round by doc_id."""
    ending = F.element_at(F.array(*(F.lit(e) for e in EXTENSIONS)), (F.pmod("doc_id", F.lit(len(EXTENSIONS))) + 1).cast("int"))
    path = F.concat_ws("/", "source", "lang", F.concat_ws(".", F.col("doc_id").cast("string"), ending))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))


def windows(spark: SparkSession, sf_dir: str, capacity: int = 512) -> DataFrame:
    """Line windows of documents: doc_id, id, file_path, start_line, end_line (from 1) and body."""
    each = files(spark, sf_dir).where("content is not null").select("doc_id", F.col("path").alias("file_path"), F.explode(line_windows(F.col("content"), capacity)).alias("w"))
    body = F.col("w.body")
    lines = F.size(F.split(body, "\n", -1))
    return each.where(F.trim(F.regexp_replace(body, r"\s", "")) != "").select("doc_id", F.concat_ws(":", "doc_id", "w.line").alias("id"), "file_path", (F.col("w.line") + 1).alias("start_line"), (F.col("w.line") + lines).alias("end_line"), body.alias("body"))


def nodes(spark: SparkSession, sf_dir: str, pagerank: DataFrame | None = None) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("function").alias("kind"), F.col("p_name").alias("name"), F.concat_ws("::", "p_type", "p_name").alias("qualified_name"), F.col("p_brand").alias("file_path"), F.lit("x").alias("language"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"), (F.col("p_retailprice") / 10000).alias("pagerank"))
    return part if pagerank is None else part.drop("pagerank").join(pagerank, "id")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source and target: a line of an order and the next one, each as often as it occurs.

    Lines of one number and part make the same links in any order, so supplier and quantity, which the SQL orders by, need not be shuffled."""
    every = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return every.select(F.col("l_partkey").alias("source"), after.alias("target"), F.col("l_linenumber").alias("line"), "l_orderkey").where("target is not null")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with ids: the order's number and line are unique enough to order by, repeated rows share an id."""
    edge_id = F.xxhash64("l_orderkey", "line", "source", "target")
    return links(spark, sf_dir).select(edge_id.alias("edge_id"), "source", "target", F.lit("calls").alias("kind"), "line", F.lit("heuristic").alias("provenance"))


def kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(edges(spark, sf_dir))


#: The same adapters in SQL.
FILES_SQL = "SELECT doc_id, source || '/' || lang || '/' || doc_id || '.' || ['" + "','".join(EXTENSIONS) + f"'][(doc_id % {len(EXTENSIONS)} + 1)::INT] AS path, lang AS language, text AS content FROM documents"
NODES_SQL = "SELECT p_partkey AS id, p_name AS name, p_type || '::' || p_name AS qualified_name, p_brand AS file_path, p_size AS start_line, p_size + 5 AS end_line, p_retailprice / 10000 AS pagerank FROM part"
LINKS_SQL = """SELECT source, target, line FROM (
  SELECT l_partkey AS source, l_linenumber AS line,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS target
  FROM lineitem) WHERE target IS NOT NULL"""
WINDOWS_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
sized AS (
  SELECT doc_id, i, line, length(line) + 1 AS size, max(i) OVER (PARTITION BY doc_id) AS last FROM lines),
fold AS (
  SELECT doc_id, i, size AS upto, 0::BIGINT AS first, last FROM sized WHERE i = 0
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN f.upto >= 512 THEN s.size ELSE f.upto + s.size END,
    CASE WHEN f.upto >= 512 THEN s.i ELSE f.first END, f.last
  FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
windows AS (
  SELECT f.doc_id, f.first, string_agg(s.line, chr(10) ORDER BY s.i) AS body, count(*) AS n
  FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.i = f.i GROUP BY f.doc_id, f.first)
SELECT doc_id, doc_id || ':' || first AS id, first + 1 AS start_line, first + n AS end_line, body
FROM windows WHERE trim(regexp_replace(body, '\s', '', 'g')) <> ''"""
