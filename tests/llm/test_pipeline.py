import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from galena.llm import decontamination, exact_dedup, near_dedup, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        was = {r.doc_id for r in before.select("doc_id").collect()}
        if name != "mixing":
            assert docs.columns == columns
        gone = {
            "toxicity": lambda b: {r.doc_id for r in toxicity.score(b, labels).where("is_toxic").collect()},
            "exact_dedup": lambda b: {r.doc_id for r in exact_dedup.copies(b).collect()},
            "near_dedup": lambda b: {r.doc_id for r in near_dedup.groups(b).collect()},
            "decontamination": lambda b: {r.doc_id for r in decontamination.leaks(b, bench).collect()},
            "mixing": lambda b: was - kept["mixing"],
        }[name](before)
        assert kept[name] == was - gone
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == [*columns, "rate", "copy"]
    assert {tuple(r) for r in whole.select("doc_id", "copy").collect()} == {tuple(r) for r in docs.select("doc_id", "copy").collect()}


def test_stages_with_nulls_and_more_columns(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "s", None), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = odd.withColumn("rate", F.lit(1.0)).withColumn("copies", F.lit(1)).withColumn("leaking", F.lit(1)).withColumn("toxicity", F.lit(1)).withColumn("kept_id", F.lit(2)).withColumn("content_hash", F.lit(3))
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.columns[: len(frame.columns)] == frame.columns, name
            assert out.count() == {"exact_dedup": 4}.get(name, 5) * (frame is docs) or name == "mixing"


def test_queries_against_their_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        frame = queries.QUERIES[name](spark, SF)
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(frame.columns) == sorted(names), name
        plain = lambda rows: sorted([tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows], key=str)
        assert plain(frame.select(*names).collect()) == plain(found.fetchall()), name
