"""Each stage of the pipeline against a plain version, on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sluice.llm import secrets
from tests.llm.edge import hard
from tests.llm.test_operators import brute_links


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_keep_the_columns(spark, docs, sf_dir):
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == list(P.COLUMNS), name


def test_near_duplicates_keep_one_of_each_group(spark, docs, sf_dir):
    links = brute_links({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, sf_dir).collect()} == {i for i, (root, _) in links.items() if i == root}


def test_secrets_are_masked_and_all_rows_stay(spark, docs, sf_dir):
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in P.secrets(spark, docs, sf_dir).collect():
        assert r["text"] == secrets.redact(before[r["doc_id"]], secrets.spans_of(before[r["doc_id"]])) and r["n_chars"] == len(r["text"])


def test_mixing_keeps_all_rows(spark, docs, sf_dir):
    assert P.mixing(spark, docs, sf_dir).exceptAll(docs.select(*P.COLUMNS)).count() == 0
    assert P.mixing(spark, docs, sf_dir).count() == docs.count()


def test_toxicity_takes_labelled_toxic_and_leaves_most_clean(spark, docs, sf_dir):
    kept = {r["doc_id"] for r in P.toxicity(spark, docs, sf_dir).collect()}
    clean = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").select("doc_id").collect()
    assert sum(r["doc_id"] in kept for r in clean) >= 0.97 * len(clean)


def test_hard_rows_pass_all_stages(spark, sf_dir):
    now = hard(spark).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        now = stage(spark, now, sf_dir)
    assert {r["doc_id"] for r in now.select("doc_id").distinct().collect()} == {1, 3, 4, 5, 6, 8, 9, None}


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.agg(F.countDistinct("doc_id")).first()[0] > 100


def test_run_follows_the_target_weights(spark, sf_dir, monkeypatch):
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()}

    def placed():
        out = P.run(spark, sf_dir).groupBy("doc_id").agg(F.min(F.col("sequence_id") * 1024 + F.col("offset")).alias("at")).orderBy("at").collect()
        return [source[r["doc_id"]] for r in out]

    before = placed()
    heavy = min(set(before) - set(before[: P.STRETCH_ROWS]))  # a source that comes late by default
    monkeypatch.setattr(P, "WEIGHTS", {s: 1000.0 if s == heavy else 1.0 for s in set(before)})
    after = placed()
    assert sorted(after) == sorted(before) and after[: P.STRETCH_ROWS].count(heavy) == before.count(heavy)


def test_packing_reads_the_written_order(spark):
    rows = spark.range(1000, numPartitions=7).withColumn("k", (F.col("id") * 389) % 1000)
    for df in (rows.orderBy("k"), P.materialize(rows.orderBy("k"), "order")):
        assert P.written_order(df, "order", "place").where("place <> k").count() == 0
