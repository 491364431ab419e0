"""Columns that are named like the operators' own."""

import pytest

import corpus_pipeline
from gridledger.llm import embedding_join, licenses, mixing, pieces, pii, quality, recurrent, simhash, token_files, toxicity
from gridledger.llm.registry import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_stages_carry_them(spark, clashing_docs, stage):
    got = stage(spark, clashing_docs, FOLDER)
    assert got.columns == clashing_docs.columns
    rows = got.collect()
    assert rows and all(r.block is None or r.block == r.doc_id % 7 for r in rows)


def test_upper_case(spark, edge_docs):
    docs = edge_docs.selectExpr("*", "1 as FP", "2 as ROOT")
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns and got.count() > 0


def test_operators_run(spark, clashing_docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    n = clashing_docs.count()
    assert quality.judge(clashing_docs, labels.where("quality = 1")).count() == n
    assert toxicity.judge(clashing_docs, labels).count() == n
    assert pii.find(clashing_docs).count() == n
    assert simhash.simhash_components(clashing_docs).count() == n
    assert mixing.taken(mixing.mix(clashing_docs)).count() == n
    assert pieces.encode_documents(clashing_docs, tokenizer_path("piece_bpe_32k.model"), with_ids=False).count() == n
    assert token_files.token_round_trip(clashing_docs, tokenizer_path("byte_bpe_50k.json")).count() == n
    assert recurrent.score(clashing_docs).count() == n
    kept = licenses.scan(clashing_docs.withColumn("path", clashing_docs["source"]), clashing_docs.columns)
    assert kept.count() == n and kept.columns.count("license") == 1 and "dir" in kept.columns


def test_embeddings(spark):
    rows = [(i, i % 2, [1.0, i / 100], 5, "x") for i in range(20)]
    got = embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, n int, rep string"))
    assert got.count() == 20


def test_equal_ids_with_other_texts(spark):
    """Rows of one id stand in the order of their texts' hash, whatever partitions they come from."""
    docs = spark.createDataFrame([(1, f"t{i % 40}") for i in range(60)] + [(None, f"u{i}") for i in range(30)], "doc_id long, text string")
    path = tokenizer_path("byte_bpe_50k.json")
    runs = [sorted(map(str, token_files.token_round_trip(docs.repartition(k), path, shards=4).collect())) for k in (1, 7)]
    assert runs[0] == runs[1]
