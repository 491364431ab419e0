import pytest

import corpus_pipeline as cp
from gridledger.llm import mixing, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near duplicates", "personal data", "mixing", "sentence pieces"]


def test_each_stage_takes_effect(spark, few_docs, tmp_path):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs, wrote = few_docs, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        wrote.append(docs := spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(w.dtypes == few_docs.dtypes for w in wrote[:4])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(wrote[0]) == sorted(r.doc_id for r in toxicity.judge(few_docs, labels).where("predicted = 0").collect())
    assert ids(wrote[1]) == sorted({r.component_id for r in simhash.simhash_components(wrote[0]).collect()})
    assert ids(wrote[2]) == ids(wrote[1])
    assert wrote[2].where("text rlike '@[a-z0-9]+[.]example[.]com'").count() == 0
    taken = {r.doc_id: r.taken for r in mixing.taken(mixing.mix(wrote[2])).collect()}
    mixed = {r.doc_id: r.n for r in wrote[3].selectExpr("doc_id", "size(filter(split(text, '[ \\t-\\r]+'), x -> x <> '')) as w").groupBy("doc_id").agg({"w": "sum"}).withColumnRenamed("sum(w)", "n").collect()}
    assert mixed == {i: n for i, n in taken.items() if n}
    assert wrote[4].where("not round_trip").count() == 0 and ids(wrote[4]) == ids(wrote[3])


def test_nulls_and_extra_columns_pass(spark, edge_docs):
    docs = edge_docs
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == edge_docs.columns
        docs = spark.createDataFrame(docs.collect(), edge_docs.schema)
    assert cp.STAGES[4][1](spark, docs, FOLDER).count() == docs.count() > 0


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_empty(spark, no_docs, stage):
    assert stage(spark, no_docs, FOLDER).count() == 0
