"""The corpus pipeline. Each stage takes the documents that its predecessor kept, as it wrote them.

1. toxicity: documents whose string-kernel score reaches the threshold go.
2. near duplicates: of each group of documents linked by close SimHash fingerprints, the one of the least doc_id stays.
3. personal data: every span that is found becomes <KIND>.
4. mixing: each source is cut or repeated to its target; a document's row stands as often as the mix takes it.
5. sentence pieces: ids of every text, and whether decoding gave it back.

All but the last give the columns of documents. n_chars follows the text. Nulls, empty tables, repeated rows and further
columns pass as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import mixing, pieces, pii, registry, simhash, toxicity
from gridledger.llm.shared import fresh_dir, ready, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    kinds = dict(docs.dtypes)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(kinds["n_chars"])) if "n_chars" in kinds else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, registry.tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("sentence pieces", encode_pieces),
]
#: Three of the stages train models or draw samples, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    ready(spark)
    docs, folder = table(spark, sf_dir, "documents"), fresh_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
