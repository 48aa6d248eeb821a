"""A corpus pipeline of the training-data operators: reject toxic texts, deduplicate, redact secrets, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.jaccard import drop_near_duplicates
from sluice.llm.mixing import mix_sources
from sluice.llm.packing import pack, tokenizer_path
from sluice.llm.secrets import redact_secrets
from sluice.llm.shared import documents, labels, materialize, written_order
from sluice.llm.toxicity import drop_toxic

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Target weights of the sources (None: mix_sources' own), and the rows of the mixed order that are packed along one curve.
WEIGHTS, STRETCH_ROWS = None, 128


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return drop_toxic(docs, labels(spark, sf_dir).select("doc_id", "toxic")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least doc_id stays."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are written in the order in which their sources' blocks are due."""
    return mix_sources(docs, WEIGHTS).orderBy("mix_position").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents are packed into, a stretch of the mixed order after the other."""
    docs = written_order(docs, "mixed", "place").withColumn("stretch", F.floor(F.col("place") / STRETCH_ROWS))
    return pack(docs, tokenizer_path(), stretch="stretch")


STAGES = [
    ("toxicity", toxicity),
    ("n-gram jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixing),
    ("packing", packing),
]

#: Classifiers, similarity groups and token ids aren't expressible in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
