"""Training-data pipeline over ``documents``: each stage's rows are written and read again by the next.

Toxic documents go; one document of each near-duplicate group stays; secrets are masked; junk is thinned
until clean text has its target share of the tokens, while clean documents all stay; the texts become ids,
and the ids are decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsuzuri.llm import ngram_jaccard, secret_scan, sentencepiece_bpe, soft_mixing, toxicity
from tsuzuri.llm.common import settle, table
from tsuzuri.llm.queries import tokenizer_path

TARGETS = {"clean": 0.95, "junk": 0.05}


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.first_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains are learned from all labelled documents, as toxic ones have left ``docs``."""
    rows = toxicity.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    members = settle(soft_mixing.memberships(docs, soft_mixing.fit_domains(rows)))
    rated = soft_mixing.rates(members, TARGETS, base="clean", keep="clean", most=1.0)
    out = rated.where(soft_mixing.copies(F.col("rate")) < 1).select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(docs, tokenizer_path(), decoded=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # classifiers and token ids are beyond SQL; tests/llm/test_pipeline.py compares every stage with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
