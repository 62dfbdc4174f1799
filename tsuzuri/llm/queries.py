"""The registered queries of this subpackage: one thin query for each operator, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tsuzuri.llm import ann_forest, compression_quality, html_template, merkle, ngram_jaccard, secret_scan, sentencepiece_bpe, soft_mixing, toxicity, warc
from tsuzuri.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_jaccard.similarity_join(table(spark, sf_dir, "documents"))
    return members


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, digests=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = soft_mixing.fit_domains(toxicity.training_rows(docs, labels))
    return soft_mixing.report(docs, model, {"clean": 0.9, "junk": 0.08, "toxic": 0.02})


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_toxicity": op2_toxicity,
        "op3_html": op3_html,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality": op5_quality,
        "op6_secrets": op6_secrets,
        "op7_ann": op7_ann,
        "op8_warc": op8_warc,
        "op9_merkle": op9_merkle,
        "op10_mixing": op10_mixing,
    }


#: Base 32 of a SHA-1 digest: five hexadecimal digits at a time are four letters.
WARC_SQL = """
with body as (select page_id, url, coalesce(html, '') as b from pages),
digest as (select page_id, url, strlen(b) as n, sha1(b) as h from body),
first as (select *, min(page_id) over (partition by h) as f from digest)
select page_id, cast(n as bigint) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(h, cast(i // 4 * 5 + 1 as int), 5) as int) >> cast(15 - i % 4 * 5 as int)) & 31 as int) + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id = f then 'response' else 'revisit' end as record_type,
  case when page_id <> f then f end as refers_to, url
from first
"""


def oracle_sql() -> dict[str, str]:
    """The other operators are beyond SQL, or too slow in it on whole tables; tests compare them with plain versions."""
    return {"op8_warc": WARC_SQL}
