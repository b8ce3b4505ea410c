"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowaccord.llm.common import free_name, remainder, settled
from rowaccord.llm.decontaminate import remove_spans
from rowaccord.llm.jaccard import jaccard_components
from rowaccord.llm.quality import fit_quality, keep_good
from rowaccord.llm.queries import LEAST_QUALITY, packed, table
from rowaccord.llm.secret_scan import fit_from_documents, redacted

#: A document whose words are benchmark passages to this share goes; from others the passages are cut out.
LEAK_SHARE = 0.5


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from those labelled rows that it is given.

    Null texts are scored like empty ones, repeated rows alike; without labels every score is 0.5 and all stay.
    """
    labels = table(spark, sf_dir, "labels")
    return keep_good(docs, fit_quality(docs, labels, remainder(labels["doc_id"], 5) != 0), LEAST_QUALITY)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; repeated rows are one document.

    Documents without words are no copies of each other and stay, null texts and null ids too. Columns of any name stay.
    """
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    groups = jaccard_components(keyed, id_col=key)
    kept = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).select(_text_key(key)).distinct()
    keyed = keyed.withColumn(key, _text_key(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def _text_key(key: str):
    """A key that joins even where the id is null."""
    id_text = F.coalesce(F.col(f"{key}.id").cast("string"), F.lit("null"))
    return F.concat_ws("/", id_text, F.col(f"{key}.h").cast("string")).alias(key)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null texts stay null, and without benchmark items all stay."""
    return _with_lengths(remove_spans(docs, table(spark, sf_dir, "benchmark"), LEAK_SHARE))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; null texts stay null, an empty table stays empty."""
    return _with_lengths(redacted(docs, fit_from_documents(docs, remainder(docs["doc_id"], 5) != 0)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a null text is an empty document."""
    return packed(docs)


def _with_lengths(docs: DataFrame) -> DataFrame:
    """Texts may have changed: their lengths follow."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_of_benchmarks),
    ("secret scans", without_secrets),
    ("best-fit packing", sequences),
]

#: The stages score, group and pack by models and searches that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
