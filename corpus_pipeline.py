"""The corpus pipeline: language ID, near-dedup, substring dedup, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a table, which is written and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common, jaccard, langid, packing, substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of some language: those without any letter go, null texts among them.

    No score is asked for, as scores fall with the number of languages. Null ids and columns and repeated rows stay rows of
    their own; other columns go; an empty table stays one.
    """
    found = langid.identify(common.texts(docs.select(COLUMNS), "doc_id"))
    return found.where(F.col("lang_pred") != langid.UND).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group that pairs of Jaccard similarity 0.8 or more, over runs of five words, link."""
    return jaccard.keep_one(common.texts(docs.select(COLUMNS), "doc_id"), words=5, least=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that begin earlier in the corpus; n_chars follows."""
    kept = substrings.without_repeats(common.texts(docs.select(COLUMNS), "doc_id"), window=20)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, each id of each row in one of them.

    A null text is empty and has the end's id alone; repeated rows and null ids are packed each for itself; columns but
    doc_id and text play no part; an empty table gives no pieces.
    """
    return packing.pack_documents(common.texts(docs, "doc_id"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048, with_ids=False).drop("ids")


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", pack)]

#: A trained network, fingerprints by XXH64 and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = common.written(docs, name.replace(" ", "-").lower())
    return docs
