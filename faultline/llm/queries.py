"""Thin queries over the operators: each applies one to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.texts(_table(spark, sf_dir, "documents"), "doc_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.texts(_table(spark, sf_dir, "pages"), "page_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048, with_ids=False).drop("ids")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_pages(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify

    found = identify(_documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import removal_digests

    return removal_digests(_documents(spark, sf_dir), window=20)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_digests

    return encode_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprint_hex, near_duplicates

    found = near_duplicates(_documents(spark, sf_dir), words=3, seed=42, radius=3)
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .unigram import learn, token_counts

    docs, path = _documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(docs, path, pieces=learn(_table(spark, sf_dir, "documents"), path))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_pages(spark, sf_dir), least=0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"), family=100, most=6)


#: Fixed values of op12: host, path and verdict of its rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge, rule_table

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, URL_RULES)).drop("url")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    return align(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)


def queries() -> dict[str, Query]:
    found = [f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return dict(import_module(f"{__package__}.sql").SQL)
