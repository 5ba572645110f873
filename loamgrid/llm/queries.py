"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, packing, passages, prefix_tokens, quality_classifier, quality_rules, rp_forest, simhash, training_order, warc_zstd
from .common import read


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.archive_and_read(read(spark, sf_dir, "pages"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op2_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), stored=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_prefix_tokens": op2_prefix_tokens,
    "op3_simhash": op3_simhash,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_training_order": op5_training_order,
    "op6_warc_zstd": op6_warc_zstd,
    "op7_passages": op7_passages,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_rp_forest": op9_rp_forest,
    "op10_best_fit_packing": op10_best_fit_packing,
}

#: DuckDB SQL by query, where SQL can express it. Base32 takes five bits at a time out of the hex digits.
ORACLE_SQL: dict[str, str] = {
    "op6_warc_zstd": """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
first as (select html, min(page_id) as page_id, count(*) as n from p group by html),
bits as (select page_id, html, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((((strpos('0123456789abcdef', substr(h, cast(5 * i // 4 + 1 as int), 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(h || '0', cast(5 * i // 4 + 2 as int), 1)) - 1, 0)) >> cast(3 - (5 * i) % 4 as int)) & 31), 1)), '') as digest from p)
select b.page_id, octet_length(encode(b.html)) as payload_bytes, digest as payload_digest,
  case when f.page_id = b.page_id then 'response' else 'revisit' end as record_type, case when f.page_id <> b.page_id then f.page_id end as refers_to
from bits b join first f on b.html = f.html
""",
}
