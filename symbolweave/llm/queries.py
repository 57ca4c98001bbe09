"""The queries of this subpackage, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from symbolweave.llm import ann, exact_dedup, language_model, minhash, mixing, packing, quality, sharding, suffix_dedup, url_filter
from symbolweave.llm.common import table


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def op9_url_temporal_join(spark, sf_dir):
    captures = url_filter.page_captures(spark, sf_dir)
    return url_filter.filter_urls(captures, url_filter.page_entries(captures))


def queries():
    return {
        "op1_additive_quantisation": lambda s, d: ann.nearest(table(s, d, "embeddings"), F.col("vec_id") % 20 == 0),
        "op2_concat_and_cut": lambda s, d: packing.pack(documents(s, d)),
        "op3_poisson_mixing": lambda s, d: mixing.mix_sources(documents(s, d).select("doc_id", "source", "lang", "text")),
        "op4_bloom_exact_dedup": lambda s, d: exact_dedup.exact_duplicates(documents(s, d)),
        "op5_nbsvm_quality": lambda s, d: quality.classify(documents(s, d), table(s, d, "labels")),
        "op6_suffix_array_dedup": lambda s, d: suffix_dedup.repeated_spans(documents(s, d)).drop("spans"),
        "op7_backoff_lm": lambda s, d: language_model.lm_scores(documents(s, d)),
        "op8_byte_balanced_shards": lambda s, d: sharding.shard_by_bytes(documents(s, d)),
        "op9_url_temporal_join": op9_url_temporal_join,
        "op10_tensored_minhash": lambda s, d: minhash.near_duplicates(documents(s, d), k=3, percent=85),
    }


ORACLE_EXACT = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def oracle_sql():
    return {"op3_poisson_mixing": mixing.ORACLE, "op4_bloom_exact_dedup": ORACLE_EXACT, "op9_url_temporal_join": url_filter.ORACLE}
