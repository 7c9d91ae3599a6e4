"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import centroids, chat, divergence, html_text, matroska, packing, quality, sentencepiece_codec, sharding, simhash, subspace, toxicity, urls
from tidemark.llm._common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": lambda s, d: urls.judged_pages(table(s, d, "pages"), table(s, d, "labels")),
    "op2_toxicity": lambda s, d: toxicity.judged(table(s, d, "documents"), table(s, d, "labels")),
    "op3_html_text": lambda s, d: html_text.extracted(table(s, d, "pages")),
    "op4_simhash": lambda s, d: simhash.digest(table(s, d, "documents")),
    "op5_length_buckets": lambda s, d: packing.packed(table(s, d, "documents")),
    "op6_virtual_slots": lambda s, d: sharding.sharded(table(s, d, "documents")),
    "op7_matroska": lambda s, d: matroska.media_digest(table(s, d, "documents")),
    "op8_quality_ledger": lambda s, d: quality.judged(table(s, d, "documents")),
    "op9_chat_collapse": lambda s, d: chat.collapse_and_render(table(s, d, "conversations")),
    "op10_sentencepiece": lambda s, d: sentencepiece_codec.tokens(table(s, d, "documents")),
    "op11_source_divergence": lambda s, d: divergence.audited(table(s, d, "documents")),
    "op12_embedding_near_dedup": lambda s, d: subspace.near_vectors(table(s, d, "embeddings")),
    "op13_centroid_clusters": lambda s, d: centroids.clustered(table(s, d, "embeddings")),
}

ORACLES = {"op1_url_reputation": urls.ORACLE, "op8_quality_ledger": quality.ORACLE, "op9_chat_collapse": chat.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_embedding_near_dedup": subspace.ORACLE, "op13_centroid_clusters": centroids.ORACLE}
