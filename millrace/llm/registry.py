"""Queries of this subpackage over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from millrace.llm import ann, bpe, centroids, chunks, licenses, mixing, negatives, packing, pieces, quality, simhash, warc, wordpiece
from millrace.session import table


def queries() -> dict:
    return {
        "op1_learned_partition_ann": lambda s, d: ann.search(table(s, d, "embeddings")),
        "op2_license_scan": lambda s, d: licenses.scan(table(s, d, "documents")),
        "op3_substring_dedup": lambda s, d: chunks.deduplicate(table(s, d, "documents").select("doc_id", "text"), details=True),
        "op4_packed_ids": lambda s, d: packing.report(table(s, d, "documents")),
        "op5_source_mixing": lambda s, d: mixing.report(table(s, d, "documents")),
        "op6_simhash_near_dedup": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
        "op7_token_counts": lambda s, d: wordpiece.token_counts(table(s, d, "documents")),
        "op8_quality_rules": lambda s, d: quality.report(table(s, d, "documents")),
        "op9_bpe_round_trip": lambda s, d: bpe.digest_table(table(s, d, "documents")),
        "op10_warc_round_trip": lambda s, d: warc.round_trip(table(s, d, "pages")),
        "op11_centroid_clusters": lambda s, d: centroids.cluster(table(s, d, "embeddings")),
        "op12_hard_negatives": lambda s, d: negatives.mine(table(s, d, "embeddings")),
        "op13_sentencepiece_round_trip": lambda s, d: pieces.digest_table(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_source_mixing": mixing.oracle(),
        "op8_quality_rules": quality.oracle(),
        "op11_centroid_clusters": centroids.oracle(),
        "op12_hard_negatives": negatives.oracle(),
    }
