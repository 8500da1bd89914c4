"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from plumbline.llm import audit, backtrack, langid, mixing, packing, quality, repair, sharding, simhash, suffix, tiff, tokencount, whitening


def op5_simhash_near_dedup(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash.near_duplicates(docs).drop("n_copies")


QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mix_sources, sharding.op2_compacted_shards, tiff.op3_tiff_media, suffix.op4_suffix_dedup, op5_simhash_near_dedup,
        packing.op6_best_fit_packing, tokencount.op7_token_counts, langid.op8_language_id, quality.op9_quality_rules, repair.op10_token_files, whitening.op11_whitened_embeddings,
        audit.op12_filter_interactions, backtrack.op13_byte_bpe,
    )
}

ORACLE_SQL = {"op2_compacted_shards": sharding.OP2_SQL, "op12_filter_interactions": audit.OP12_SQL}
