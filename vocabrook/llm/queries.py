"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe_trie, conversation_trie, decontaminate, html_extract, lang_mixture, license_scan, merkle_manifest, ngram_join, source_mix, suffix_dedup, toxicity, vp_trees, warc_table


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark, sf_dir):
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_toxicity(spark, sf_dir):
    return toxicity.predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lang_mixture(spark, sf_dir):
    return lang_mixture.predict_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_license_scan(spark, sf_dir):
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op5_warc_table(spark, sf_dir):
    records = warc_table.read_archives(warc_table.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_vp_trees(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vp_trees.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op8_source_mix(spark, sf_dir):
    return source_mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=4, threshold=85)


def op11_merkle_manifest(spark, sf_dir):
    return merkle_manifest.digest(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark, sf_dir):
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op13_bpe_trie(spark, sf_dir):
    return bpe_trie.digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {"op4_license_scan": license_scan.oracle(), "op5_warc_table": warc_table.ORACLE, "op6_vp_trees": vp_trees.ORACLE, "op8_source_mix": source_mix.ORACLE, "op10_ngram_join": ngram_join.ORACLE, "op11_merkle_manifest": merkle_manifest.ORACLE, "op12_conversation_trie": conversation_trie.ORACLE}
