"""Queries of the training-data operators: whole tables in, full results out."""

from __future__ import annotations

from . import embedding_join, fingerprint, html_extract, line_dedup, minhash, mixing, packing, pii, quality, toxicity
from .common import read


def op1_main_text(spark, sf_dir):
    return html_extract.extract_main_text(read(spark, sf_dir, "pages"))


def op2_embedding_links(spark, sf_dir):
    return embedding_join.link_embeddings(read(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_quality(spark, sf_dir):
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_personal_data(spark, sf_dir):
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


def op7_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


def op8_source_mix(spark, sf_dir):
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_fingerprint(spark, sf_dir):
    return fingerprint.fingerprint_documents(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_main_text, op2_embedding_links, op3_best_fit_packing, op4_line_dedup, op5_quality, op6_personal_data, op7_near_duplicates, op8_source_mix, op9_toxicity, op10_fingerprint)
}
ORACLES = {"op4_line_dedup": line_dedup.ORACLE, "op8_source_mix": mixing.ORACLE}
