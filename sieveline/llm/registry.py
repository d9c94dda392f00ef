"""Queries of the training-data operators, each over the whole of its table with production parameters."""

from __future__ import annotations

import corpus_pipeline

from . import avi, decontam, mixing, pii, quality, resharding, simhash, styletree, toxicity, trainorder
from .common import scratch_path, spread, table


def rows(spark, sf_dir, name):
    return spread(table(spark, sf_dir, name))


def op1_quality_classifier(spark, sf_dir):
    """The documents that the classifier keeps: (doc_id, quality_score)."""
    docs = rows(spark, sf_dir, "documents")
    kept = quality.quality_filter(docs.select("doc_id", "text"), docs, table(spark, sf_dir, "labels"), score_col="quality_score")
    return kept.select("doc_id", "quality_score")


def op2_decontamination(spark, sf_dir):
    """(doc_id, item_id, distance, item_chars) of the documents that hold a benchmark item."""
    return decontam.contamination(rows(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark, sf_dir):
    """Nested mixtures of documents by source, weights tokens^0.7: (doc_id, source, tokens, tier)."""
    return mixing.mix(rows(spark, sf_dir, "documents"))


def op4_avi_clips(spark, sf_dir):
    """Shots of a media column: (vec_id, clip, start_frame, n_frames, start_s, end_s, width, height, error). The tables
    hold no media; every row of embeddings is rendered as a film first."""
    media = rows(spark, sf_dir, "embeddings").select("vec_id", avi.rendered("vec_id", "embedding").alias("media"))
    return avi.clips(media, "vec_id", "media")


def op5_training_order(spark, sf_dir):
    """All documents as 1,024-token sequences in training order: (slot, shard, byte_offset, seq, doc_ids, tokens). The
    shard files are written to the shared folder."""
    return trainorder.write_shards(trainorder.training_order(rows(spark, sf_dir, "documents")), scratch_path(spark, "shards"), through=True)


def op6_site_style_tree(spark, sf_dir):
    """Every page's text without the template of its host: (page_id, url, text, nodes, removed)."""
    return styletree.extract_pages(rows(spark, sf_dir, "pages"))


def op7_resharding(spark, sf_dir):
    """documents with the shard (by source) that holds them and the one of 16 that they go to, from the new shards'
    files in the shared folder."""
    return resharding.reshard_files(rows(spark, sf_dir, "documents"), scratch_path(spark, "reshard"))


def op8_simhash_near_dedup(spark, sf_dir):
    """Pairs (doc_id, kept_doc_id) of documents that another of their near-duplicate group stands for."""
    return simhash.near_duplicates(rows(spark, sf_dir, "documents"))


def op9_pii_pseudonyms(spark, sf_dir):
    """Every document with its personal data replaced: (doc_id, text, n_pii, kinds)."""
    return pii.pseudonymise(rows(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark, sf_dir):
    """The toxic documents: (doc_id, score, vote, evidence)."""
    docs, labels = rows(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, toxicity.train(docs, labels)).where(f"score >= {toxicity.THRESHOLD}")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_avi_clips": op4_avi_clips,
    "op5_training_order": op5_training_order,
    "op6_site_style_tree": op6_site_style_tree,
    "op7_resharding": op7_resharding,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_toxicity": op10_toxicity,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op3_mixing": mixing.ORACLE,
    "op4_avi_clips": avi.ORACLE,
    "op7_resharding": resharding.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
