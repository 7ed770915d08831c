"""The corpus queries: key -> builder(spark, sf_dir), and DuckDB SQL where SQL
can state the result. A builder applies its operator with production
parameters to the whole table."""

from __future__ import annotations

from capsight.llm import (alignment, chunk_dedup, html_blocks, lexicon_bpe, minhash_forest, mixing, nn_descent, packing,
                          quality_knn, quality_rules, sql, suffix_dedup, toxicity_cnn, whitening)
from capsight.llm.common import table


def op1_minhash_forest(spark, sf_dir):
    return minhash_forest.near_groups(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.rule_report(table(spark, sf_dir, "documents"))


def op3_chunk_dedup(spark, sf_dir):
    return chunk_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op5_html_blocks(spark, sf_dir):
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_hierarchical_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_nn_descent(spark, sf_dir):
    return nn_descent.search(table(spark, sf_dir, "embeddings"))


def op8_toxicity_cnn(spark, sf_dir):
    return toxicity_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op10_quality_knn(spark, sf_dir):
    return quality_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_tokenizer_alignment(spark, sf_dir):
    return alignment.report(table(spark, sf_dir, "documents"))


def op12_lexicon_bpe(spark, sf_dir):
    return lexicon_bpe.report(table(spark, sf_dir, "documents"))


def op13_block_whitening(spark, sf_dir):
    return whitening.report(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_forest,
    op2_quality_rules,
    op3_chunk_dedup,
    op4_suffix_dedup,
    op5_html_blocks,
    op6_hierarchical_packing,
    op7_nn_descent,
    op8_toxicity_cnn,
    op9_source_mixing,
    op10_quality_knn,
    op11_tokenizer_alignment,
    op12_lexicon_bpe,
    op13_block_whitening,
)}

ORACLES = {
    "op1_minhash_forest": sql.NEAR_GROUPS,
    "op2_quality_rules": sql.QUALITY_RULES,
    "op9_source_mixing": sql.SOURCE_MIXING,
}
