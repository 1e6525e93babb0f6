"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, divergence, language, lexicon, line_dedup, ngram_join, packing, periodic, quality, rules, secret_scan, topk, url_filter


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op1_line_dedup_words": line_dedup.op1_line_dedup_words,
        "op2_secret_scan": secret_scan.op2_secret_scan,
        "op3_quality_crf": quality.op3_quality_crf,
        "op4_fst_bpe": lexicon.op4_fst_bpe,
        "op5_quality_rules": rules.op5_quality_rules,
        "op6_language_id": language.op6_language_id,
        "op7_preference_chat": chat.op7_preference_chat,
        "op8_packing": packing.op8_packing,
        "op9_topk_nra": topk.op9_topk_nra,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "op11_kmr_runs": periodic.op11_kmr_runs,
        "op12_bloom_urls": url_filter.op12_bloom_urls,
        "op13_term_tiles": divergence.op13_term_tiles,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.OP1_SQL, "op7_preference_chat": chat.OP7_SQL, "op9_topk_nra": topk.OP9_SQL, "op10_ngram_join": ngram_join.OP10_SQL, "op12_bloom_urls": url_filter.OP12_SQL, "op13_term_tiles": divergence.OP13_SQL}
