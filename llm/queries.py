"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import conversations, langid, lines, mixing, phrases, quality, rabitq, sentencepiece, sharding, simhash, substring, topk, toxicity


def queries():
    import corpus_pipeline  # it imports this package in its turn

    return {
        "op1_langid": langid.op1_langid,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_simhash": simhash.op4_simhash,
        "op5_ann": rabitq.op5_ann,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_sentencepiece": sentencepiece.op7_sentencepiece,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_topk": topk.op9_topk,
        "op10_sharding": sharding.op10_sharding,
        "op11_quality": quality.op11_quality,
        "op12_conversations": conversations.op12_conversations,
        "op13_phrases": phrases.op13_phrases,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_substring_dedup": substring.OP2_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op5_ann": rabitq.OP5_SQL,
        "op6_line_dedup": lines.OP6_SQL,
        "op9_topk": topk.OP9_SQL,
        "op10_sharding": sharding.OP10_SQL,
        "op11_quality": quality.OP11_SQL,
        "op12_conversations": conversations.OP12_SQL,
        "op13_phrases": phrases.OP13_SQL,
    }
