"""Queries of the training-data operators and the SQL that some of them are held against."""

from __future__ import annotations

from shelfmark.llm import audit, brown, digest, lines, mixing, packing, pieces, qda, repeats, simhash, turns, urls, warc


def queries() -> dict:
    return {
        "op1_repeated_bytes": repeats.op1_repeated_bytes,
        "op2_pfair_mix": mixing.op2_pfair_mix,
        "op3_brown_class_bigrams": brown.op3_brown_class_bigrams,
        "op4_rare_window_digest": digest.op4_rare_window_digest,
        "op5_revisit_resolution": warc.op5_revisit_resolution,
        "op6_line_frequency": lines.op6_line_frequency,
        "op7_quadratic_quality": qda.op7_quadratic_quality,
        "op8_sentencepiece_suffix_array": pieces.op8_sentencepiece_suffix_array,
        "op9_bloom_cascade": urls.op9_bloom_cascade,
        "op10_simhash_gray_index": simhash.op10_simhash_gray_index,
        "op11_bin_slack_packing": packing.op11_bin_slack_packing,
        "op12_prefix_trie": turns.op12_prefix_trie,
        "op13_filter_interactions": audit.op13_filter_interactions,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_pfair_mix": mixing.OP2_SQL, "op5_revisit_resolution": warc.OP5_SQL, "op6_line_frequency": lines.OP6_SQL, "op9_bloom_cascade": urls.OP9_SQL, "op12_prefix_trie": turns.OP12_SQL, "op13_filter_interactions": audit.OP13_SQL}
