"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from . import codes, decontaminate, html, jaccard, langid, lm, ogg, packing, quality, sharding, tokens, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_token_ids": tokens.op2_token_ids,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_html_text": html.op4_html_text,
    "op5_lm_scores": lm.op5_lm_scores,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_ogg_media": ogg.op7_ogg_media,
    "op8_language_id": langid.op8_language_id,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality": quality.op10_quality,
    "op11_whitening": whitening.op11_whitening,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_sharding": sharding.op13_sharding,
}

ORACLES = {"op1_warc": warc.SQL, "op12_vector_codes": codes.SQL, "op13_sharding": sharding.SQL}
