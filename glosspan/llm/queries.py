"""The registered queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, chat, decontaminate, html_text, neardup, packing, pii, quality, substrings, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_simhash_neardup": neardup.op2_simhash_neardup,
    "op3_bestfit_packing": packing.op3_bestfit_packing,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_ann_multi_index": ann.op7_ann_multi_index,
    "op8_quality": quality.op8_quality,
    "op9_pii_extraction": pii.op9_pii_extraction,
    "op10_suffix_dedup": substrings.op10_suffix_dedup,
}

ORACLES: dict[str, str] = {}
