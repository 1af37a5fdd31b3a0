"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from bizlens.llm import negatives, phrases, urls
from bizlens.llm.decontam import op6_decontamination
from bizlens.llm.language import op8_language_id
from bizlens.llm.lines import op10_line_dedup
from bizlens.llm.neardup import op5_neardup
from bizlens.llm.ngramjoin import op11_ngram_join
from bizlens.llm.packing import op3_packing
from bizlens.llm.pages import op2_html_extraction
from bizlens.llm.quality import op9_quality_rules
from bizlens.llm.substrings import op7_suffix_dedup
from bizlens.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html_extraction": op2_html_extraction,
    "op3_packing": op3_packing,
    "op4_url_filters": urls.op4_url_filters,
    "op5_neardup": op5_neardup,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_ngram_join": op11_ngram_join,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES = {
    "op4_url_filters": urls.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
