"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from landgrid.llm.classifier import op11_quality_classifier
from landgrid.llm.langid import op9_language_id
from landgrid.llm.lexical import OP12_SQL, op12_lexical_search
from landgrid.llm.lmscore import op5_lm_scoring
from landgrid.llm.mixing import OP2_SQL, op2_mixing
from landgrid.llm.neighbours import op10_ann
from landgrid.llm.pages import op7_html_text
from landgrid.llm.pieces import op8_sentencepiece
from landgrid.llm.quality import OP6_SQL, op6_quality_rules
from landgrid.llm.runs import op13_periodic_runs
from landgrid.llm.sharding import op3_sharding
from landgrid.llm.simhash import op1_simhash_near_dedup
from landgrid.llm.tokenfile import op4_token_files

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_token_files": op4_token_files,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_text": op7_html_text,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_language_id": op9_language_id,
    "op10_ann": op10_ann,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE: dict[str, str] = {"op2_mixing": OP2_SQL, "op6_quality_rules": OP6_SQL, "op12_lexical_search": OP12_SQL}
