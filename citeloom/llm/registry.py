"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from citeloom.llm.chat import OP6_SQL, op6_chat_prefix_trees
from citeloom.llm.decontamination import OP3_SQL, op3_decontamination
from citeloom.llm.divergence import OP11_SQL, op11_source_divergence
from citeloom.llm.hostrules import OP9_SQL, op9_host_rules
from citeloom.llm.langid import op1_language_id
from citeloom.llm.mixing import op2_source_mixing
from citeloom.llm.resampling import op4_importance_resampling
from citeloom.llm.secrets import op7_secret_scan
from citeloom.llm.sharding import op5_hilbert_shards
from citeloom.llm.simhash import op8_simhash_components
from citeloom.llm.tokenfiles import op13_token_files
from citeloom.llm.vectorcodes import OP12_SQL, op12_vector_codes
from citeloom.llm.wrappers import op10_wrapper_text

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_source_mixing": op2_source_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_chat_prefix_trees": op6_chat_prefix_trees,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash_components": op8_simhash_components,
    "op9_host_rules": op9_host_rules,
    "op10_wrapper_text": op10_wrapper_text,
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_files": op13_token_files,
}
ORACLES: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op6_chat_prefix_trees": OP6_SQL,
    "op9_host_rules": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
}
