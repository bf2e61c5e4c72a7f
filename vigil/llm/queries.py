"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from vigil.llm.bpe_tree import op1_bpe_tree
from vigil.llm.chunk_store import op4_chunk_store
from vigil.llm.cosine_tiles import op2_cosine_tiles
from vigil.llm.cross_align import op11_postings
from vigil.llm.differencing import op9_differencing
from vigil.llm.edit_match import op5_edit_match
from vigil.llm.hidden_markov import op8_hidden_markov
from vigil.llm.inner_blocks import op13_inner_blocks, op13_sql
from vigil.llm.lang_mixture import op3_lang_mixture
from vigil.llm.near_dup import op7_bayes_minhash
from vigil.llm.resample import op12_byte_automaton, op12_sql
from vigil.llm.toxic_crf import op10_toxic_crf
from vigil.llm.url_cascade import op6_sql, op6_url_cascade

QUERIES = {
    "op1_bpe_tree": op1_bpe_tree,
    "op2_cosine_tiles": op2_cosine_tiles,
    "op3_lang_mixture": op3_lang_mixture,
    "op4_chunk_store": op4_chunk_store,
    "op5_edit_match": op5_edit_match,
    "op6_url_cascade": op6_url_cascade,
    "op7_bayes_minhash": op7_bayes_minhash,
    "op8_hidden_markov": op8_hidden_markov,
    "op9_differencing": op9_differencing,
    "op10_toxic_crf": op10_toxic_crf,
    "op11_postings": op11_postings,
    "op12_byte_automaton": op12_byte_automaton,
    "op13_inner_blocks": op13_inner_blocks,
}

SQL = {"op6_url_cascade": op6_sql(), "op12_byte_automaton": op12_sql(), "op13_inner_blocks": op13_sql()}
