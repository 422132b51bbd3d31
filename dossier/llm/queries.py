"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from dossier.llm.bpe import op13_byte_bpe
from dossier.llm.chat import OP2_SQL, op2_chat_format
from dossier.llm.debruijn import op5_word_repeats
from dossier.llm.decontam import op4_template_leaks
from dossier.llm.mixing import OP3_SQL, op3_weighted_mix
from dossier.llm.phrases import OP11_SQL, op11_collocations
from dossier.llm.quality import op6_byte_quality
from dossier.llm.ranking import OP12_SQL, op12_treap_search
from dossier.llm.sharding import op9_hash_tree_shards
from dossier.llm.simhash import op1_simhash
from dossier.llm.suffixes import op7_byte_repeats
from dossier.llm.vectors import OP10_SQL, op10_pca_tiles
from dossier.llm.warc import OP8_SQL, op8_merkle_audit

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_chat_format,
        op3_weighted_mix,
        op4_template_leaks,
        op5_word_repeats,
        op6_byte_quality,
        op7_byte_repeats,
        op8_merkle_audit,
        op9_hash_tree_shards,
        op10_pca_tiles,
        op11_collocations,
        op12_treap_search,
        op13_byte_bpe,
    )
}
ORACLES = {
    "op2_chat_format": OP2_SQL,
    "op3_weighted_mix": OP3_SQL,
    "op8_merkle_audit": OP8_SQL,
    "op10_pca_tiles": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_treap_search": OP12_SQL,
}
