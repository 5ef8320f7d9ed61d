"""The queries this subpackage registers and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import chunks, embedding, langid, linededup, mixing, negatives, ngramjoin, packing, quality, secrets, tokencount, tokenfiles, trie

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_token_count": tokencount.op2_token_count,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_embedding_dedup": embedding.op5_embedding_dedup,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_token_files": tokenfiles.op7_token_files,
    "op8_packing": packing.op8_packing,
    "op9_ngram_join": ngramjoin.op9_ngram_join,
    "op10_language_id": langid.op10_language_id,
    "op11_bpe_chunks": chunks.op11_bpe_chunks,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLE = secrets.ORACLE | trie.ORACLE | negatives.ORACLE
