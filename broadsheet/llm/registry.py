"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import ann, bpe, chat, fingerprint, linededup, merkle, mixing, neardup, ngram, pii, quality, spelling, substrings

QUERIES = {"op1_mix_sources": mixing.query, "op2_ngram_join": ngram.query, "op3_pii": pii.query, "op4_line_dedup": linededup.query, "op5_substring_dedup": substrings.query, "op6_quality": quality.query, "op7_bpe": bpe.query, "op8_ann": ann.query, "op9_chat_format": chat.query, "op10_embedding_neardup": neardup.query, "op11_spelling": spelling.query, "op12_merkle": merkle.query, "op13_fingerprints": fingerprint.query}
ORACLES = {"op1_mix_sources": mixing.ORACLE, "op2_ngram_join": ngram.ORACLE, "op4_line_dedup": linededup.ORACLE, "op8_ann": ann.ORACLE, "op9_chat_format": chat.ORACLE, "op10_embedding_neardup": neardup.ORACLE, "op11_spelling": spelling.ORACLE, "op12_merkle": merkle.ORACLE}
