"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, conversation_trie, embedding_dedup, fill_middle, fixity, language_id, license_scan, mixing, ngram_join, quality_rules, sharding, substring_dedup, token_files

MODULES = (quality_rules, substring_dedup, mixing, license_scan, language_id, bpe, ngram_join, sharding, embedding_dedup, fixity, fill_middle, conversation_trie, token_files)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
