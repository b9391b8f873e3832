"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from . import (
    direct_codes,
    embeddings,
    fill_middle,
    language,
    mixing,
    order_minhash,
    packing,
    prefix_bpe,
    prefix_trie,
    secrets,
    sharding,
    simhash,
    token_counts,
)

_MODULES = (sharding, embeddings, secrets, order_minhash, token_counts, language, mixing, simhash, direct_codes, packing, fill_middle, prefix_bpe, prefix_trie)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
