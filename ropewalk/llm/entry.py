"""The queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, chat, ctw, exact_dedup, graph_search, langid, mixing, quality, repeats, simhash

_MODULES = (exact_dedup, mixing, chat, simhash, langid, quality, graph_search, ctw, bpe, repeats)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
