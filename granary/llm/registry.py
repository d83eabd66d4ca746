"""Queries of this package by name."""

from __future__ import annotations

from granary.llm import q_decontaminate, q_langid, q_mainpath, q_minhash, q_pieces, q_pii, q_pitmanyor, q_secrets, q_toxicity, q_vectors

MODULES = (q_minhash, q_toxicity, q_langid, q_mainpath, q_pitmanyor, q_secrets, q_decontaminate, q_vectors, q_pieces, q_pii)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
