"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, chat, decontamination, mixing, ngram_join, pii, quality, sharding, toxicity, urls

MODULES = (decontamination, chat, urls, pii, ann, toxicity, mixing, ngram_join, sharding, quality)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
