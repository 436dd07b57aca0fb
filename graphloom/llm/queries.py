"""The text operators' queries and their SQL."""

from __future__ import annotations

from graphloom.llm import bpe, exact_dedup, fingerprints, language, mixing, near_dedup, pii, repeats, token_counts, toxicity

MODULES = [bpe, exact_dedup, fingerprints, language, mixing, near_dedup, pii, repeats, token_counts, toxicity]


def queries() -> dict:
    own = {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
    return own | {name: f for m in MODULES for name, (f, _) in getattr(m, "EXTRA", {}).items()}


def oracle_sql() -> dict[str, str]:
    own = {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
    return own | {name: sql for m in MODULES for name, (_, sql) in getattr(m, "EXTRA", {}).items()}
