"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module that holds it; a query is imported when it is first called
MODULES = {
    "op3_quality_rules": "quality_rules",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_secret_scan": "secret_scan",
    "op6_mix_sources": "mixing",
    "op7_decontaminate": "decontaminate",
    "op10_token_ids": "token_store",
    "op1_lm_score": "lm_score",
    "op2_near_duplicates": "minhash",
    "op8_toxicity": "toxicity",
    "op9_quality_classifier": "neighbours",
}


def _query(name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{MODULES[name]}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        if sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None):
            found[name] = sql
    return found
