"""The queries of the text operators, and their SQL where there is one."""

from __future__ import annotations

import importlib

MODULES = ("op1_quality", "op2_jaccard", "op3_toxicity", "op4_lines", "op5_paragraphs", "op6_media", "op7_bpe", "op8_suffix", "op9_pii", "op10_decontam")


def _modules():
    return [importlib.import_module(f"tallgrass.llm.{name}") for name in MODULES]


def queries() -> dict:
    import corpus_pipeline

    found = {"pipeline": corpus_pipeline.run}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict:
    import corpus_pipeline

    found = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    for module in _modules():
        found |= module.ORACLES
    return found
