"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name to module; each module has the query and, where SQL can say it, ORACLE.
MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_chat_formatting": "chat_formatting",
    "op4_license_scans": "license_scans",
    "op8_decontamination": "decontamination",
    "op5_html_extraction": "html_extraction",
    "op6_simhash": "simhash",
    "op7_secret_scans": "secret_scans",
    "op9_url_filters": "url_filters",
    "op10_sentencepiece": "sentencepiece_codec",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
