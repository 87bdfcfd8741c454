"""Training-data operators (one module per operator) and their registered queries.

Nothing outside this folder imports it; ``__spark_entry__`` adds ``queries()`` when it is present.
"""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "decontaminate",
    "ngram_join",
    "hilbert_ann",
    "suffix_dedup",
    "kneser_ney",
    "deleted_interpolation",
    "piece_codec",
    "warc",
    "license_scan",
    "language_id",
    "toxicity",
    "filter_audit",
    "token_alignment",
)


def queries() -> dict:
    """Name and function of every query; modules are imported here, not when a worker imports one of them."""
    return {name: run for module in _MODULES for name, run in import_module(f"{__name__}.{module}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in import_module(f"{__name__}.{module}").ORACLE_SQL.items()}
