"""The queries of this subpackage, by the names the driver knows, and their SQL where SQL can say the same."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that holds it.
MODULES = {
    "op1_near_dedup": "near_dedup",
    "op2_substring_dedup": "substring_dedup",
    "op3_quality_classifier": "quality_model",
    "op4_bpe": "bpe",
    "op5_sharding": "sharding",
    "op6_quality_rules": "quality_rules",
    "op7_preference_pairs": "preferences",
    "op8_secret_scan": "secrets",
    "op9_neighbours": "neighbours",
    "op10_packing": "packing",
}


def _lazy(module: str, name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"corrolla.llm.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _lazy(module, name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from corrolla.llm.preferences import OP7_SQL
    from corrolla.llm.quality_rules import OP6_SQL

    return {"op6_quality_rules": OP6_SQL, "op7_preference_pairs": OP7_SQL}
