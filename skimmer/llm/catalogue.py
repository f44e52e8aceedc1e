"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skimmer.llm.audit import OP13_SQL, op13_filter_audit
from skimmer.llm.jaccard import op6_jaccard_forest
from skimmer.llm.licenses import op2_license_scan
from skimmer.llm.merkle import op3_merkle_tree
from skimmer.llm.mixing import op8_budget_mixing
from skimmer.llm.neighbours import op7_nn_descent
from skimmer.llm.packing import op10_pattern_packing
from skimmer.llm.preferences import OP4_SQL, op4_preference_chat
from skimmer.llm.rendering import op1_html_text
from skimmer.llm.repair import op5_repair_shards
from skimmer.llm.runs import op12_periodic_runs
from skimmer.llm.sql import OP3_SQL, OP6_SQL
from skimmer.llm.tokens import op11_token_counts
from skimmer.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_license_scan, op3_merkle_tree, op4_preference_chat, op5_repair_shards, op6_jaccard_forest, op7_nn_descent, op8_budget_mixing, op9_toxicity, op10_pattern_packing, op11_token_counts, op12_periodic_runs, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_merkle_tree": OP3_SQL, "op4_preference_chat": OP4_SQL, "op6_jaccard_forest": OP6_SQL, "op13_filter_audit": OP13_SQL}
