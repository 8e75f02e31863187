"""Label dimension and other fixed vocabularies shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from errata.functions.frames import dim

# The twelve error labels, in taxonomy order (token n = position n).
ERROR_LABELS = [
    "attribute_mismatch", "attribute_redundancy", "attribute_missing",
    "table_mismatch", "table_redundancy", "table_missing",
    "value_error", "condition_missing", "condition_error",
    "function_error", "clause_error", "modifier_error",
]
NO_ERROR = "no_error"

# Display names of the twelve labels, in the same order.
DISPLAY_NAMES = [
    "Attribute Mismatch", "Attribute Redundancy", "Attribute Missing",
    "Table Mismatch", "Table Redundancy", "Table Missing",
    "Value Mismatch", "Condition Missing", "Condition Error",
    "Function Error", "Clause Error", "Modifier Error",
]

# One-line description of each display name.
DESCRIPTIONS = {
    "Attribute Mismatch": "The attribute [A] may be wrong.",
    "Attribute Redundancy": "The attribute [A] may not be mentioned in the NLQ.",
    "Attribute Missing": "The attribute [A] may be missing.",
    "Table Mismatch": "The table [T] may be wrong.",
    "Table Redundancy": "The table [T] may be unnecessary.",
    "Table Missing": "The table [T] may be missing.",
    "Value Mismatch": "The value [V] in condition [C] may be wrong; Data Format Mismatch: The data format of value [V] in attribute [A] may be wrong.",
    "Condition Missing": "The condition [C] in NLQ may be missing; The SQL fails to include implicit conditions [C] (e.g., IS NOT NULL).",
    "Condition Error": "The condition [C] may be wrong; The condition [C] which not mentioned in NLQ.",
    "Function Error": "The usage of aggregate functions [F] (e.g., SUM, AVG) is incorrect; The usage of date/time functions [F] (e.g., JULIANDAY, strftime) is incorrect; The usage of string functions [F] (e.g., SUBSTR) is incorrect; The usage of conditional functions [F] (e.g., IIF, CASE WHEN) is incorrect.",
    "Clause Error": "The clause [K] (e.g., GROUP BY) is missing; The clause [K] (e.g., GROUP BY) is redundant.",
    "Modifier Error": "The usage of DISTINCT, DESC/ASC is either omitted or incorrectly applied.",
}

# Repair priority (lower first), subgraph need and subtree scope.
PRIORITY = {
    "Table Missing": 1, "Table Mismatch": 2, "Table Redundancy": 2, "Clause Error": 2,
    "Attribute Missing": 3, "Condition Missing": 3, "Attribute Mismatch": 4, "Condition Error": 4,
    "Attribute Redundancy": 5, "Value Mismatch": 5, "Function Error": 5, "Modifier Error": 5,
}
NEEDS_SUBGRAPH = {
    "Attribute Mismatch": True, "Attribute Redundancy": False, "Attribute Missing": True,
    "Table Mismatch": True, "Table Redundancy": False, "Table Missing": True,
    "Value Mismatch": True, "Condition Missing": True, "Condition Error": False,
    "Function Error": False, "Clause Error": False, "Modifier Error": False,
}
SCOPE = {
    "Attribute Mismatch": "expression", "Attribute Redundancy": "select_item",
    "Attribute Missing": "select_clause", "Table Mismatch": "table_ref",
    "Table Redundancy": "join_clause", "Table Missing": "from_clause",
    "Value Mismatch": "condition", "Condition Missing": "where_clause",
    "Condition Error": "condition", "Function Error": "function",
    "Clause Error": "clause", "Modifier Error": "select_clause",
}

# Synthesis weights of each label (single-type draw).
TYPE_WEIGHTS = {
    "attribute_mismatch": 3, "value_error": 3, "condition_error": 3,
    "function_error": 2, "condition_missing": 2, "clause_error": 2,
    "table_redundancy": 2, "table_mismatch": 2,
    "modifier_error": 1, "table_missing": 1, "attribute_missing": 1, "attribute_redundancy": 1,
}
# Weights of the number of injected errors.
COUNT_WEIGHTS = {1: 4.0, 2: 5.0, 3: 1.5}


def error_type_rows() -> list[tuple]:
    rows = []
    for k, (label, name) in enumerate(zip(ERROR_LABELS, DISPLAY_NAMES), start=1):
        rows.append((label, f"<error_{k}>", k, name, DESCRIPTIONS[name], PRIORITY.get(name, 99),
                     NEEDS_SUBGRAPH[name], SCOPE[name], float(TYPE_WEIGHTS[label])))
    return rows


ERROR_TYPE_SCHEMA = ("label string, token string, token_no int, display_name string, description string, "
                     "priority int, needs_subgraph boolean, scope string, weight double")


def error_type(spark: SparkSession) -> DataFrame:
    """The 12-row label dimension; fixed size, safe to broadcast."""
    return dim(spark, error_type_rows(), ERROR_TYPE_SCHEMA)
