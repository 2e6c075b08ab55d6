"""Predicates, families, inverses and legal transitions as data.

Cells marked ``ours`` are choices of this library; the others follow the
published requirements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Predicate, family, inverse, symmetric, most subjects at once, source.
PREDICATES = (
    ("parent_of", "kinship", "child_of", False, 2, "given"),
    ("child_of", "kinship", "parent_of", False, None, "given"),
    ("sibling_of", "kinship", None, True, None, "given"),
    ("grandparent_of", "kinship", None, False, 4, "given"),
    ("in_law_of", "kinship", None, True, None, "ours"),
    ("guardian_of", "kinship", "ward_of", False, None, "given"),
    ("ward_of", "kinship", "guardian_of", False, None, "ours"),
    ("adopted_by", "kinship", None, False, None, "given"),
    ("married_to", "romantic", None, True, None, "given"),
    ("engaged_to", "romantic", None, True, None, "ours"),
    ("lover_of", "romantic", None, True, None, "ours"),
    ("former_partner_of", "romantic", None, True, None, "ours"),
    ("unrequited_love_for", "romantic", None, False, None, "given"),
    ("friend_of", "social", None, True, None, "ours"),
    ("acquaintance_of", "social", None, True, None, "ours"),
    ("neighbour_of", "social", None, True, None, "ours"),
    ("colleague_of", "social", None, True, None, "ours"),
    ("employer_of", "social", None, False, None, "given"),
    ("mentor_of", "social", None, False, None, "given"),
    ("customer_of", "social", None, False, None, "given"),
    ("rival_of", "adversarial", None, True, None, "ours"),
    ("enemy_of", "adversarial", None, True, None, "ours"),
    ("betrayed", "adversarial", None, False, None, "given"),
    ("deceives", "adversarial", None, False, None, "given"),
    ("co_occurs_with", "structural", None, True, None, "given"),
)
TRANSITIONS = (("engaged_to", "married_to"), ("friend_of", "enemy_of"), ("rival_of", "friend_of"), ("enemy_of", "rival_of"), ("married_to", "former_partner_of"), ("lover_of", "married_to"), ("acquaintance_of", "friend_of"))
#: Of an inverse pair, the predicate that edges are stored under.
STORED = ("parent_of", "guardian_of")


def predicates(spark: SparkSession) -> DataFrame:
    """One row a predicate; some dozens of rows, safe to broadcast."""
    return spark.createDataFrame(list(PREDICATES), "predicate string, family string, inverse string, symmetric boolean, max_subjects int, source string")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSITIONS), "from_predicate string, to_predicate string")


def family_of(predicate: str) -> str | None:
    return next((p[1] for p in PREDICATES if p[0] == predicate), None)


def inverse_of(predicate: str) -> str | None:
    return next((p[0] if p[3] else p[2] for p in PREDICATES if p[0] == predicate), None)


def is_symmetric(predicate: str) -> bool:
    return any(p[0] == predicate and p[3] for p in PREDICATES)


def is_legal_transition(a: str, b: str) -> bool:
    return (a, b) in TRANSITIONS


def prompt_fragment() -> str:
    """The predicates by family, for a prompt's stable prefix."""
    families = dict.fromkeys(p[1] for p in PREDICATES if p[1] != "structural")
    return "\n".join(f"{f}: {', '.join(p[0] for p in PREDICATES if p[1] == f)}" for f in families)
