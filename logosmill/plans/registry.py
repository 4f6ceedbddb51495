"""All registered queries of the core library."""

from __future__ import annotations

from logosmill.plans import (
    alignment_queries, annotation_queries, argumentation_queries, dialogue_queries, linking_queries, outcome_queries, scoring_queries, structure_queries, text_queries, tree_queries,
)

MODULES = [structure_queries, argumentation_queries, text_queries, scoring_queries, dialogue_queries, tree_queries, linking_queries, annotation_queries, alignment_queries, outcome_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
