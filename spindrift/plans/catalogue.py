"""Imports every module that registers queries."""

from . import q_aggregates, q_code, q_joins, q_sets, q_similarity, q_sources, q_text  # noqa: F401
