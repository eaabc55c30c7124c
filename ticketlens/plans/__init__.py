"""Registered queries. Importing this package registers every query module."""

from ticketlens.plans import (q_guardrails, q_language, q_metrics, q_pairs, q_retrieval, q_sampling, q_extras, q_eval, q_sources, q_judge,
                              q_model_output, q_kb)  # noqa: F401
from ticketlens.plans.registry import OPERATORS, ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "OPERATORS"]
