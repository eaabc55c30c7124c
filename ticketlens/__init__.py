"""ticketlens — support-conversation analytics as Spark DataFrame operators.

Layout:
  functions/  Column -> Column expressions (guardrails, language, replies, labels, model output)
  operators/  DataFrame -> DataFrame operators (pairs, retrieval, sampling, metrics, judge, triage)
  sources/    readers, writers and adapters from the driver tables
  plans/      registered queries and their DuckDB oracle SQL
  streaming/  Structured Streaming triage
"""

from ticketlens.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
