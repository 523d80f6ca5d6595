"""Names of the corpus queries, for the entry module."""

from wavegrid.llm import queries_text  # noqa: F401  (registers its queries)
from wavegrid.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
