"""All queries by name, with their DuckDB texts."""

from . import catalog, kernels, lattice, models, scenarios, searches, sequence, trees, words  # noqa: F401  (they enter their queries)
from .book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
