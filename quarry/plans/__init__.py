"""Named query plans of the search engine over the test tables, with DuckDB oracles."""

from quarry.plans.registry import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
