"""The registered queries over the given tables and their plain-SQL twins."""

from snaplake.workload import gold, jobs, nested, parsing, scoring, serving, upserts  # noqa: F401
from snaplake.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
