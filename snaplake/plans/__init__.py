"""Parsers, analytic queries, search, guarded SQL and the scorecard."""
