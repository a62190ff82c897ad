"""The five calls of the query service over a catalog; every answer is plain data, ready for JSON."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from snaplake.plans.postings import NewsIndex
from snaplake.plans.query import DEFAULT_ROWS, run_query
from snaplake.plans.search import DEFAULT_ARTICLES, DEFAULT_DAYS, search_envelope
from snaplake.sources.catalog import Catalog
from snaplake.sources.target import SnapshotTable
from snaplake.tables import INJURY_NEWS


TEAMS_NAME = "teams"


def load_catalog(spark: SparkSession, config: str) -> Catalog:
    """A catalog from JSON text ``{"tables": {name: path}}``.

    A path with a declaration is an upsert target, under whatever name; any other is parquet.
    """
    tables = json.loads(config).get("tables") or {}

    def source(path: str) -> str | SnapshotTable:
        return SnapshotTable(spark, path) if SnapshotTable.stands_at(spark, path) else path

    return Catalog(spark, {name: source(path) for name, path in tables.items()})


class QueryService:
    """``news_index``, if given, is an index of the catalog's news table."""

    def __init__(self, catalog: Catalog, news_index: NewsIndex | None = None):
        self.catalog = catalog
        self.news_index = news_index

    def list_tables(self) -> list[dict]:
        return [row.asDict() for row in self.catalog.list_tables().collect()]

    def describe_table(self, table: str) -> dict:
        return self.catalog.describe_table(table)

    def table_history(self, table: str, limit: int = 10) -> list[dict]:
        return [row.asDict() for row in self.catalog.table_history(table, limit).collect()]

    def query(self, sql: str, max_rows: int = DEFAULT_ROWS) -> dict:
        return run_query(self.catalog, sql, max_rows)

    def search_news(
        self,
        query_text: str = "",
        player: str = "",
        team: str = "",
        days: int = DEFAULT_DAYS,
        limit: int = DEFAULT_ARTICLES,
    ) -> dict:
        """``team`` may be part of a team's name if the catalog has a teams table."""
        self.catalog.refresh()
        news = self.catalog.table(INJURY_NEWS.name)
        teams = self.catalog.table(TEAMS_NAME) if TEAMS_NAME in self.catalog.names else None
        return search_envelope(
            news, query_text=query_text, player=player, team=team, days=days, limit=limit, teams=teams, index=self.news_index
        )


def to_json(answer: object) -> str:
    return json.dumps(answer, default=str, indent=2)
