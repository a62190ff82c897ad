"""Landing records to table rows: map-only plans that run alike in batch and on a stream."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame

from snaplake.spec import Table
from snaplake.tables import TABLES


def parse(table: Table, landing: DataFrame) -> DataFrame:
    """Rows of ``table`` from records read with ``table.raw`` plus the two file columns."""
    return table.rows(landing).select(*table.row_columns())


PARSERS = {name: partial(parse, table) for name, table in TABLES.items()}
