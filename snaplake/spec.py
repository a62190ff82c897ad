"""What a table is: where its snapshots land, how a row is found in them, and each column's recipe.

One declaration gives the read schema, the parser, the DDL and the merge keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, COUNT, RATE, FLAG = StringType(), LongType(), DoubleType(), BooleanType()
INSTANT, DAY, TEXTS = TimestampType(), DateType(), ArrayType(StringType())


@dataclass(frozen=True)
class Field:
    """A table column: ``recipe`` is a path, or a function and its arguments."""

    name: str
    type: DataType
    recipe: tuple
    note: str = ""
    key: bool = False

    def column(self) -> Column:
        return _cook(self.recipe).cast(self.type).alias(self.name)

    def struct_field(self) -> StructField:
        metadata = {"comment": self.note} if self.note else {}
        return StructField(self.name, self.type, not self.key, metadata)


@dataclass(frozen=True)
class Step:
    """One step from a landing record to a row: named values, or one row per array element."""

    values: tuple[tuple[str, tuple], ...]
    each: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        made = ((alias, _cook(recipe)) for alias, recipe in self.values)
        return df.select("*", *((F.explode(v) if self.each else v).alias(a) for a, v in made))


def _cook(recipe: tuple) -> Column:
    first, *args = recipe
    return first(*args) if callable(first) else F.col(first)


def col(name: str, type: DataType, *recipe, note: str = "") -> Field:
    return Field(name, type, recipe or (name,), note)


def key(name: str, type: DataType, *recipe, note: str = "") -> Field:
    return Field(name, type, recipe or (name,), note, key=True)


def let(**recipes: tuple) -> Step:
    return Step(tuple(recipes.items()))


def each(alias: str, *recipe) -> Step:
    return Step(((alias, recipe),), each=True)


# Role and name of the audit columns, in table order.
AUDIT = (("file", "_source_file"), ("snapshot", "_snapshot_at"), ("ingested", "_ingested_at"))

_AUDIT_ROLES = {
    "file": (TEXT, "landing file this version came from"),
    "snapshot": (INSTANT, "age of that file; the newer snapshot wins"),
    "ingested": (INSTANT, "when the row was parsed"),
}


@dataclass(frozen=True)
class Table:
    """A keyed table fed from landing files under ``prefix`` that are read with schema ``raw``."""

    name: str
    prefix: str
    raw: str
    fields: tuple[Field, ...]
    steps: tuple[Step, ...] = ()
    note: str = ""
    audit: tuple[tuple[str, str], ...] = AUDIT
    database: str = "nfl"
    partitions: tuple[str, ...] = ()  # columns whose values, with the keys, say where a row is stored

    @property
    def full_name(self) -> str:
        return f"{self.database}.{self.name}"

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.key)

    @property
    def file_column(self) -> str:
        return dict(self.audit)["file"]

    @property
    def snapshot_column(self) -> str:
        return dict(self.audit)["snapshot"]

    @property
    def ingested_column(self) -> str:
        return dict(self.audit)["ingested"]

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def schema(self) -> StructType:
        audit = [
            StructField(name, _AUDIT_ROLES[role][0], True, {"comment": _AUDIT_ROLES[role][1]})
            for role, name in self.audit
        ]
        return StructType([f.struct_field() for f in self.fields] + audit)

    def row_columns(self) -> list[Column]:
        """All columns in table order, to be selected once the steps have been applied."""
        audit = {
            "file": F.col("_source_file"),
            "snapshot": F.col("_snapshot_at"),
            "ingested": F.current_timestamp(),
        }
        return [f.column() for f in self.fields] + [
            audit[role].cast(_AUDIT_ROLES[role][0]).alias(name) for role, name in self.audit
        ]

    def rows(self, df: DataFrame) -> DataFrame:
        """The landing records taken apart into one row per grain."""
        for step in self.steps:
            df = step.apply(df)
        return df
