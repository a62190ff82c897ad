"""Read-only SQL over catalog tables, with a row cap.

Spark's own parser turns the text into a plan; the guard walks that plan before anything is
analyzed or run. Allowed is what is listed here, over the whole tree, sub-queries included.
"""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame

from snaplake.sources.catalog import NAME_PATTERN, Catalog, profile

MAX_ROWS = 1000  # fixed values: hard cap and default cap of a result
DEFAULT_ROWS = 200

ALLOWED_PLANS = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join",
    "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project",
    "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedInlineTable",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction",
    "UnresolvedWith", "Unpivot", "Window", "WithWindowDefinition",
}
DESCRIBING_PLANS = {"DescribeRelation", "ShowColumns"}
TABLE_FUNCTIONS = {
    "explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer",
    "range", "stack",
}
SUBQUERIES = {
    "Exists", "FunctionTableSubqueryArgumentExpression", "LateralSubquery", "ListQuery", "ScalarSubquery",
}
# Functions that run code of their own; a name given as an expression could hide one of them.
FORBIDDEN_FUNCTIONS = {"java_method", "reflect", "try_reflect"}


class QueryRejected(ValueError):
    pass


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


class _Guard:
    def __init__(self, names: list[str]):
        self._names = {n.lower() for n in names}

    def check(self, plan) -> None:
        kind = _kind(plan)
        if kind == "ExplainCommand":
            inner = plan.logicalPlan()
            if _kind(inner) == "ExplainCommand":
                raise QueryRejected("EXPLAIN takes a query")
            self.check(inner)
        elif kind == "DescribeQueryCommand":
            self._plan(plan.plan(), self._names)
        elif kind in DESCRIBING_PLANS:
            for child in _items(plan.children()):
                if _kind(child) not in {"UnresolvedTable", "UnresolvedTableOrView"}:
                    raise QueryRejected(f"DESCRIBE is for tables and queries, not for {_kind(child)}")
                self._name(_items(child.multipartIdentifier()), self._names)
        else:
            self._plan(plan, self._names)

    def _name(self, parts: list[str], names: set[str]) -> None:
        if len(parts) != 1 or parts[0].lower() not in names:
            known = ", ".join(sorted(self._names))
            raise QueryRejected(f"no table {'.'.join(parts)!r} here, only {known}")

    def _plan(self, plan, names: set[str]) -> None:
        kind = _kind(plan)
        if kind not in ALLOWED_PLANS:
            raise QueryRejected(f"a statement may only read; {kind} does more")
        if kind == "UnresolvedWith":
            names = names | self._with_names(plan, names)
        elif kind == "UnresolvedRelation":
            self._name(_items(plan.multipartIdentifier()), names)
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(_items(plan.name())).lower()
            if name not in TABLE_FUNCTIONS:
                raise QueryRejected(f"table function {name!r} is not allowed")
        for child in _items(plan.children()):
            self._plan(child, names)
        for expression in _items(plan.expressions()):
            self._expression(expression, names)

    def _with_names(self, plan, names: set[str]) -> set[str]:
        """Checks the named sub-queries of a WITH; each sees the ones before it."""
        defined: set[str] = set()
        for relation in _items(plan.cteRelations()):
            name = relation.productElement(0).lower()
            own = {name} if plan.allowRecursion() else set()
            self._plan(relation.productElement(1), names | defined | own)
            defined.add(name)
        return defined

    def _expression(self, expression, names: set[str]) -> None:
        kind = _kind(expression)
        if kind == "UnresolvedFunction":
            name = ".".join(_items(expression.nameParts())).lower()
            if name in FORBIDDEN_FUNCTIONS or "." in name:
                raise QueryRejected(f"function {name!r} is not allowed")
        elif kind == "ExpressionWithUnresolvedIdentifier":
            raise QueryRejected("names must be written out")
        elif kind in SUBQUERIES:
            self._plan(expression.plan(), names)
        for child in _items(expression.children()):
            self._expression(child, names)


def _parsed(catalog: Catalog, sql: str):
    try:
        return catalog.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        if ";" in sql.strip().rstrip(";"):
            raise QueryRejected("one statement at a time") from error
        raise QueryRejected(str(error).split("\n", 1)[0]) from error


def guarded_sql(catalog: Catalog, sql: str) -> DataFrame:
    """The statement as a DataFrame, if it only reads catalog tables; else ``QueryRejected``."""
    catalog.refresh()
    summarize = re.fullmatch(r"\s*SUMMARIZE\s+(.+?)[\s;]*", sql, re.IGNORECASE | re.DOTALL)
    if summarize:
        whole = re.fullmatch(NAME_PATTERN, summarize[1])
        return profile(catalog.table(summarize[1]) if whole else guarded_sql(catalog, summarize[1]))
    if re.fullmatch(r"\s*SHOW\s+TABLES\s*;?\s*", sql, re.IGNORECASE):
        return catalog.list_tables()
    statement = sql.strip().rstrip(";")
    _Guard(catalog.names).check(_parsed(catalog, statement))
    return catalog.spark.sql(statement)


def run_query(catalog: Catalog, sql: str, max_rows: int = DEFAULT_ROWS) -> dict:
    """Columns and at most ``max_rows`` rows (1..1000); ``truncated`` says whether there were more."""
    cap = max(1, min(max_rows, MAX_ROWS))
    df = guarded_sql(catalog, sql)
    found = df.limit(cap + 1).collect()
    rows = [list(row) for row in found[:cap]]
    return {
        "columns": df.columns, "rows": rows, "row_count": len(rows), "truncated": len(found) > cap,
    }
