"""Every registered query against its SQL twin, and what its plan must not contain."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from snaplake.workload import ORACLES, QUERIES
from snaplake.workload.landing import TABLES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_twin(spark, con, name):
    df = QUERIES[name](spark, str(SF))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BatchEvalPython|ArrowEvalPython|MapInPandas|PythonUDF", plan)
    relation = con.execute(ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, df.collect()) == canonical(names, relation.fetchall())
