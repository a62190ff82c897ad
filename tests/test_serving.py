import json
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from snaplake.plans import search as S
from snaplake.plans.query import QueryRejected, guarded_sql, run_query
from snaplake.plans.service import QueryService, load_catalog, to_json
from snaplake.sources.catalog import Catalog, profile, reset_tables
from snaplake.sources.target import SnapshotTable
from snaplake.streaming.ingest import ingest_batch
from snaplake.tables import TABLES
from snaplake.workload import ORACLES, serving
from tests.test_merge import T1, T2, TEAM, batch  # noqa: F401


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    users = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35)], "id BIGINT, name STRING, age BIGINT")
    locations = spark.createDataFrame([(1, "NYC"), (2, "LA"), (3, "SF")], "user_id BIGINT, city STRING")
    users.write.parquet(f"{root}/users")
    locations.write.parquet(f"{root}/locations")
    return {"users": f"{root}/users", "locations": f"{root}/locations"}


@pytest.fixture
def catalog(spark, paths):
    return Catalog(spark, paths)


def test_names_are_checked(spark, paths):
    with pytest.raises(ValueError, match="a catalog needs"):
        Catalog(spark, {})
    for name in ("123_invalid", "a-b", "a b", "a;b", ""):
        with pytest.raises(ValueError, match="cannot name a table"):
            Catalog(spark, {name: paths["users"]})


def test_list_describe_and_unknown(catalog, paths):
    assert {r["table"]: r["path"] for r in catalog.list_tables().collect()} == paths
    described = catalog.describe_table("users")
    assert [c["name"] for c in described["columns"]] == ["id", "name", "age"] and described["num_files"] >= 1
    with pytest.raises(ValueError, match="no table 'nope' here, only users, locations"):
        catalog.describe_table("nope")
    with pytest.raises(ValueError, match="keeps no history"):
        catalog.table_history("users")


def test_queries(catalog):
    result = run_query(catalog, "SELECT id, name FROM users WHERE id > 1 ORDER BY id")
    assert result == {"columns": ["id", "name"], "rows": [[2, "Bob"], [3, "Charlie"]], "row_count": 2, "truncated": False}
    assert run_query(catalog, "SELECT count(*) AS n FROM users;")["rows"] == [[3]]
    assert run_query(catalog, "SELECT u.name, l.city FROM users u JOIN locations l ON u.id = l.user_id")["row_count"] == 3
    capped = run_query(catalog, "SELECT * FROM users", max_rows=2)
    assert capped["row_count"] == 2 and capped["truncated"] is True
    assert run_query(catalog, "SELECT * FROM users", max_rows=3)["truncated"] is False
    assert run_query(catalog, "SELECT * FROM users", max_rows=-5)["row_count"] == 1
    assert run_query(catalog, "SELECT id FROM range(5000)", max_rows=10**6)["row_count"] == 1000


@pytest.mark.parametrize("sql", [
    "WITH a AS (SELECT id FROM users), b AS (SELECT * FROM a) SELECT * FROM b WHERE id IN (SELECT user_id FROM locations)",
    "SELECT age, count(*) FROM users GROUP BY ALL ORDER BY ALL",
    "SELECT * FROM (VALUES (1), (2)) AS v(x)",
    "SELECT name, row_number() OVER (ORDER BY age) AS n FROM users",
    "SELECT x FROM users LATERAL VIEW explode(array(id, age)) e AS x",
    "SELECT id FROM users UNION ALL SELECT user_id FROM locations EXCEPT SELECT 3",
    "SELECT age, sum(id) FROM users GROUP BY ROLLUP (age) HAVING sum(id) > 0",
    "SELECT (SELECT max(age) FROM users) AS oldest",
    "SELECT id FROM USERS WHERE name = 'a;b'",
    "SELECT id FROM users TABLESAMPLE (50 PERCENT)",
    "EXPLAIN SELECT * FROM users", "DESCRIBE users", "DESCRIBE TABLE EXTENDED users", "SHOW TABLES",
    "SHOW COLUMNS IN users", "SUMMARIZE users", "DESCRIBE SELECT id FROM users", "SUMMARIZE SELECT id, age + 1 AS n FROM users WHERE id > 1;",
])
def test_reading_is_allowed(catalog, sql):
    guarded_sql(catalog, sql).collect()


@pytest.mark.parametrize("sql,reason", [
    ("INSERT INTO users VALUES (4, 'x', 1)", "may only read"),
    ("DELETE FROM users", "may only read"),
    ("UPDATE users SET age = 1", "may only read"),
    ("DROP TABLE users", "may only read"),
    ("DROP VIEW users", "may only read"),
    ("CREATE TABLE x AS SELECT * FROM users", "may only read"),
    ("CREATE TEMPORARY VIEW x AS SELECT 1", "may only read"),
    ("CACHE TABLE users", "may only read"),
    ("SET spark.sql.ansi.enabled=false", "may only read"),
    ("INSERT OVERWRITE DIRECTORY '/tmp/x' USING json SELECT 1", "may only read"),
    ("BEGIN SELECT 1; END", "may only read"),
    ("SELECT 1; SELECT 2", "one statement"),
    ("SELECT 1; DROP TABLE users", "one statement"),
    ("EXPLAIN INSERT INTO users VALUES (4, 'x', 1)", "may only read"),
    ("EXPLAIN EXPLAIN SELECT 1", None),
    ("SELECT /*+ BROADCAST(users) */ * FROM users JOIN locations ON id = user_id", "may only read"),
    ("DESCRIBE SELECT * FROM secrets", "no table"),
    ("SUMMARIZE SELECT * FROM secrets", "no table"),
    ("SELECT * FROM secrets", "no table"),
    ("SELECT * FROM json.`/etc/passwd`", "no table"),
    ("SELECT * FROM spark_catalog.default.users", "no table"),
    ("SELECT * FROM users WHERE id IN (SELECT id FROM secrets)", "no table"),
    ("SELECT (SELECT max(x) FROM secrets)", "no table"),
    ("SELECT * FROM users u WHERE EXISTS (SELECT 1 FROM text.`/etc/passwd`)", "no table"),
    ("WITH secrets AS (SELECT * FROM secrets) SELECT * FROM secrets", "no table"),
    ("WITH a AS (SELECT 1 AS x) SELECT * FROM a JOIN b ON true", "no table"),
    ("SELECT * FROM users, LATERAL (SELECT * FROM secrets)", "no table"),
    ("DESCRIBE secrets", "no table"),
    ("SHOW COLUMNS IN secrets", "no table"),
    ("SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "not allowed"),
    ("SELECT id FROM users ORDER BY java_method('java.util.UUID', 'randomUUID')", "not allowed"),
    ("SELECT id FROM users WHERE try_reflect('java.util.UUID', 'randomUUID') IS NULL", "not allowed"),
    ("SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.dir')", "written out"),
    ("SELECT * FROM IDENTIFIER('sec' || 'rets')", "may only read"),
    ("SELECT * FROM users QUALIFY row_number() OVER (ORDER BY id) = 1", None),
    ("not sql", None),
])
def test_everything_else_is_rejected(catalog, sql, reason):
    with pytest.raises(QueryRejected, match=reason):
        guarded_sql(catalog, sql)


def test_views_follow_versions(spark, batch, tmp_path):  # noqa: F811
    target = SnapshotTable(spark, str(tmp_path / "team"), TEAM, buckets=4)
    target.upsert(batch(("1", "A", T1, "a")))
    catalog = Catalog(spark, {"team": target})
    assert run_query(catalog, "SELECT abbreviation FROM team")["rows"] == [["A"]]
    assert catalog.refresh() == []
    target.upsert(batch(("1", "B", T2, "b")))
    assert run_query(catalog, "SELECT abbreviation FROM team")["rows"] == [["B"]]
    described = catalog.describe_table("team")
    assert described["version"] == 2 and described["columns"][0] == {"name": "team_id", "type": "string", "nullable": False}
    assert [r["version"] for r in catalog.table_history("team", 500).collect()] == [2, 1]


def test_catalogs_do_not_see_each_other(spark, tmp_path):
    for n in (5, 50):
        spark.range(n).write.parquet(str(tmp_path / f"t{n}"))
    few, many = (Catalog(spark, {"numbers": str(tmp_path / f"t{n}")}) for n in (5, 50))
    count = "SELECT count(*) AS n FROM numbers"
    assert [run_query(c, count)["rows"] for c in (few, many, few)] == [[[5]], [[50]], [[5]]]


def test_parquet_sources_are_listed_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    catalog = Catalog(spark, {"numbers": path})
    for mode, n in (("append", 12), ("overwrite", 7)):
        spark.range(7).write.mode(mode).parquet(path)
        assert run_query(catalog, "SELECT count(*) AS n FROM numbers")["rows"] == [[n]]


def test_any_name_in_the_config_finds_a_merged_table(spark, batch, tmp_path):  # noqa: F811
    target = SnapshotTable(spark, str(tmp_path / "team"), TEAM)
    for at, name in ((T1, "A"), (T2, "B")):
        target.upsert(batch(("1", name, at, "f")))
    service = QueryService(load_catalog(spark, json.dumps({"tables": {"franchises": target.path}})))
    assert service.query("SELECT abbreviation FROM franchises")["rows"] == [["B"]]
    described = service.describe_table("franchises")
    assert (described["version"], described["num_files"]) == (2, 1) and described["columns"][0]["nullable"] is False


def test_filters_and_columns_reach_the_scan(catalog):
    plan = guarded_sql(catalog, "SELECT name FROM users WHERE id > 1")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,1)]" in plan and "ReadSchema: struct<id:bigint,name:string>" in plan


def test_profile(catalog):
    rows = {r["column_name"]: r for r in profile(catalog.table("users")).collect()}
    assert (rows["age"]["min"], rows["age"]["max"], rows["age"]["avg"], rows["age"]["q50"]) == ("25", "35", 30.0, 30.0)
    assert rows["name"]["avg"] is None and rows["name"]["approx_unique"] == 3 and rows["id"]["null_count"] == 0


def test_profile_estimates_are_near_the_exact_figures(spark):
    """Distinct values within a fifth, the ranks of the quartiles within 2 %."""
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    estimates = {r.column_name: r for r in profile(orders).collect()}
    numbers = {f.name for f in orders.schema if f.dataType.typeName() in ("long", "integer", "double")}
    assert numbers
    for f in orders.schema:
        exact = orders.select(f.name).distinct().count()
        assert abs(estimates[f.name].approx_unique - exact) <= 0.2 * exact
        for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)) if f.name in numbers else ():
            rank = orders.where(F.col(f.name) <= estimates[f.name][q]).count() / orders.count()
            below = orders.where(F.col(f.name) < estimates[f.name][q]).count() / orders.count()
            assert below - 0.02 <= p <= rank + 0.02


@pytest.mark.parametrize("column, field, wrong", [
    ("o_custkey", "approx_unique", "approx_unique * 2"), ("o_orderstatus", "approx_unique", "NULL"),
    ("o_totalprice", "q25", "q50"), ("o_orderkey", "q50", "q75"), ("o_totalprice", "q75", "NULL"), ("o_orderdate", "q50", "1.0"),
])
def test_table_profile_shows_an_estimate_that_is_not_near(spark, monkeypatch, column, field, wrong):
    """An estimate that is there, but wrong, is told from one near the exact figure."""
    changed = F.expr(f"CASE WHEN column_name = '{column}' THEN {wrong} ELSE {field} END")
    monkeypatch.setattr(serving, "profile", lambda df: profile(df).withColumn(field, changed))
    shown = "near_unique" if field == "approx_unique" else "near_quartiles"
    rows = serving.table_profile(spark, "/root/testdata/sf0.01").collect()
    far = [(r.column_name, c) for r in rows for c in ("near_unique", "near_quartiles") if r[c] is not True]
    assert len(rows) == 6 and far == [(column, shown)]


@pytest.mark.parametrize("rows", ["o_orderkey < 0", "o_orderkey <= 3", "true"])
def test_table_profile_of_odd_tables_equals_its_sql(spark, tmp_path, rows):
    """No rows, few rows, one value throughout, one value in most rows, a column without values."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where(rows).withColumns({
        "o_custkey": F.lit(7).cast("long"), "o_totalprice": F.expr("IF(o_orderkey % 10 > 0, 5.5D, o_totalprice)"),
        "o_orderpriority": F.lit(None).cast("string"),
    })
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(ORACLES["table_profile"])
    names = [d[0] for d in want.description]
    got = serving.table_profile(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == [pytest.approx(r) for r in sorted(want.fetchall())]


@pytest.mark.parametrize("column", ["o_custkey", "o_totalprice"])
def test_table_profile_of_a_number_without_values(spark, tmp_path, column):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.withColumn(column, F.lit(None).cast(orders.schema[column].dataType)).write.parquet(f"{tmp_path}/orders.parquet")
    row = serving.table_profile(spark, str(tmp_path)).where(F.col("column_name") == column).first()
    assert (row.null_count, row.avg, row.near_unique, row.near_quartiles) == (row.row_count, None, True, True)


def test_profile_of_maps_counts_only(spark):
    row = profile(spark.sql("SELECT map('a', 1) AS m UNION ALL SELECT NULL")).first()
    assert (row["column_name"], row["row_count"], row["null_count"], row["min"], row["approx_unique"]) == ("m", 2, 1, None, None)


def test_reset_needs_confirmation_and_spares_news(spark, tmp_path):
    folder = tmp_path / "silver_teams"
    folder.mkdir()
    kept = tmp_path / "news"
    kept.mkdir()
    where = {"teams": [str(folder), str(tmp_path / "missing")], "injury_news": [str(kept)]}
    assert reset_tables(spark, TABLES, where, confirm="yes") == [] and folder.exists()
    spark.sql("CREATE SCHEMA IF NOT EXISTS nfl")
    dropped = reset_tables(spark, TABLES, where, confirm="RESET")
    assert len(dropped) == 8 and not folder.exists() and kept.exists()


NOW = datetime(2026, 10, 5, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def news(spark):
    rows = [
        (1, NOW, "Patrick Mahomes (knee)", "limited, said O'Neal", "KC"),
        (2, NOW - timedelta(days=1), "Joe Thuney (shoulder)", "full 100%", "KC"),
        (3, NOW - timedelta(days=15), "Mike Evans (hamstring)", "out_of practice", "TB"),
        (4, NOW, "Leonard Fournette (ankle)", "Knee is fine", "TB"),
        (5, None, "undated knee", "x", "KC"),
    ]
    df = spark.createDataFrame(rows, "id BIGINT, created_at TIMESTAMP, title STRING, description STRING, team_id STRING")
    return df.select("*", F.lit("i").alias("impact"), F.col("id").alias("player_id"), F.lit("l").alias("link"))


@pytest.mark.parametrize("filters,ids", [
    ({}, [4, 1, 2]),
    ({"query_text": "KNEE"}, [4, 1]),
    ({"query_text": "  shoulder   hamstring "}, [2]),
    ({"player": "Evans", "days": 20}, [3]),
    ({"player": "Evans", "days": 10}, []),
    ({"team": "kc"}, [1, 2]),
    ({"team": "KC", "query_text": "knee"}, [1]),
    ({"query_text": "0%"}, [2]),
    ({"query_text": "%"}, [2]),
    ({"query_text": "_", "days": 30}, [3]),
    ({"query_text": "O'Neal"}, [1]),
    ({"query_text": "zzz"}, []),
    ({"days": 0}, [4, 1, 2]),
    ({"team": "x' OR '1'='1"}, []),
])
def test_search(news, filters, ids):
    found = S.matching_news(news, now=F.lit(NOW), **filters).orderBy(F.col("created_at").desc(), F.col("id").desc())
    assert [r["id"] for r in found.collect()] == ids


def test_search_limits_and_envelope(news, spark):
    now = F.lit(NOW)
    assert S.search_news(news, now=now, limit=2).count() == 2
    assert S.search_news(news, now=now, limit=0).count() == 1
    assert S.search_news(news, now=now).columns == list(S.RESULT_COLUMNS)
    envelope = S.search_envelope(news, now=now, limit=3)
    assert envelope["count"] == 3 and envelope["truncated"] is False and envelope["days"] == 14
    assert S.search_envelope(news, now=now, limit=2)["truncated"] is True
    assert envelope["results"][0]["created_at"].startswith("2026-10-05T00:00:00")
    failed = S.search_envelope(news.drop("title"), player="x")
    assert "error" in failed and failed["player"] == "x"


def test_search_by_team_name_and_team_join(news, spark):
    teams = spark.createDataFrame([("12", "KC", "Kansas City Chiefs"), ("27", "TB", "Tampa Bay Buccaneers")],
                                  "team_id STRING, abbreviation STRING, display_name STRING")
    found = S.matching_news(news, team="chiefs", now=F.lit(NOW), teams=teams)
    assert sorted(r["id"] for r in found.collect()) == [1, 2]
    teams = teams.union(spark.createDataFrame([("99", "KC", "Kansas City Comets")], teams.schema))
    about = {r["id"]: (r["feed_team_id"], r["team_name"]) for r in S.news_with_team(news, teams).collect()}
    assert len(about) == 5 and about[3] == ("27", "Tampa Bay Buccaneers")
    assert S.title_mentions(news, "MAHOMES").count() == 1


def test_service_over_an_ingested_lake(spark, land, tmp_path, paths):
    table = TABLES["injury_news"]
    now = datetime.now(timezone.utc)
    items = [{"id": i, "created": (now - timedelta(days=d)).strftime("%Y-%m-%d %H:%M:%S"), "team_id": t, "title": f"{n} (knee)"}
             for i, d, t, n in ((1, 0, "KC", "Mahomes"), (2, 3, "TB", "Evans"), (3, 40, "KC", "Old"))]
    target = SnapshotTable(spark, str(tmp_path / "news"), table, buckets=4)
    ingest_batch(spark, target, land(table, {"items": items}))
    config = json.dumps({"tables": {"injury_news": target.path, "users": paths["users"]}})
    service = QueryService(load_catalog(spark, config))
    assert [t["table"] for t in service.list_tables()] == ["injury_news", "users"]
    assert service.describe_table("injury_news")["version"] == 1
    assert service.table_history("injury_news")[0]["rows_inserted"] == 3
    assert service.query("SELECT count(*) AS n FROM injury_news")["rows"] == [[3]]
    assert [r["title"] for r in service.search_news("KNEE")["results"]] == ["Mahomes (knee)", "Evans (knee)"]
    assert service.search_news(team="kc", days=60)["count"] == 2
    club = land(TABLES["teams"], [{"id": "27", "abbreviation": "TB", "displayName": "Tampa Bay Buccaneers"},
                                  {"id": "28", "abbreviation": "TB", "displayName": "Tampa Bay Bandits"}])
    clubs = SnapshotTable(spark, str(tmp_path / "clubs"), TABLES["teams"])
    ingest_batch(spark, clubs, club)
    named = QueryService(load_catalog(spark, json.dumps({"tables": {"injury_news": target.path, "teams": clubs.path}})))
    assert [r["team_id"] for r in named.search_news(team="tampa")["results"]] == ["TB"]
    answer = json.loads(to_json([service.table_history("injury_news"), service.search_news(player="evans")]))
    assert answer[1]["results"][0]["team_id"] == "TB"
    with pytest.raises(ValueError, match="a catalog needs"):
        load_catalog(spark, "{}")
