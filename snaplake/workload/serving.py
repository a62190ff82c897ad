"""Catalog, guarded SQL and search over whole tables."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from snaplake.functions.scalars import excerpt
from snaplake.plans import search as S
from snaplake.plans.postings import NewsIndex
from snaplake.plans.profiles import ProfileStore
from snaplake.plans.query import guarded_sql, run_query
from snaplake.plans.service import QueryService, load_catalog
from snaplake.session import work_dir, written
from snaplake.sources.catalog import Catalog, ensure_table, profile
from snaplake.sources.target import SnapshotTable
from snaplake.tables import INJURY_NEWS, TABLES
from snaplake.workload import landing
from snaplake.workload.parsing import NEWS_SQL, parsed
from snaplake.workload.registry import plain, query
from snaplake.workload.silver import silver
from snaplake.workload.upserts import USER_STATE, _halves, _newest_sql, _states, _two_batches


def _catalog(spark, sf_dir, *names):
    return Catalog(spark, {name: f"{sf_dir}/{name}.parquet" for name in names})


_JOIN = """
    WITH spent AS (
        SELECT o_custkey, count(*) AS n_orders, max(o_orderkey) AS last_order
        FROM orders WHERE o_orderstatus IN (SELECT DISTINCT l_linestatus FROM lineitem) GROUP BY o_custkey)
    SELECT c.c_name, c.c_mktsegment, s.n_orders, s.last_order
    FROM customer c JOIN spent s ON c.c_custkey = s.o_custkey
    WHERE s.n_orders >= 5 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)
"""


@query("guarded_sql", _JOIN)
def guarded_join(spark, sf_dir):
    return guarded_sql(_catalog(spark, sf_dir, "customer", "orders", "lineitem"), _JOIN)


_WINDOW = """
    SELECT event_type, user_id, event_id FROM (
        SELECT event_type, user_id, event_id,
            row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) AS n FROM events) ranked
    WHERE n = 1
"""


@query("guarded_window", _WINDOW)
def guarded_window(spark, sf_dir):
    return guarded_sql(_catalog(spark, sf_dir, "events"), _WINDOW)


_GROUP_ALL = """
    SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers
    FROM lineitem GROUP BY ALL ORDER BY ALL
"""


@query("guarded_group_all", _GROUP_ALL)
def guarded_group_all(spark, sf_dir):
    return guarded_sql(_catalog(spark, sf_dir, "lineitem"), _GROUP_ALL)


_CAPPED = "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey"


@query("capped_query", f"""
    SELECT o_orderkey, o_custkey, TRUE AS truncated FROM ({_CAPPED} LIMIT 200)
""")
def capped_query(spark, sf_dir):
    """What a caller of the row-capped interface gets: 200 rows, and that there were more."""
    result = run_query(_catalog(spark, sf_dir, "orders"), _CAPPED)
    rows = [(*row, result["truncated"]) for row in result["rows"]]
    return spark.createDataFrame(rows, "o_orderkey BIGINT, o_custkey BIGINT, truncated BOOLEAN")


_CATALOG_TABLES = landing.TABLES


@query("table_views", " UNION ALL ".join(
    f"SELECT '{name}' AS name, CAST(count(*) AS BIGINT) AS row_count FROM {name}" for name in _CATALOG_TABLES
))
def table_views(spark, sf_dir):
    """Every listed table with its row count, through its view."""
    catalog = _catalog(spark, sf_dir, *_CATALOG_TABLES)
    counted = [
        catalog.table(name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("name"), "row_count")
        for name in catalog.names
    ]
    result = counted[0]
    for more in counted[1:]:
        result = result.unionByName(more)
    return result


@query("table_list", " UNION ALL ".join(f"SELECT '{name}' AS name, (SELECT count(*) FROM {name}) > 0 AS filled" for name in landing.TABLES))
def table_list(spark, sf_dir):
    """The listing, and whether each listed path has rows."""
    catalog = _catalog(spark, sf_dir, *landing.TABLES)
    filled = None
    for row in catalog.list_tables().collect():  # one row per table
        one = catalog.spark.read.parquet(row["path"]).limit(1).agg(F.count(F.lit(1)) > 0)
        one = one.toDF("filled").select(F.lit(row["table"]).alias("name"), "filled")
        filled = one if filled is None else filled.unionByName(one)
    return filled


@query("table_columns", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, column_name, CAST(sum(n) AS BIGINT) AS filled FROM ("
    f"UNPIVOT (SELECT CAST(count(COLUMNS(*)) AS BIGINT) FROM {name}) ON COLUMNS(*) INTO NAME column_name VALUE n)"
    f" GROUP BY column_name"
    for name in landing.TABLES
))
def table_columns(spark, sf_dir):
    """The columns each table is described with, and how many values each has."""
    catalog = _catalog(spark, sf_dir, *landing.TABLES)
    result = None
    for name in catalog.names:
        columns = [c["name"] for c in catalog.describe_table(name)["columns"]]
        counted = catalog.table(name).agg(*(F.count(f"`{c}`").alias(c) for c in columns))
        pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("filled")) for c in columns))
        one = counted.select(F.inline(pairs)).select(F.lit(name).alias("table_name"), "column_name", "filled")
        result = one if result is None else result.unionByName(one)
    return result


@query("excerpts", "SELECT doc_id, substr(text, 1, 100) AS excerpt FROM documents")
def excerpts(spark, sf_dir):
    """What a report shows of a text: its first 100 characters (the cut is the feature)."""
    return landing.table(spark, sf_dir, "documents").select("doc_id", excerpt("text").alias("excerpt"))


@query("table_refresh", f"""
    SELECT 'before' AS moment, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
    FROM ({_newest_sql("event_type IN ('click', 'signup', 'view')")})
    UNION ALL
    SELECT 'after', count(*), CAST(sum(event_id) AS BIGINT) FROM ({_newest_sql('TRUE')})
""")
def table_refresh(spark, sf_dir):
    """A view follows the table to its next version when the next query comes."""
    target = SnapshotTable(spark, work_dir(spark, "refresh"), USER_STATE)
    first, second = _two_batches(_states(spark, sf_dir))
    target.upsert(first)
    catalog = Catalog(spark, {"user_state": target})
    totals = "SELECT '{0}' AS moment, count(*) AS n, sum(event_id) AS id_sum FROM user_state"
    before = written(guarded_sql(catalog, totals.format("before")), "before")
    target.upsert(second)
    after = guarded_sql(catalog, totals.format("after"))
    return before.unionByName(after)


def _profile_sql(name: str, numeric: bool, shown: str) -> str:
    number = "{0}" if numeric else "CAST(NULL AS DOUBLE)"
    text = "CAST(NULL AS VARCHAR)" if numeric else "CAST({0} AS VARCHAR)"
    return f"""SELECT '{name}' AS column_name, CAST(count(*) AS BIGINT) AS row_count,
        CAST(count(*) - count({name}) AS BIGINT) AS null_count,
        {text.format(f'min({name})')} AS min, {text.format(f'max({name})')} AS max,
        CAST({number.format(f'min({name})')} AS DOUBLE) AS least, CAST({number.format(f'max({name})')} AS DOUBLE) AS most,
        {f'round(avg({name}), 4)' if numeric else number} AS avg,
        {f'round(stddev_samp({name}), 4)' if numeric else number} AS std,
        TRUE AS {shown}_unique, TRUE AS {shown}_quartiles FROM orders"""


_ORDERS = (
    ("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True),
    ("o_orderdate", False), ("o_orderpriority", False),
)


_QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _numeric():
    return F.col("column_name").isin([name for name, numeric in _ORDERS if numeric])


def _profile_shown(summary, *checks):
    numeric = _numeric()
    return summary.select(
        "column_name", "row_count", "null_count",
        F.when(~numeric, F.col("min")).alias("min"), F.when(~numeric, F.col("max")).alias("max"),
        F.when(numeric, F.col("min").cast("double")).alias("least"), F.when(numeric, F.col("max").cast("double")).alias("most"),
        F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"), *checks,
    )


def _exact(orders, summary):
    """Per column that has values: how many distinct ones, and whether each estimated quartile is near its rank.

    A quartile that stands many times has a range of ranks; within 2 % of that range is near.
    """
    values = None
    for name, numeric in _ORDERS:
        number = F.col(name).cast("double") if numeric else F.lit(None).cast("double")
        counted = orders.groupBy(name).agg(F.count(name).alias("n")).where("n > 0")
        one = counted.select(F.lit(name).alias("column_name"), number.alias("number"), "n")
        values = one if values is None else values.unionByName(one)

    def share(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")

    number = F.col("number")
    return values.join(summary.select("column_name", *_QUARTILES), "column_name").groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_unique"),
        *(
            ((share(number < F.col(q)) <= p + 0.02) & (share(number <= F.col(q)) >= p - 0.02)).alias(f"near_{q}")
            for q, p in _QUARTILES.items()
        ),
    )


@query("table_profile", " UNION ALL ".join(_profile_sql(*c, "near") for c in _ORDERS))
def table_profile(spark, sf_dir):
    """Every column of orders. Extremes of numbers are compared as numbers; the estimates are held
    against exact figures: distinct values within a fifth, the ranks of the quartiles within 2 %."""
    orders = landing.table(spark, sf_dir, "orders")
    summary = written(profile(orders), "profile")
    judged = summary.join(_exact(orders, summary), "column_name", "left")
    exact = F.coalesce("n_unique", F.lit(0))
    near_unique = F.abs(F.col("approx_unique") - exact) <= 0.2 * exact
    near_quartiles = F.when(_numeric() & (exact > 0), F.col("near_q25") & F.col("near_q50") & F.col("near_q75"))
    return _profile_shown(
        judged, F.coalesce(near_unique, F.lit(False)).alias("near_unique"),
        near_quartiles.otherwise(F.coalesce(*_QUARTILES).isNull()).alias("near_quartiles"),
    )


@query("profile_merged", " UNION ALL ".join(_profile_sql(*c, "has") for c in _ORDERS))
def profile_merged(spark, sf_dir):
    """The same profile merged from those of years, which were made in two runs, the second for years that came later."""
    orders = landing.table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    schema = orders.drop("year").schema
    store = ProfileStore(spark, work_dir(spark, "profiles"), schema, ["year"])
    for years in _halves(orders, F.col("year") < 1995):
        store.refresh(years)
    return _profile_shown(
        store.profile(), (F.col("approx_unique") > 0).alias("has_unique"),
        (F.coalesce(*_QUARTILES).isNotNull() == _numeric()).alias("has_quartiles"),
    )


@query("table_ddl", """
    SELECT CAST(s_suppkey AS VARCHAR) AS team_id, concat('T', s_suppkey) AS abbreviation, s_name AS display_name
    FROM supplier
""")
def table_ddl(spark, sf_dir):
    """A table created from its declaration, filled with parsed rows and read back."""
    name = f"teams_{uuid.uuid4().hex}"
    teams = replace(TABLES["teams"], name=name)
    ensure_table(spark, teams, location=work_dir(spark, "ddl"))
    parsed(spark, sf_dir, "teams").select(*teams.columns).write.insertInto(teams.full_name)
    return spark.table(teams.full_name).select("team_id", "abbreviation", "display_name")


NOW = "2024-01-07 00:00:00"
_RESULT_SQL = """
    SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, title, description, impact, player_id,
        team_id, link"""
_SINCE_SQL = "created_at >= TIMESTAMP '2024-01-07' - INTERVAL 3 DAY"
_ORDER_SQL = "ORDER BY n.created_at DESC, n.id DESC"


def _news(spark, sf_dir):
    return silver(spark, sf_dir, "injury_news")


def _now():
    return F.lit(NOW).cast("timestamp")


@query("search_text", f"""
    {_RESULT_SQL} FROM ({NEWS_SQL}) n WHERE {_SINCE_SQL} AND (
        title ILIKE '%license%' OR description ILIKE '%license%'
        OR title ILIKE '%und%' OR description ILIKE '%und%') {_ORDER_SQL} LIMIT 20
""")
def search_text(spark, sf_dir):
    """Any of two words in title or text, newest first, at most 20 (the cap is the feature)."""
    return plain(S.search_news(_news(spark, sf_dir), query_text=" LICENSE  und ", days=3, limit=99, now=_now()))


@query("search_matches", f"""
    SELECT id FROM ({NEWS_SQL}) n WHERE created_at >= TIMESTAMP '2024-01-07' - INTERVAL 30 DAY
        AND (title ILIKE '%100\\%%' ESCAPE '\\' OR description ILIKE '%100\\%%' ESCAPE '\\'
            OR title ILIKE '%@%' OR description ILIKE '%@%'
            OR title ILIKE '%\\_%' ESCAPE '\\' OR description ILIKE '%\\_%' ESCAPE '\\')
""")
def search_matches(spark, sf_dir):
    """All matches in whole texts; a percent sign and an underscore stand for themselves."""
    return S.matching_news(_news(spark, sf_dir), query_text="100% @ _", days=30, now=_now()).select("id")


_INDEXED_WORDS = ["License", "100%", "@", "_", "ß", "qzx~", "0.5"]


def _any_word_sql(words) -> str:
    like = (w.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for w in words)
    return " OR ".join(f"{c} ILIKE '%{w}%' ESCAPE '\\'" for w in like for c in ("title", "description"))


@query("search_indexed", f"""
    SELECT id, title FROM ({NEWS_SQL}) n WHERE created_at >= TIMESTAMP '2024-01-07' - INTERVAL 30 DAY
        AND ({_any_word_sql(_INDEXED_WORDS)})
""")
def search_indexed(spark, sf_dir):
    """Words of all lengths, with signs that LIKE takes for its own, looked up in postings that two loads have built."""
    root = work_dir(spark, "postings")
    news = _news(spark, sf_dir)
    target = SnapshotTable(spark, f"{root}/news", INJURY_NEWS, buckets=16)
    index = NewsIndex(target, f"{root}/index")
    for half in (news.where("id % 2 = 0"), news.where("id % 2 = 1")):
        target.upsert(half)
        index.refresh(half)
    return index.matching(query_text=" ".join(_INDEXED_WORDS), days=30, now=_now()).select("id", "title")


@query("search_team", f"""
    {_RESULT_SQL} FROM ({NEWS_SQL}) n WHERE {_SINCE_SQL} AND team_id = 'SRC7' AND title ILIKE '%en report%'
    {_ORDER_SQL} LIMIT 8
""")
def search_team(spark, sf_dir):
    found = S.search_news(_news(spark, sf_dir), team="src7", player="EN Report", days=3, now=_now())
    return plain(found)


@query("search_team_name", f"""
    SELECT id FROM ({NEWS_SQL}) n WHERE {_SINCE_SQL} AND team_id IN (
        SELECT concat('SRC', s_suppkey) FROM supplier WHERE s_name ILIKE '%00001%')
""")
def search_team_name(spark, sf_dir):
    """A part of the team's name instead of its abbreviation, through the teams table."""
    teams = silver(spark, sf_dir, "teams").withColumn("abbreviation", F.concat(F.lit("SRC"), "team_id"))
    return S.matching_news(_news(spark, sf_dir), team="00001", days=3, now=_now(), teams=teams).select("id")


@query("search_service", f"""
    SELECT title, player_id, team_id, link FROM ({NEWS_SQL}) n WHERE team_id IN (
        SELECT concat('SRC', s_suppkey) FROM supplier WHERE s_name ILIKE '%0000%') {_ORDER_SQL} LIMIT 20
""")
def search_service(spark, sf_dir):
    """The search of the query service by a part of the team's name, over a configured catalog (its cap is the feature)."""
    root = work_dir(spark, "service")
    _news(spark, sf_dir).write.parquet(f"{root}/news")
    teams = silver(spark, sf_dir, "teams").withColumn("abbreviation", F.concat(F.lit("SRC"), "team_id"))
    teams.write.parquet(f"{root}/teams")
    config = json.dumps({"tables": {"injury_news": f"{root}/news", "teams": f"{root}/teams"}})
    found = QueryService(load_catalog(spark, config)).search_news(team="0000", days=100_000, limit=20)["results"]
    kinds = "title STRING, player_id BIGINT, team_id STRING, link STRING"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in found], kinds)


@query("service_alias", """
    SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT u.event_id) AS BIGINT) AS newest
    FROM lineitem JOIN (
        SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    ) u ON l_suppkey = u.user_id GROUP BY l_returnflag
""")
def service_alias(spark, sf_dir):
    """A merged table and a parquet table under configured names, joined by SQL of the service's guard."""
    target = SnapshotTable(spark, work_dir(spark, "alias"), USER_STATE)
    target.upsert(_states(spark, sf_dir))
    config = json.dumps({"tables": {"people": target.path, "parts_sold": f"{sf_dir}/lineitem.parquet"}})
    return guarded_sql(load_catalog(spark, config), """
        SELECT l_returnflag, count(*) AS n, count(DISTINCT event_id) AS newest
        FROM parts_sold JOIN people ON l_suppkey = user_id GROUP BY l_returnflag
    """)


@query("recent_first", f"{_RESULT_SQL} FROM ({NEWS_SQL}) n WHERE {_SINCE_SQL} {_ORDER_SQL} LIMIT 1")
def recent_first(spark, sf_dir):
    """No filter: the newest article; a limit below 1 means 1."""
    return plain(S.search_news(_news(spark, sf_dir), days=3, limit=0, now=_now()))
