"""De-duplication, merge, versioned target and streams over whole tables.

Events stand in for snapshots: the table ``user_state`` keeps the newest event of each user.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.operators.latest import (
    at_latest_snapshot,
    dedupe_latest,
    latest_rows,
    preview_latest,
    top_n_per_group,
)
from snaplake.operators.merge import key_counts, merge_latest
from snaplake.operators.totals import RunningTotals
from snaplake.plans.parsers import parse
from snaplake.session import work_dir, written
from snaplake.sources.snapshots import write_landing
from snaplake.sources.target import SnapshotTable
from snaplake.spec import COUNT, RATE, TEXT, Table, col, key
from snaplake.streaming.ingest import ingest_available, ingest_batch, unreadable
from snaplake.tables import TABLES
from snaplake.workload import landing
from snaplake.workload.parsing import GAMES_SQL, landed, parsed
from snaplake.workload.registry import plain, query

_RAW = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
_REST = (col("event_type", TEXT), col("value", RATE), col("props", TEXT))

USER_STATE = Table(
    name="user_state", prefix="events", raw=_RAW,
    fields=(key("user_id", COUNT), col("event_id", COUNT), *_REST),
)
EVENT_LOG = Table(
    name="event_log", prefix="events", raw=_RAW,
    fields=(key("event_id", COUNT), col("user_id", COUNT), *_REST),
)

DOCUMENT_LOG = Table(
    name="document_log", prefix="documents",
    raw="doc_id BIGINT, lang STRING, source STRING, n_chars BIGINT, text STRING",
    fields=(key("doc_id", COUNT), col("lang", TEXT), col("source", TEXT), col("n_chars", COUNT), col("text", TEXT)),
)

FIRST_TYPES = ("click", "signup", "view")
_FIRST_SQL = "event_type IN ('click', 'signup', 'view')"


def _states(spark, sf_dir, snapshot="ts"):
    events = landing.table(spark, sf_dir, "events").select(
        "*",
        F.format_string("events/%012d", "event_id").alias("_source_file"),
        F.expr(snapshot).cast("timestamp").alias("_snapshot_at"),
    )
    return parse(USER_STATE, events)


def _halves(df, condition):
    """The rows that meet a condition, and all others: a row for which it is NULL is one of those."""
    met = F.coalesce(condition, F.lit(False))
    return df.filter(met), df.filter(~met)


def _two_batches(states):
    return _halves(states, F.col("event_type").isin(*FIRST_TYPES))


def _shown(states):
    return states.select("user_id", "event_id", "event_type", "value", "props")


def _newest_sql(where: str, order: str = "ts DESC, event_id DESC") -> str:
    return f"""
        SELECT user_id, event_id, event_type, value, props, ts FROM events WHERE {where}
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {order}) = 1"""


_NEWEST = f"SELECT * EXCLUDE (ts) FROM ({_newest_sql('TRUE')})"


@query("dedupe_latest", _NEWEST)
def dedupe_latest_events(spark, sf_dir):
    return _shown(dedupe_latest(_states(spark, sf_dir), USER_STATE))


@query("dedupe_ties", f"""
    SELECT * EXCLUDE (ts) FROM ({_newest_sql('TRUE', "date_trunc('day', ts) DESC, event_id DESC")})
""")
def dedupe_ties(spark, sf_dir):
    """Snapshots cut to days, so that many rows of a key tie and the later file decides."""
    return _shown(dedupe_latest(_states(spark, sf_dir, "date_trunc('day', ts)"), USER_STATE))


@query("latest_order_per_customer", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderkey DESC) = 1
""")
def latest_order_per_customer(spark, sf_dir):
    orders = landing.table(spark, sf_dir, "orders")
    tied = orders.withColumn("file", F.concat("o_orderpriority", F.format_string("%012d", "o_orderkey")))
    return latest_rows(tied, ["o_custkey"], "o_orderdate", "file").select("o_custkey", "o_orderkey", "o_totalprice")


@query("merge_two_batches", _NEWEST)
def merge_two_batches(spark, sf_dir):
    """The merge as a plan: the first batch is the table, the second is merged into it."""
    first, second = _two_batches(_states(spark, sf_dir))
    return _shown(merge_latest(dedupe_latest(first, USER_STATE), second, USER_STATE))


def _merge_sql(day: str) -> str:
    """Two batches under a snapshot expression: strictly newer replaces, anything else stays."""
    order = f"{day} DESC NULLS LAST, event_id DESC"
    return f"""
        WITH t AS (SELECT *, {day} AS snap FROM ({_newest_sql(_FIRST_SQL, order)})),
            s AS (SELECT *, {day} AS snap FROM ({_newest_sql(f'NOT {_FIRST_SQL}', order)}))
        SELECT coalesce(t.user_id, s.user_id) AS user_id,
            CASE WHEN t.user_id IS NULL OR s.snap > t.snap THEN s.event_id ELSE t.event_id END AS event_id,
            CASE WHEN t.user_id IS NULL OR s.snap > t.snap THEN s.event_type ELSE t.event_type END AS event_type,
            CASE WHEN t.user_id IS NULL OR s.snap > t.snap THEN s.value ELSE t.value END AS value,
            CASE WHEN t.user_id IS NULL OR s.snap > t.snap THEN s.props ELSE t.props END AS props
        FROM t FULL OUTER JOIN s ON t.user_id = s.user_id"""


@query("merge_equal_snapshots", _merge_sql("date_trunc('day', ts)"))
def merge_equal_snapshots(spark, sf_dir):
    """An equal snapshot in a later batch does not replace the row held."""
    first, second = _two_batches(_states(spark, sf_dir, "date_trunc('day', ts)"))
    return _shown(merge_latest(dedupe_latest(first, USER_STATE), second, USER_STATE))


@query("merge_null_snapshots", _merge_sql("CASE WHEN value < 200 THEN ts END"))
def merge_null_snapshots(spark, sf_dir):
    """A NULL snapshot neither replaces nor is replaced."""
    first, second = _two_batches(_states(spark, sf_dir, "CASE WHEN value < 200 THEN ts END"))
    return _shown(merge_latest(dedupe_latest(first, USER_STATE), second, USER_STATE))


def _target(spark, table=USER_STATE):
    return SnapshotTable(spark, work_dir(spark, table.name), table)


@query("upsert_two_batches", _NEWEST)
def upsert_two_batches(spark, sf_dir):
    target = _target(spark)
    for batch in _two_batches(_states(spark, sf_dir)):
        target.upsert(batch)
    return _shown(target.read())


@query("upsert_older_ignored", f"""
    SELECT * EXCLUDE (ts) FROM ({_newest_sql("TRUE")})
""")
def upsert_older_ignored(spark, sf_dir):
    """The later half first, then the earlier half, which may only add users."""
    target, states = _target(spark), _states(spark, sf_dir)
    late = F.col("_snapshot_at") >= F.lit("2024-01-16").cast("timestamp")
    for half in _halves(states, late):
        target.upsert(half)
    return _shown(target.read())


@query("upsert_replay", _NEWEST)
def upsert_replay(spark, sf_dir):
    """The same batches once more change nothing."""
    target = _target(spark)
    batches = _two_batches(_states(spark, sf_dir))
    for batch in (*batches, *batches):
        target.upsert(batch)
    return _shown(target.read())


@query("running_totals", f"""
    SELECT event_type, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(event_id) AS BIGINT) AS event_id
    FROM ({_NEWEST}) GROUP BY event_type
""")
def running_totals(spark, sf_dir):
    """Users by their newest event, kept over three loads, of which the last is a replay; users move between groups."""
    target = _target(spark)
    totals = RunningTotals(spark, f"{target.path}/totals", ["event_type"], ["event_id"])
    first, second = _two_batches(_states(spark, sf_dir))
    for batch in (first, second, first):
        target.upsert(batch, totals=[totals])
        totals.fold()
    return totals.read()


@query("table_history", f"""
    WITH t AS ({_newest_sql(_FIRST_SQL)}), s AS ({_newest_sql(f'NOT {_FIRST_SQL}')})
    SELECT CAST(1 AS BIGINT) AS version, count(*) AS rows_inserted, CAST(0 AS BIGINT) AS rows_updated,
        count(*) AS rows_total FROM t
    UNION ALL
    SELECT 2, count(*) FILTER (WHERE t.user_id IS NULL), count(*) FILTER (WHERE s.ts > t.ts),
        count(*) FILTER (WHERE t.user_id IS NULL) + (SELECT count(*) FROM t)
    FROM s LEFT JOIN t ON s.user_id = t.user_id
""")
def table_history(spark, sf_dir):
    """What each upsert inserted and updated, from the log of loads."""
    target = _target(spark)
    for batch in _two_batches(_states(spark, sf_dir)):
        target.upsert(batch)
    return target.loads().select("version", "rows_inserted", "rows_updated", "rows_total")


@query("table_versions", f"""
    SELECT 'before' AS moment, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
    FROM ({_newest_sql(_FIRST_SQL)})
    UNION ALL
    SELECT 'after', count(*), CAST(sum(event_id) AS BIGINT) FROM ({_newest_sql('TRUE')})
""")
def table_versions(spark, sf_dir):
    """Totals of the table after each of two upserts; the first are written down, as the second replaces files."""
    target = _target(spark)
    first, second = _two_batches(_states(spark, sf_dir))

    def totals(moment):
        sums = target.read().agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))
        return sums.select(F.lit(moment).alias("moment"), "n", "id_sum")

    target.upsert(first)
    before = written(totals("before"), "totals")
    target.upsert(second)
    return before.unionByName(totals("after"))


@query("stream_upsert", "SELECT event_id, user_id, event_type, value, props FROM events")
def stream_upsert(spark, sf_dir):
    """Events landed as JSON in two runs and ingested by a stream each time; then a replay."""
    root = work_dir(spark, "stream")
    events = landing.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    target = SnapshotTable(spark, f"{root}/table", EVENT_LOG)
    for part in _two_batches(events):
        write_landing(part, f"{root}/landing/{EVENT_LOG.prefix}", records_per_file=1_000_000)
        ingest_available(spark, target, f"{root}/landing", f"{root}/checkpoint", multiLine="false")
    # A lost checkpoint means that all files come again.
    ingest_available(spark, target, f"{root}/landing", f"{root}/checkpoint-2", multiLine="false")
    return target.read().select("event_id", "user_id", "event_type", "value", "props")


_CUT_LINE_SQL = """concat('{"doc_id":', doc_id, ',"source":"', source, '","n_chars":')"""


@query("json_quarantine", f"""
    SELECT doc_id, lang, source, n_chars, md5(text) AS digest, CAST(NULL AS VARCHAR) AS unreadable
    FROM documents WHERE doc_id % 7 <> 3
    UNION ALL
    SELECT NULL, NULL, NULL, NULL, NULL, {_CUT_LINE_SQL} FROM documents WHERE doc_id % 7 = 3
""")
def json_quarantine(spark, sf_dir):
    """All documents landed as JSON lines, every seventh cut off half way: a stream loads the whole ones and keeps the others."""
    root = work_dir(spark, "quarantine")
    documents = landing.table(spark, sf_dir, "documents")
    cut = F.concat(F.lit('{"doc_id":'), "doc_id", F.lit(',"source":"'), "source", F.lit('","n_chars":'))
    line = F.when(F.col("doc_id") % 7 == 3, cut).otherwise(F.to_json(F.struct("doc_id", "lang", "source", "n_chars", "text")))
    documents.select(line.alias("value")).write.text(f"{root}/landing/{DOCUMENT_LOG.prefix}")
    target = SnapshotTable(spark, f"{root}/table", DOCUMENT_LOG)
    ingest_available(spark, target, f"{root}/landing", f"{root}/checkpoint", multiLine="false")
    good = target.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))
    return good.unionByName(unreadable(target).select(F.col("text").alias("unreadable")), allowMissingColumns=True)


@query("stream_games", GAMES_SQL)
def stream_games(spark, sf_dir):
    """Game summaries from landing files to the games table in one availableNow stream."""
    games = TABLES["games"]
    root = work_dir(spark, "stream-games")
    records = landed(spark, sf_dir, "games").drop("_source_file", "_snapshot_at")
    write_landing(records, f"{root}/landing/{games.prefix}", records_per_file=100_000)
    target = SnapshotTable(spark, f"{root}/table", games)
    ingest_available(spark, target, f"{root}/landing", f"{root}/checkpoint", multiLine="false")
    return plain(target.read().select(*(f.name for f in games.fields)))


_KEYS = (
    ("region", ("r_regionkey",)),
    ("nation", ("n_nationkey",)),
    ("customer", ("c_custkey",)),
    ("supplier", ("s_suppkey",)),
    ("part", ("p_partkey",)),
    ("orders", ("o_orderkey",)),
    ("lineitem", ("l_orderkey", "l_linenumber")),
    ("events", ("event_id",)),
    ("documents", ("doc_id",)),
    ("embeddings", ("vec_id",)),
    ("pages", ("page_id",)),
    ("benchmark", ("item_id",)),
    ("labels", ("doc_id",)),
    ("conversations", ("conv_id", "turn")),
)


@query("key_uniqueness", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count, count(DISTINCT ({', '.join(keys)})) AS key_count,"
    f" count(*) = count(DISTINCT ({', '.join(keys)})) AS is_unique FROM {name}"
    for name, keys in _KEYS
))
def key_uniqueness(spark, sf_dir):
    """Rows against distinct keys; (l_orderkey, l_linenumber) is the case that fails."""
    checks = [
        key_counts(landing.table(spark, sf_dir, name), keys).select(
            F.lit(name).alias("table_name"), "row_count", "key_count",
            (F.col("row_count") == F.col("key_count")).alias("is_unique"),
        )
        for name, keys in _KEYS
    ]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result


@query("load_uniqueness", "SELECT count(*) AS row_count, count(DISTINCT event_id) AS key_count FROM events")
def load_uniqueness(spark, sf_dir):
    """Rows against keys of a table that was just loaded; the load itself fails if they differ."""
    root = work_dir(spark, "load")
    events = landing.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    write_landing(events, f"{root}/landing/{EVENT_LOG.prefix}", records_per_file=1_000_000)
    target = SnapshotTable(spark, f"{root}/table", EVENT_LOG)
    ingest_batch(spark, target, f"{root}/landing", multiLine="false")
    return key_counts(target.read(), EVENT_LOG.keys)


@query("latest_line_per_part", """
    SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
    QUALIFY row_number() OVER (
        PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1
""")
def latest_line_per_part(spark, sf_dir):
    lines = landing.table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    return latest_rows(lines, ["l_partkey"], "l_shipdate", "l_orderkey", "l_linenumber").drop("l_shipdate")


@query("null_keys_counted", """
    SELECT count(*) AS row_count, count(CASE WHEN event_type <> 'error' THEN event_id END) AS key_count FROM events
""")
def null_keys_counted(spark, sf_dir):
    """A row with a NULL in its key counts as a row but not as a key."""
    events = landing.table(spark, sf_dir, "events")
    holed = events.withColumn("user_id", F.when(F.col("event_type") != "error", F.col("user_id")))
    return key_counts(holed, ["event_id", "user_id"])


@query("latest_per_team", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem
    QUALIFY l_shipdate = max(l_shipdate) OVER (PARTITION BY l_suppkey)
""")
def latest_per_team(spark, sf_dir):
    """All rows of each owner's newest snapshot, ties included."""
    lines = landing.table(spark, sf_dir, "lineitem")
    newest = at_latest_snapshot(lines, "l_suppkey", "l_shipdate")
    return newest.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("current_rosters", """
    SELECT team_id, player_id FROM (
        SELECT CAST(s_suppkey AS VARCHAR) AS team_id, concat(s_suppkey, g.mark, i) AS player_id
        FROM supplier
        CROSS JOIN (VALUES ('offense', '-o'), ('defense', '-d')) AS g(name, mark)
        CROSS JOIN generate_series(1, 4) AS s(i)
        WHERE i <= CASE g.name WHEN 'offense' THEN 2 + s_suppkey % 3 ELSE 2 END)
""")
def current_rosters(spark, sf_dir):
    rosters = parsed(spark, sf_dir, "rosters", "team_id", "player_id", "_snapshot_at")
    return at_latest_snapshot(rosters, "team_id", "_snapshot_at").select("team_id", "player_id")


@query("top_n_per_group", """
    SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS BIGINT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders) WHERE rank <= 3
""")
def top_n(spark, sf_dir):
    orders = landing.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    ranked = top_n_per_group(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


@query("top_n_large", """
    SELECT event_type, event_id, CAST(rank AS BIGINT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
        FROM events) WHERE rank <= 1500
""")
def top_n_large(spark, sf_dir):
    """An n beyond the group limit, with few and large groups."""
    events = landing.table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    ranked = top_n_per_group(events, ["event_type"], [F.col("value").desc(), F.col("event_id")], 1500)
    return ranked.select("event_type", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("preview_latest", """
    SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC LIMIT 20
""")
def preview(spark, sf_dir):
    events = landing.table(spark, sf_dir, "events")
    return preview_latest(events, "ts").select("event_id", "user_id", "event_type")
