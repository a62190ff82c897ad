"""Scalar conversions and nested look-ups over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.functions import nested as N
from snaplake.functions import scalars as S
from snaplake.session import work_dir
from snaplake.workload import landing
from snaplake.workload.parsing import landed
from snaplake.workload.registry import plain, query


@query("conform_orders", """
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_custkey AS customer_id,
        lower(o_orderstatus) AS status, CAST(trunc(o_totalprice) AS BIGINT) AS whole_price,
        strftime(o_orderdate, '%Y-%m-%d') AS order_day,
        lower(trim(concat('  ', o_orderpriority, ' '))) AS priority
    FROM orders
""")
def conform_orders(spark, sf_dir):
    """Rename, cast and trim to a declared layout."""
    orders = landing.table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        S.lowered("o_orderstatus").alias("status"),
        S.whole("o_totalprice").alias("whole_price"),
        S.landing_day("o_orderdate").alias("order_day"),
        S.lowered(S.trimmed(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))).alias("priority"),
    )


@query("safe_numbers", """
    WITH texts AS (
        SELECT event_id, regexp_extract(props, '[0-9]+', 0) AS digits,
            CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS BIGINT) AS n, event_type
        FROM events)
    SELECT event_id,
        CASE event_type WHEN 'view' THEN CAST(n AS DOUBLE) WHEN 'click' THEN -(n + 0.75)
            WHEN 'purchase' THEN n * 100.0 END AS real_value,
        CAST(CASE event_type WHEN 'view' THEN n WHEN 'click' THEN -n WHEN 'purchase' THEN n * 100 END AS BIGINT)
            AS whole_value
    FROM texts
""")
def safe_numbers(spark, sf_dir):
    """Well-formed numbers, and the placeholders and near misses that must become NULL."""
    digits = F.regexp_extract("props", "[0-9]+", 0)
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit(" "), digits, F.lit("\t")))
        .when(F.col("event_type") == "click", F.concat(F.lit("-"), digits, F.lit(".75")))
        .when(F.col("event_type") == "purchase", F.concat(digits, F.lit("e2")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("+"), digits))
        .otherwise(F.concat(digits, F.lit(",000")))
    )
    events = landing.table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return events.select("event_id", S.real("text").alias("real_value"), S.whole("text").alias("whole_value"))


@query("pair_and_clock", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CAST(l_linenumber AS BIGINT) AS made, CAST(l_quantity AS BIGINT) AS tried,
        CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS BIGINT) END AS lone_left,
        CAST(NULL AS BIGINT) AS lone_right,
        CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber * 60 + l_quantity AS BIGINT) END AS clock
    FROM lineitem
""")
def pair_and_clock(spark, sf_dir):
    lines = landing.table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity").cast("int").cast("string")
    number = F.col("l_linenumber").cast("string")
    made, tried = S.pair(F.concat_ws("/", number, quantity), "/")
    left, right = S.pair(
        F.when(F.col("l_returnflag") == "R", F.concat(number, F.lit("-"))).otherwise("x-y"), "-"
    )
    clock = F.when(F.col("l_linestatus") == "O", F.concat_ws(":", number, quantity)).otherwise(
        F.concat(number, F.lit(":"))
    )
    return lines.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        made.alias("made"), tried.alias("tried"),
        left.alias("lone_left"), right.alias("lone_right"),
        S.clock_seconds(clock).alias("clock"),
    )


@query("text_timestamps", """
    SELECT o_orderkey,
        strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS minutes_form,
        CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS seconds_form,
        strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS zoneless,
        strftime(o_orderdate, '%Y-%m-%d') AS day,
        CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 2 THEN 1 ELSE 0 END AS BIGINT) AS season,
        'orders/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || strftime(o_orderdate, '%Y-%m-%d')
            || 'T00:00:00.000Z.json' AS landing_name
    FROM orders
""")
def text_timestamps(spark, sf_dir):
    orders = landing.table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    minutes = F.date_format(day, "yyyy-MM-dd'T'HH:mm'Z'")
    seconds = F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    broken = F.when(F.col("o_orderstatus") == "P", F.concat(seconds, F.lit("?"))).otherwise(seconds)
    df = orders.select(
        "o_orderkey",
        S.instant(minutes).alias("minutes_form"),
        S.instant(broken).alias("seconds_form"),
        S.zoneless_instant(F.date_format(day, "yyyy-MM-dd HH:mm:ss")).alias("zoneless"),
        S.leading_date(minutes).alias("day"),
        S.season_year(day).cast("bigint").alias("season"),
        S.landing_name("orders", day).alias("landing_name"),
    )
    return plain(df)


@query("colors_and_case", """
    SELECT p_partkey, CASE WHEN p_size > 10 THEN '#' || lower(split_part(p_name, ' ', 1)) END AS color,
        lower(p_type) AS type
    FROM part
""")
def colors_and_case(spark, sf_dir):
    part = landing.table(spark, sf_dir, "part")
    first = F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))
    named = F.when(F.col("p_size") > 10, first).otherwise("")
    return part.select("p_partkey", S.hex_color(named).alias("color"), S.lowered("p_type").alias("type"))


@query("text_words", r"""
    SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_words
    FROM documents
""")
def text_words(spark, sf_dir):
    """Blank-separated words of whole texts."""
    documents = landing.table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.size(S.words("text")).cast("bigint").alias("n_words"))


@query("answer_texts", r"""
    SELECT doc_id, TRY_CAST(NULLIF(regexp_extract(text, '-?[0-9]+(?:\.[0-9]+)?', 0), '') AS DOUBLE) AS number,
        CAST(length(regexp_replace(lower(text), '\*\*|_', '', 'g')) AS BIGINT) AS plain_chars,
        md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
            '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'),
            '(?i)(the |is |was |is the |are the )', '', 'g'), '[.,!?]$', ''),
            '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS bare_md5
    FROM documents
""")
def answer_texts(spark, sf_dir):
    """The graders' text functions over whole texts."""
    documents = landing.table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id",
        S.first_number("text").alias("number"),
        F.length(S.without_markdown("text")).cast("bigint").alias("plain_chars"),
        F.md5(S.bare_answer("text")).alias("bare_md5"),
    )


@query("nested_one_level", """
    SELECT CAST(l_orderkey AS VARCHAR) AS game_id, s.side AS home_away,
        CAST(CASE s.side WHEN 'home' THEN l_suppkey % 32
            ELSE (l_suppkey % 32 + 1 + l_partkey % 31) % 32 END AS VARCHAR) AS team_id
    FROM lineitem CROSS JOIN (VALUES ('home'), ('away')) AS s(side)
""")
def nested_one_level(spark, sf_dir):
    records = landing.team_box_records(spark, sf_dir)
    teams = N.unnest(records, "boxscore.teams", "t")
    return teams.select("game_id", F.col("t.homeAway").alias("home_away"), F.col("t.team.id").alias("team_id"))


@query("nested_two_level", """
    SELECT CAST(s_suppkey AS VARCHAR) AS team_id, g.name AS roster_group, concat(s_suppkey, g.mark, i) AS player_id
    FROM supplier
    CROSS JOIN (VALUES ('offense', '-o'), ('defense', '-d')) AS g(name, mark)
    CROSS JOIN generate_series(1, 4) AS s(i)
    WHERE i <= CASE g.name WHEN 'offense' THEN 2 + s_suppkey % 3 ELSE 2 END
""")
def nested_two_level(spark, sf_dir):
    """Group, then item; the group without items adds nothing."""
    groups = N.unnest(landing.roster_responses(spark, sf_dir).select("team", "athletes"), "athletes", "grp")
    players = N.unnest(groups, "grp.items", "p")
    return players.select(
        F.col("team.id").alias("team_id"), F.col("grp.position").alias("roster_group"),
        F.col("p.id").alias("player_id"),
    )


@query("nested_counts", """
    SELECT CAST(s_suppkey AS VARCHAR) AS team_id, CAST(4 + s_suppkey % 3 AS BIGINT) AS players
    FROM supplier
""")
def nested_counts(spark, sf_dir):
    responses = landing.roster_responses(spark, sf_dir)
    return responses.select(F.col("team.id").alias("team_id"), N.nested_size("athletes", "items").alias("players"))


@query("standings_entry_counts", """
    SELECT c_custkey, CAST(1 + c_custkey % 3 AS BIGINT) AS entries FROM customer
""")
def standings_entry_counts(spark, sf_dir):
    """Entries over all conferences of a response, some of them empty and some NULL."""
    responses = landing.standings_responses(spark, sf_dir)
    key = F.split_part("_source_file", F.lit("/"), F.lit(2)).cast("bigint").alias("c_custkey")
    return responses.select(key, N.nested_size("children", "standings.entries").alias("entries"))


_HOME, _AWAY = "(o_custkey % 32)", "((o_custkey + 1 + o_orderkey % 31) % 32)"


@query("first_where_stat", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST({_HOME} AS VARCHAR) AS home_team,
        CAST({_AWAY} AS VARCHAR) AS away_team,
        CAST(CASE WHEN o_orderkey % 2 = 0 THEN {_HOME} ELSE {_AWAY} END AS VARCHAR) AS listed_first,
        CAST({_HOME} AS VARCHAR) AS home_by_predicate
    FROM orders
""")
def first_where_stat(spark, sf_dir):
    """First element, and first element satisfying something, whatever the order."""
    events = landing.schedule_events(spark, sf_dir)
    sides = N.head("competitions")["competitors"]
    return events.select(
        "id",
        N.entry_where(sides, "homeAway", "home")["team"]["id"].alias("home_team"),
        N.entry_where(sides, "homeAway", "away")["team"]["id"].alias("away_team"),
        N.head(sides)["team"]["id"].alias("listed_first"),
        N.first_match(sides, lambda c: c["homeAway"] == "home")["team"]["id"].alias("home_by_predicate"),
    )


@query("named_stats", """
    SELECT concat(c_custkey, '-', i) AS team_id, CAST(c_custkey % 18 + i AS VARCHAR) AS wins,
        CAST(i AS VARCHAR) AS first_division_wins, '99' AS last_division_wins,
        CAST(NULL AS VARCHAR) AS absent
    FROM customer CROSS JOIN generate_series(1, 3) AS s(i) WHERE i <= 1 + c_custkey % 3
""")
def named_stats(spark, sf_dir):
    """A stat by name, first and last of a duplicate, and one that is not listed."""
    conferences = N.unnest(landing.standings_responses(spark, sf_dir).select("children"), "children", "c")
    entries = N.unnest(conferences, "c.standings.entries", "e")
    return entries.select(
        F.col("e.team.id").alias("team_id"),
        N.named_value("e.stats", "wins", "value").alias("wins"),
        N.named_value("e.stats", "divisionWins").alias("first_division_wins"),
        N.last_named_value("e.stats", "divisionWins", "displayValue").alias("last_division_wins"),
        N.named_value("e.stats", "noSuchStat").alias("absent"),
    )


@query("wide_pivot_stats", """
    SELECT concat(c_custkey, '-', i) AS team_id, CAST(c_custkey % 18 + i AS VARCHAR) AS wins,
        CAST(17 - c_custkey % 18 AS VARCHAR) AS losses, '99' AS "divisionWins",
        CAST(c_custkey % 500 - c_nationkey * 10 AS VARCHAR) AS "pointDifferential"
    FROM customer CROSS JOIN generate_series(1, 3) AS s(i) WHERE i <= 1 + c_custkey % 3
""")
def wide_pivot_stats(spark, sf_dir):
    """A name/value list spread to columns found in the data; the last duplicate wins."""
    conferences = N.unnest(landing.standings_responses(spark, sf_dir).select("children"), "children", "c")
    entries = N.unnest(conferences, "c.standings.entries", "e")
    pairs = entries.select(F.col("e.team.id").alias("team_id"), F.col("e.stats").alias("stats"))
    wide = N.spread_pairs(pairs, "stats")
    return wide.select("team_id", "wins", "losses", "divisionWins", "pointDifferential")


@query("variant_stats", """
    SELECT concat(c_custkey, '-', i) AS team_id, CAST(c_custkey % 18 + i AS BIGINT) AS wins,
        CAST(17 - c_custkey % 18 AS VARCHAR) AS losses, '99' AS division_wins,
        CASE WHEN c_custkey % 2 = 1 THEN CAST(17 - c_custkey % 18 + 100 AS VARCHAR) END AS late
    FROM customer CROSS JOIN generate_series(1, 3) AS s(i) WHERE i <= 1 + c_custkey % 3
""")
def variant_stats(spark, sf_dir):
    """Undeclared stats kept as VARIANT in two loads; the second brings one that nobody knew of, and nothing is rewritten."""
    conferences = N.unnest(landing.standings_responses(spark, sf_dir).select("children"), "children", "c")
    entries = N.unnest(conferences, "c.standings.entries", "e")
    pairs = entries.select(F.col("e.team.id").alias("team_id"), F.transform("e.stats", lambda x: F.struct(x["name"], x["value"])).alias("stats"))
    odd = F.split("team_id", "-")[0].cast("bigint") % 2 == 1
    late = F.struct(F.lit("late").alias("name"), (N.last_named_value("stats", "losses", "value").cast("bigint") + 100).cast("string").alias("value"))
    path = work_dir(spark, "variant")
    for load in (pairs.where(~odd), pairs.where(odd).withColumn("stats", F.array_append("stats", late))):
        load.select("team_id", N.pairs_as_variant("stats").alias("stats")).write.mode("append").parquet(path)
    stats = spark.read.schema("team_id STRING, stats VARIANT").parquet(path)
    return stats.select(
        "team_id",
        N.variant_field("stats", "wins", "bigint").alias("wins"),
        *(N.variant_field("stats", name).alias(alias) for name, alias in (("losses", "losses"), ("divisionWins", "division_wins"), ("late", "late"))),
    )


@query("group_entries_pivot", """
    SELECT CAST(l_orderkey AS VARCHAR) AS game_id, w.who AS player_id, w.n_groups AS n_groups,
        w.receptions AS receptions, w.fumbles_lost AS fumbles_lost
    FROM lineitem, LATERAL (VALUES
        (concat('p', l_partkey), CAST(3 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)),
        (concat('s', l_suppkey), CAST(3 AS BIGINT), CAST(l_linenumber AS VARCHAR), CAST(NULL AS VARCHAR)),
        (concat('k', l_partkey % 97), CAST(5 AS BIGINT), '1', CAST(NULL AS VARCHAR))
    ) AS w(who, n_groups, receptions, fumbles_lost)
""")
def group_entries_pivot(spark, sf_dir):
    """Groups by athlete, without a shuffle: each athlete's own entries, then values by key."""
    teams = N.unnest(landing.player_box_records(spark, sf_dir), "boxscore.players", "t")
    entries = teams.select("game_id", N.group_entries("t.statistics").alias("entries"))
    marked = entries.select("game_id", "entries", N.athlete_starts("entries").alias("starts"))
    players = N.unnest(marked, N.entries_by_athlete("entries", "starts"), "player")
    receiving = N.entry_where("player.own", "group", "receiving")
    fumbles = N.entry_where("player.own", "group", "fumbles")
    return players.select(
        "game_id",
        F.col("player.id").alias("player_id"),
        F.size("player.own").cast("bigint").alias("n_groups"),
        N.aligned_value(receiving["keys"], receiving["stats"], "receptions").alias("receptions"),
        N.aligned_value(fumbles["keys"], fumbles["stats"], "fumblesLost").alias("fumbles_lost"),
    )


@query("recursive_flatten", """
    SELECT s_suppkey, l.grp AS "group", 'Conference ' || s_nationkey % 2 AS conference, l.team AS team_id
    FROM supplier, LATERAL (VALUES
        ('Conference ' || s_nationkey % 2, concat(s_suppkey, '-top')),
        ('Division ' || s_nationkey, concat(s_suppkey, '-div')),
        ('Pool ' || s_suppkey, concat(s_suppkey, '-pool'))
    ) AS l(grp, team)
""")
def recursive_flatten(spark, sf_dir):
    """Entries of groups within groups, labelled by their own and their outermost group."""

    def group(name: str, team: str, children: str = "") -> str:
        entries = f"array(named_struct('team', named_struct('id', concat(s_suppkey, '{team}'))))"
        nested = f", 'children', array({children})" if children else ""
        return f"named_struct('name', {name}, 'standings', named_struct('entries', {entries}){nested})"

    pool = group("concat('Pool ', s_suppkey)", "-pool")
    division = group("concat('Division ', s_nationkey)", "-div", pool)
    conference = group("concat('Conference ', s_nationkey % 2)", "-top", division)
    responses = landing.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", f"array({conference}) AS children"
    )
    flat = N.flatten_groups(responses, "children")
    return flat.select("s_suppkey", "group", "conference", F.col("entry.team.id").alias("team_id"))


@query("struct_flatten", """
    SELECT CAST(c_custkey AS VARCHAR) AS "id", CAST(c_custkey % 20 AS BIGINT) AS "experience.years",
        CASE WHEN c_mktsegment <> 'MACHINERY' THEN concat('City ', c_nationkey) END AS "birthPlace.city",
        CASE WHEN c_custkey % 3 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS "hand.type"
    FROM customer
""")
def struct_flatten(spark, sf_dir):
    """Members of nested structs as dotted columns."""
    players = landed(spark, sf_dir, "players").select("id", "experience", "birthPlace", "hand")
    flat = N.flatten_struct(players)
    years = F.col("`experience.years`").cast("bigint").alias("experience.years")
    return flat.select("id", years, "`birthPlace.city`", "`hand.type`")


_LINE = "STRUCT<number: BIGINT, part: STRING, stats: ARRAY<STRUCT<name: STRING, value: STRING, displayValue: STRING>>>"


@query("order_lines_nested", """
    SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS BIGINT) AS number, CAST(l_partkey AS VARCHAR) AS part,
        CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS returned
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def order_lines_nested(spark, sf_dir):
    """Orders with their lines as JSON, nested by a shuffle on the order, parsed and unnested again.

    Arrays are of uneven length, and every second line lacks a stat.
    """
    lines = landing.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", """struct(bigint(l_linenumber) AS number, string(l_partkey) AS part, array_compact(array(
            struct('quantity' AS name, string(bigint(l_quantity)) AS value, string(l_quantity) AS displayValue),
            if(l_linenumber % 2 = 0, struct('returned' AS name, l_returnflag AS value, l_returnflag AS displayValue), NULL))) AS stats) AS line"""
    )
    nested = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    orders = landing.table(spark, sf_dir, "orders").select("o_orderkey")
    payload = nested.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), "lines")).alias("payload")
    )
    parsed_ = payload.select(F.from_json("payload", f"id STRING, lines ARRAY<{_LINE}>").alias("o"))
    each = N.unnest(parsed_.select("o.id", "o.lines"), "lines", "l")
    return each.select(
        F.col("id").alias("order_id"), "l.number", "l.part",
        N.named_value("l.stats", "quantity", "value").cast("bigint").alias("quantity"),
        N.named_value("l.stats", "returned", "value").alias("returned"),
    )
