"""Landing records in the feed's own shapes, derived by Spark from the given tables.

Every record is built from one row (map-only), so nothing is collected per group however skewed
the tables are. The payloads carry what the parsers must cope with: placeholders, malformed
texts, duplicate stats, short arrays, empty groups, either side first, missing structs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.sources.files import Folder

# Source bytes a task: its records, taken apart into rows of some hundred bytes, are sorted in memory.
TEAM_BOX_BYTES, PLAYER_BOX_BYTES = 2 << 20, 1 << 20

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows that landing records are made of, dealt out anew.

    A record is many times as large as its row, so the splits of the files say little about the work, and few
    large splits would keep few cores busy.
    """
    rows = table(spark, sf_dir, name)
    return rows.repartition(*rows.columns[:2])  # the key and what tells its rows apart


def game_tasks(spark: SparkSession, sf_dir: str, task_bytes: int = TEAM_BOX_BYTES) -> int:
    """Into how many tasks the records of games are dealt: more as the source grows, one for each core at least."""
    size = Folder(spark, f"{sf_dir}/lineitem.parquet").size()
    return max(spark.sparkContext.defaultParallelism, -(-size // task_bytes))


def records_by_game(spark: SparkSession, sf_dir: str, name: str, game: str, tasks: int) -> DataFrame:
    """The same rows dealt out by game, in ``game_id``, while they are still small.

    All versions of a game's rows then come out of one task, and neither the newest of them nor a layout by game needs
    another shuffle, of rows that are twenty times as large. A game with very many records stays in one task.
    """
    rows = table(spark, sf_dir, name)
    dealt = rows.withColumn("game_id", F.col(game).cast("string")).drop(game).repartition(tasks, "game_id")
    return dealt.withColumn(game, F.col("game_id").cast(rows.schema[game].dataType))


def _stat(name: str, value: str, display: str) -> str:
    return f"named_struct('name', '{name}', 'value', {value}, 'displayValue', {display})"


def _count(name: str, number: str) -> str:
    """A stat whose value and display text are the same count."""
    return _stat(name, f"string({number})", f"string({number})")


def _array(*items: str) -> str:
    return f"array({', '.join(items)})"


def _team(team_id: str, prefix: str = "Team") -> str:
    return (
        f"named_struct('id', string({team_id}), 'abbreviation', concat('T', {team_id}),"
        f" 'displayName', concat('{prefix} ', {team_id}))"
    )


# ---- teams: one response per supplier ---------------------------------------------------


def team_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    team = """named_struct(
        'id', string(s_suppkey), 'uid', concat('s:20~t:', s_suppkey),
        'slug', replace(lower(s_name), '#', '-'), 'abbreviation', concat('T', s_suppkey),
        'location', concat('City ', s_nationkey), 'name', concat('Name ', s_suppkey),
        'nickname', s_name, 'displayName', s_name, 'shortDisplayName', concat('S', s_suppkey),
        'color', if(s_nationkey = 0, '', upper(lpad(hex(s_suppkey), 6, '0'))),
        'alternateColor', if(s_nationkey = 1, null, 'FFffFF'),
        'isActive', s_acctbal >= 0,
        'logos', array(named_struct('href', concat('http://x/', s_suppkey))),
        'links', array('a', 'b'))"""
    return records(spark, sf_dir, "supplier").selectExpr(
        f"array(named_struct('leagues', array(named_struct('teams', array("
        f"named_struct('team', {team})))))) AS sports",
        "concat('supplier/', s_suppkey) AS _source_file",
        "TIMESTAMP'2024-01-01 00:00:00' AS _snapshot_at",
    )


# ---- players: one page per customer -----------------------------------------------------


def player_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    birth = """CASE c_nationkey % 4
        WHEN 0 THEN concat(1960 + c_custkey % 40, '-0', 1 + c_custkey % 9, '-1', c_custkey % 9, 'T08:00Z')
        WHEN 1 THEN concat(1960 + c_custkey % 40, '-13-01T08:00Z')
        WHEN 2 THEN 'unknown'
        ELSE NULL END"""
    place = """IF(c_mktsegment = 'MACHINERY', NULL, named_struct(
        'city', concat('City ', c_nationkey), 'state', concat('S', c_nationkey),
        'country', IF(c_nationkey < 12, 'USA', NULL)))"""
    athlete = f"""named_struct(
        'id', string(c_custkey), 'uid', concat('a:', c_custkey), 'guid', md5(c_name),
        'firstName', split_part(c_name, '#', 1), 'lastName', split_part(c_name, '#', 2),
        'fullName', c_name, 'displayName', c_name, 'shortName', substr(c_name, 1, 1),
        'jersey', IF(c_custkey % 5 = 0, NULL, string(c_custkey % 100)),
        'height', double(60 + c_custkey % 20) + 0.5D, 'weight', c_acctbal,
        'age', int(20 + c_custkey % 20), 'dateOfBirth', {birth}, 'birthPlace', {place},
        'experience', named_struct('years', int(c_custkey % 20)),
        'hand', named_struct('type', IF(c_custkey % 3 = 0, 'LEFT', 'RIGHT')),
        'active', c_acctbal > 0, 'links', array('a'))"""
    return records(spark, sf_dir, "customer").selectExpr(
        f"array({athlete}) AS items",
        "concat('customer/', c_custkey) AS _source_file",
        "TIMESTAMP'2024-01-01 00:00:00' AS _snapshot_at",
    )


# ---- rosters: one response per supplier -------------------------------------------------


def roster_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    def group(position: str, many: str, offset: str) -> str:
        player = f"""named_struct(
            'id', concat(s_suppkey, '{offset}', i), 'fullName', concat(s_name, ' ', i),
            'jersey', string(i), 'age', int(20 + i), 'height', double(70 + i),
            'weight', IF(i = 2, CAST(NULL AS DOUBLE), double(200) + i / 4),
            'experience', IF(i = 1, NULL, named_struct('years', int(i))),
            'college', named_struct('name', concat('College ', s_nationkey)),
            'position', named_struct('abbreviation', upper(substr('{position}', 1, 2)), 'name', '{position}'),
            'status', named_struct('name', IF(s_acctbal < 0, 'Inactive', 'Active')),
            'headshot', named_struct('href', 'x'), 'links', array('y'))"""
        return f"named_struct('position', '{position}', 'items', transform({many}, i -> {player}))"

    groups = _array(
        group("offense", "sequence(1, int(2 + s_suppkey % 3))", "-o"),
        group("defense", "sequence(1, 2)", "-d"),
        group("suspended", "filter(sequence(1, 1), x -> x > 1)", "-s"),
    )
    return records(spark, sf_dir, "supplier").selectExpr(
        "named_struct('year', int(2015 + s_nationkey % 10), 'type', int(2)) AS season",
        f"named_struct('id', string(s_suppkey), 'abbreviation', concat('T', s_suppkey),"
        f" 'displayName', s_name, 'links', array('z')) AS team",
        f"{groups} AS athletes",
        "concat('supplier/', s_suppkey) AS _source_file",
        "timestamp_seconds(1700000000 + s_suppkey) AS _snapshot_at",
    )


# ---- standings: one response per customer -----------------------------------------------


def standings_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _array(
        _count("wins", "c_custkey % 18 + i"),
        _count("losses", "17 - c_custkey % 18"),
        _stat("ties", "IF(c_nationkey = 3, '-', '0')", "'0'"),
        _stat("winPercent", "string((c_custkey % 18) / 16)", "'.5'"),
        _stat("pointsFor", "concat(c_custkey % 500, '.0')", "string(c_custkey % 500)"),
        _count("pointsAgainst", "c_nationkey * 10"),
        _stat("pointDifferential", "string(c_custkey % 500 - c_nationkey * 10)",
              "concat('+', c_custkey % 500)"),
        _stat("gamesBehind", "IF(c_custkey % 4 = 0, '0', string((c_custkey % 4) / 2))",
              "IF(c_custkey % 4 = 0, '-', 'x')"),
        _stat("playoffSeed", "IF(c_mktsegment = 'FURNITURE', '--', string(c_custkey % 16 + 1))", "'1'"),
        _stat("streak", "'1'", "concat(IF(c_acctbal < 0, 'L', 'W'), c_custkey % 6)"),
        _count("divisionWins", "i"),
        _count("divisionWins", "99"),
        _count("divisionLosses", "c_nationkey % 6"),
        _stat("overall", "'x'", "concat(c_custkey % 18 + i, '-', 17 - c_custkey % 18)"),
        _stat("Home", "'x'", "concat(c_custkey % 9, '-', c_nationkey % 9)"),
        _stat("Road", "'x'", "concat(c_nationkey % 9, '-', c_custkey % 9)"),
        _stat("vs. Div.", "'x'", "concat(i, '-', c_nationkey % 6)"),
        _stat("vs. Conf.", "'x'", "concat(c_custkey % 12, '-', i)"),
    )
    entry = f"""named_struct('team', named_struct(
        'id', concat(c_custkey, '-', i), 'abbreviation', concat('T', c_custkey, '-', i),
        'displayName', c_name, 'logos', array('l'), 'links', array('l')), 'stats', {stats})"""

    def child(name: str, ids: str) -> str:
        return (
            f"named_struct('id', '{name}', 'name', '{name} conference', 'abbreviation', '{name}',"
            f" 'standings', named_struct('season', int(2015 + c_custkey % 10),"
            f" 'seasonType', int(2 + c_custkey % 2), 'entries', transform({ids}, i -> {entry})))"
        )

    ids = "sequence(1, int(1 + c_custkey % 3))"
    return records(spark, sf_dir, "customer").selectExpr(
        "named_struct('year', int(2015 + c_custkey % 10)) AS season",
        _array(
            child("AFC", f"IF(c_nationkey % 2 = 0, {ids}, filter({ids}, x -> x < 0))"),
            child("NFC", f"IF(c_nationkey % 2 = 1, {ids}, CAST(NULL AS ARRAY<INT>))"),
        ) + " AS children",
        "concat('customer/', c_custkey) AS _source_file",
        "TIMESTAMP'2024-01-01 00:00:00' AS _snapshot_at",
    )


# ---- schedules: one event per order -----------------------------------------------------

STATE = "CASE o_orderstatus WHEN 'F' THEN 'post' WHEN 'P' THEN 'in' ELSE 'pre' END"
STATUS_NAME = (
    "CASE o_orderstatus WHEN 'F' THEN 'STATUS_FINAL' WHEN 'P' THEN 'STATUS_IN_PROGRESS'"
    " ELSE 'STATUS_SCHEDULED' END"
)
HOME, AWAY = "(o_custkey % 32)", "((o_custkey + 1 + o_orderkey % 31) % 32)"
HOME_SCORE, AWAY_SCORE = "(floor(o_totalprice) % 50)", "(floor(o_totalprice / 50) % 45)"
KICKOFF = "date_format(o_orderdate, \"yyyy-MM-dd'T'\")"


def schedule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(name: str, team: str, score: str) -> str:
        return (
            f"named_struct('homeAway', '{name}', 'team', {_team(team)},"
            f" 'score', IF(o_orderpriority = '5-LOW', NULL, named_struct('value', double({score}),"
            f" 'displayValue', string({score}))), 'leaders', array('l'), 'record', array('r'),"
            f" 'curatedRank', named_struct('current', 1))"
        )

    home, away = side("home", HOME, HOME_SCORE), side("away", AWAY, AWAY_SCORE)
    competition = f"""named_struct(
        'date', CASE o_orderpriority WHEN '5-LOW' THEN NULL
            WHEN '4-NOT SPECIFIED' THEN concat({KICKOFF}, '20:25:30Z')
            WHEN '3-MEDIUM' THEN 'to be decided' ELSE concat({KICKOFF}, '18:00Z') END,
        'neutralSite', o_orderpriority = '1-URGENT',
        'venue', IF(o_orderpriority = '2-HIGH', NULL, named_struct('fullName', concat('Stadium ', {HOME}),
            'address', named_struct('city', concat('City ', {HOME}), 'state', concat('S', {HOME} % 10)))),
        'status', named_struct('type', named_struct('name', {STATUS_NAME}, 'state', {STATE},
            'completed', o_orderstatus = 'F', 'detail', concat('detail ', o_orderstatus))),
        'competitors', IF(o_orderkey % 2 = 0, array({home}, {away}), array({away}, {home})),
        'broadcasts', array('tv'), 'notes', array('n'), 'tickets', array('t'),
        'ticketsAvailable', true)"""
    return records(spark, sf_dir, "orders").selectExpr(
        "string(o_orderkey) AS id",
        f"concat({KICKOFF}, '12:00Z') AS date",
        "named_struct('year', int(year(o_orderdate) - IF(month(o_orderdate) <= 2, 1, 0))) AS season",
        "named_struct('type', int(1 + o_custkey % 3)) AS seasonType",
        "named_struct('number', int(month(o_orderdate))) AS week",
        f"array({competition}) AS competitions",
        "array('link') AS links",
        "concat('orders/', o_orderkey) AS _source_file",
        "timestamp(o_orderdate) AS _snapshot_at",
        "o_orderkey AS position",
    )


# ---- game summaries: header from orders, box score from lineitem ------------------------


def game_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary per order: header, venue and attendance; the box score is empty."""

    def side(name: str, team: str, score: str) -> str:
        return (
            f"named_struct('id', 'c', 'homeAway', '{name}', 'winner', true,"
            f" 'score', IF(o_orderstatus = 'O', '--', string({score})), 'team', {_team(team)},"
            f" 'linescores', array(1))"
        )

    home, away = side("home", HOME, HOME_SCORE), side("away", AWAY, AWAY_SCORE)
    competition = f"""named_struct('id', string(o_orderkey),
        'date', concat({KICKOFF}, lpad(string(o_custkey % 24), 2, '0'), ':30Z'),
        'neutralSite', o_orderpriority = '1-URGENT',
        'status', named_struct('type', named_struct('name', {STATUS_NAME}, 'state', {STATE},
            'completed', o_orderstatus = 'F', 'detail', concat('detail ', o_orderstatus))),
        'competitors', IF(o_orderkey % 2 = 0, array({home}, {away}), array({away}, {home})))"""
    season = """named_struct('year', int(year(o_orderdate) - IF(month(o_orderdate) <= 2, 1, 0)),
        'type', int(1 + o_custkey % 3))"""
    rows = records_by_game(spark, sf_dir, "orders", "o_orderkey", game_tasks(spark, sf_dir))
    return rows.selectExpr(
        "game_id",
        f"named_struct('id', string(o_orderkey), 'season', {season},"
        f" 'week', int(month(o_orderdate)), 'competitions', array({competition})) AS header",
        f"named_struct('venue', IF(o_orderpriority = '2-HIGH', NULL, named_struct("
        f" 'fullName', concat('Stadium ', {HOME}), 'address', named_struct('city', concat('City ', {HOME}),"
        f" 'state', concat('S', {HOME} % 10)), 'images', array('i'))),"
        f" 'attendance', o_custkey * 10) AS gameInfo",
        "from_json('{}', 'teams ARRAY<STRUCT<homeAway:STRING,"
        " team:STRUCT<id:STRING,abbreviation:STRING,displayName:STRING>,"
        " statistics:ARRAY<STRUCT<name:STRING,value:STRING,displayValue:STRING>>>>,"
        " players ARRAY<STRUCT<team:STRUCT<id:STRING,abbreviation:STRING,displayName:STRING>,"
        " statistics:ARRAY<STRUCT<name:STRING,keys:ARRAY<STRING>,athletes:ARRAY<STRUCT<"
        " athlete:STRUCT<id:STRING,displayName:STRING,jersey:STRING>,stats:ARRAY<STRING>>>>>>>')"
        " AS boxscore",
        "concat('orders/', o_orderkey) AS _source_file",
        "timestamp(o_orderdate) AS _snapshot_at",
    )


BOX_HOME, BOX_AWAY = "(l_suppkey % 32)", "((l_suppkey % 32 + 1 + l_partkey % 31) % 32)"
LINE_FILE = "concat_ws('-', 'line', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd'))"


def _line_header() -> str:
    return (
        "named_struct('season', named_struct("
        "'year', int(year(l_shipdate) - IF(month(l_shipdate) <= 2, 1, 0)),"
        " 'type', int(1 + l_orderkey % 3)), 'week', int(month(l_shipdate))) AS header"
    )


def team_box_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game summary per line item with the statistics of both teams."""
    n, q = "l_linenumber", "int(l_quantity)"

    def side(name: str, team: str, k: int) -> str:
        always = _array(
            _count("firstDowns", f"{q} % 30 + {k}"),
            _count("firstDownsPassing", n),
            _count("firstDownsRushing", f"{n} + {k}"),
            _stat("firstDownsPenalty", "'-'", f"IF({n} = 7, '-', '1')"),
            _stat("thirdDownEff", f"string({n} / 16)", f"concat({n}, '-', {n} + 5)"),
            _stat("fourthDownEff", "'0'", f"IF({n} = 1, '1-', concat('0-', {n}))"),
            _count("totalOffensivePlays", f"{q} + 20"),
            _stat("totalYards", "'-'", f"string({q} * 7 + {k})"),
            _stat("yardsPerPlay", "string(l_discount)", "'3.7'"),
            _count("totalDrives", f"{n} + 8"),
            _count("netPassingYards", f"{q} * 3"),
            _stat("completionAttempts", "'-'", f"concat({q}, '/', {q} + 10)"),
            _stat("yardsPerPass", "string(l_tax)", "'5.9'"),
            _count("interceptions", f"{n} % 3"),
            _stat("sacksYardsLost", "'-'", f"concat({n} % 4, '-', {q})"),
            _count("rushingYards", f"{q} * 2 - 20"),
            _count("rushingAttempts", f"{n} + 15"),
            _stat("yardsPerRushAttempt", "IF(l_returnflag = 'N', '--', string(l_quantity))", "'4.1'"),
            _stat("redZoneAttempts", "'0.5'", f"concat({n} % 3, '-', {n})"),
            _stat("totalPenaltiesYards", "'-'", f"concat({n}, '-', {n} * 5)"),
            _stat("turnovers", "'-'", f"string({n} % 5)"),
            _count("defensiveTouchdowns", str(k)),
            _stat("possessionTime", "'0'",
                  f"IF(l_linestatus = 'O' AND {n} = 3, 'bad', concat({q}, ':', lpad(string({n} * 7), 2, '0')))"),
            _count("interceptions", "9"),
        )
        sometimes = f"IF(l_returnflag = 'R', array(), {_array(_count('fumblesLost', f'{n} % 2'))})"
        return (
            f"named_struct('homeAway', '{name}', 'team', {_team(team)},"
            f" 'statistics', concat({always}, {sometimes}))"
        )

    teams = _array(side("away", BOX_AWAY, 0), side("home", BOX_HOME, 1))
    rows = records_by_game(spark, sf_dir, "lineitem", "l_orderkey", game_tasks(spark, sf_dir))
    return rows.selectExpr(
        "game_id",
        f"named_struct('teams', {teams}) AS boxscore",
        f"{LINE_FILE} AS _source_file",
        "timestamp(l_shipdate) AS _snapshot_at",
    )


# The names the feed gives to the stats of each group.
STAT_KEYS = {
    "passing": (
        "completions/passingAttempts", "passingYards", "yardsPerPassAttempt", "passingTouchdowns",
        "interceptions", "sacks-sackYardsLost", "adjQBR", "QBRating",
    ),
    "rushing": (
        "rushingAttempts", "rushingYards", "yardsPerRushAttempt", "rushingTouchdowns",
        "longRushing",
    ),
    "fumbles": (
        "fumbles", "fumblesLost", "fumblesRecovered",
    ),
    "receiving": (
        "receptions", "receivingYards", "yardsPerReception", "receivingTouchdowns", "longReception",
        "receivingTargets",
    ),
    "defensive": (
        "totalTackles", "soloTackles", "sacks", "tacklesForLoss", "passesDefended", "QBHits",
        "defensiveTouchdowns",
    ),
    "interceptions": (
        "interceptions", "interceptionYards", "interceptionTouchdowns",
    ),
    "kickReturns": (
        "kickReturns", "kickReturnYards", "yardsPerKickReturn", "longKickReturn",
        "kickReturnTouchdowns",
    ),
    "puntReturns": (
        "puntReturns", "puntReturnYards", "yardsPerPuntReturn", "longPuntReturn",
        "puntReturnTouchdowns",
    ),
    "kicking": (
        "fieldGoalsMade/fieldGoalAttempts", "fieldGoalPct", "longFieldGoalMade",
        "extraPointsMade/extraPointAttempts", "totalKickingPoints",
    ),
    "punting": (
        "punts", "puntYards", "grossAvgPuntYards", "touchbacks", "puntsInside20", "longPunt",
    ),
}


def player_box_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game summary per line item with two teams and three players.

    The passer (``p<part>``) is on the away team; the receiver (``s<supplier>``) and the kicker
    (``k<part mod 97>``) are on the home team.
    """
    n, q = "l_linenumber", "int(l_quantity)"

    def athlete(who: str, *stats: str) -> str:
        texts = _array(*(f"string({s})" for s in stats))
        return (
            f"named_struct('athlete', named_struct('id', {who}, 'displayName', concat('Player ', {who}),"
            f" 'jersey', string({n})), 'stats', {texts})"
        )

    def group(name: str, *athletes: str) -> str:
        names = _array(*(f"'{k}'" for k in STAT_KEYS[name]))
        return f"named_struct('name', '{name}', 'keys', {names}, 'athletes', {_array(*athletes)})"

    passer, receiver, kicker = (
        "concat('p', l_partkey)", "concat('s', l_suppkey)", "concat('k', l_partkey % 97)",
    )
    away = _array(
        group(
            "passing",
            athlete(passer, f"concat({q}, '/', {q} + 9)", f"{q} * 8", "'4.7'", f"{n} % 4", f"{n} % 3",
                    f"concat({n}, '-', {q})", "IF(l_returnflag = 'A', '--', string(l_quantity))", "l_tax"),
        ),
        group(
            "rushing",
            athlete(passer, n, f"{q} - 10", "'3.0'", f"{n} % 2", q),
        ),
        # The array ends early: the last two keys have no value.
        group("fumbles", athlete(passer, f"{n} % 2")),
    )
    home = _array(
        group(
            "receiving",
            athlete(receiver, n, f"{q} * 4", "'9.9'", f"{n} % 3", q, f"{n} + 4"),
            athlete(kicker, "1", f"{q}", "'2.0'", "0", q, "2"),
        ),
        group(
            "defensive",
            athlete(receiver, f"{n} + 3", n, f"concat({n} % 3, '.5')", "l_discount", f"{n} % 2", "''", "0"),
        ),
        group("interceptions",
              athlete(receiver, f"{n} % 2", q, "0")),
        group("kickReturns",
              athlete(kicker, n, f"{q} + 5", "'20.0'", q, f"{n} % 2")),
        group("puntReturns",
              athlete(kicker, "2", "'-'", "'3.5'", "7", "0")),
        group(
            "kicking",
            athlete(kicker, f"concat({n} % 3, '/', {n})", "'100.0'", q, "'4/4'", f"{n} % 3 * 3 + 4"),
        ),
        group("punting",
              athlete(kicker, f"{n} % 6", f"{q} * 9", "'44.1'", "0", f"{n} % 3", "50")),
    )
    players = _array(
        f"named_struct('team', {_team(BOX_AWAY)}, 'statistics', {away})",
        f"named_struct('team', {_team(BOX_HOME)}, 'statistics', {home})",
    )
    rows = records_by_game(spark, sf_dir, "lineitem", "l_orderkey", game_tasks(spark, sf_dir, PLAYER_BOX_BYTES))
    return rows.selectExpr(
        "game_id",
        _line_header(),
        f"named_struct('players', {players}) AS boxscore",
        f"{LINE_FILE} AS _source_file",
        "timestamp(l_shipdate) AS _snapshot_at",
    )


# ---- news: one payload per document -----------------------------------------------------


def news_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = """named_struct(
        'id', doc_id,
        'created', IF(source = 'src13', 'soon', date_format(
            timestamp_seconds(1704067200 + doc_id * 600), 'yyyy-MM-dd HH:mm:ss')),
        'created_formated', 'x', 'author', concat('author ', lang), 'player_id', doc_id % 50,
        'team_id', upper(source), 'title', concat(' ', lang, ' report from ', source, ' '),
        'sport_id', 'NFL', 'categories', array(lang, source),
        'link', concat('https://x/', doc_id), 'desc', text,
        'impact', concat('  ', n_chars, ' characters '))"""
    return records(spark, sf_dir, "documents").selectExpr(
        "'NFL' AS sport", "'news' AS title", "bigint(1) AS count",
        f"array({item}) AS items",
        "concat('documents/', doc_id) AS _source_file",
        "TIMESTAMP'2024-02-01 00:00:00' AS _snapshot_at",
    )
