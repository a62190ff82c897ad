"""Keyword search over news with a recency window."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.functions.scalars import contains_text

MAX_ARTICLES = 20  # fixed values: most articles, default number and default window of a search
DEFAULT_ARTICLES = 8
DEFAULT_DAYS = 14

RESULT_COLUMNS = ("created_at", "title", "description", "impact", "player_id", "team_id", "link")


def matching_news(
    news: DataFrame,
    query_text: str = "",
    player: str = "",
    team: str = "",
    days: int = DEFAULT_DAYS,
    now: Column | None = None,
    teams: DataFrame | None = None,
) -> DataFrame:
    """All articles of the window that satisfy every given filter.

    Any word of ``query_text`` may occur in the title or the description; ``player`` occurs in the
    title. ``team`` is an abbreviation; with a ``teams`` table it may also be part of a team's name.
    """
    since = (F.current_timestamp() if now is None else now) - F.make_dt_interval(days=F.lit(max(1, days)))
    news = news.filter(F.col("created_at") >= since)
    tokens = query_text.split()
    if tokens:
        hits = (contains_text("title", t) | contains_text("description", t) for t in tokens)
        news = news.filter(reduce(or_, hits))
    if player:
        news = news.filter(contains_text("title", player))
    if team and teams is None:
        news = news.filter(F.col("team_id") == team.upper())
    elif team:
        named = teams.filter(
            (F.col("abbreviation") == team.upper()) | contains_text("display_name", team)
        ).select(F.col("abbreviation").alias("team_id"))
        news = news.join(named, "team_id", "left_semi")
    return news


def search_news(news: DataFrame, *, limit: int = DEFAULT_ARTICLES, **filters) -> DataFrame:
    """The newest matching articles; ``limit`` is held between 1 and 20."""
    articles = matching_news(news, **filters)
    newest = articles.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return newest.limit(max(1, min(limit, MAX_ARTICLES))).select(*RESULT_COLUMNS)


def search_envelope(news: DataFrame, *, limit: int = DEFAULT_ARTICLES, index=None, **filters) -> dict:
    """The search as a plain dict; what Spark refuses or fails at is reported in it rather than raised.

    With an ``index`` of the news (``postings.NewsIndex``) the articles are found by way of it.
    """
    asked = {k: filters.get(k, "") for k in ("query_text", "player", "team")}
    envelope = {"query": asked["query_text"], "player": asked["player"], "team": asked["team"]}
    cap = max(1, min(limit, MAX_ARTICLES))
    try:
        matching = index.matching(**filters) if index else matching_news(news, **filters)
        ordered = matching.orderBy(F.col("created_at").desc(), F.col("id").desc())
        found = ordered.select(*RESULT_COLUMNS).limit(cap + 1).collect()
    except PySparkException as error:
        return {"error": f"query failed: {error}", **envelope}
    results = [row.asDict() for row in found[:cap]]
    for result in results:
        if result["created_at"] is not None:
            result["created_at"] = result["created_at"].isoformat()
    return {
        **envelope,
        "days": filters.get("days", DEFAULT_DAYS),
        "results": results,
        "count": len(results),
        "truncated": len(found) > cap,
    }


def news_with_team(news: DataFrame, teams: DataFrame) -> DataFrame:
    """Articles with the team they are about; the feeds share the abbreviation, not the id.

    Of several teams with one abbreviation the one with the least id counts, so no article is doubled.
    """
    team = F.min(F.struct("team_id", "display_name"))
    about = teams.groupBy(F.col("abbreviation").alias("_abbreviation")).agg(team.alias("_team")).select(
        "_abbreviation", F.col("_team.team_id").alias("feed_team_id"), F.col("_team.display_name").alias("team_name")
    )
    return news.join(about, F.col("team_id") == F.col("_abbreviation")).drop("_abbreviation")


def title_mentions(news: DataFrame, text: str) -> DataFrame:
    """Articles naming somebody in the title, as the feeds share no player id either."""
    return news.filter(contains_text("title", text))
