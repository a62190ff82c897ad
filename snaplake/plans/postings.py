"""A trigram index over the texts of a news table, so that a search reads the articles it may find and no others.

A posting says that an article's title or description holds a run of three characters (the whole text, if it is
shorter). Postings lie in the article buckets of the table they index, sorted by run, next to a dictionary of how often
each run occurs in the bucket; a load replaces both for the buckets it has touched. A word is looked up by its rarest
runs, a word of one or two characters by all runs that contain it, which the dictionary names. Articles with all the
runs are candidates; they are joined with the table by bucket, where Spark prunes the buckets that have none, and
held against the word itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.plans.search import DEFAULT_DAYS, matching_news
from snaplake.sources.files import Folder
from snaplake.sources.target import BUCKET, SnapshotTable

RUN = 3
EVERY_RUN = f"(?s)(?=(.{{{RUN}}}))."  # a dot is a whole character here, also one of two UTF-16 units or a line end
LOOKED_UP = 10  # runs of a word that are considered: a list of so many is pushed into the scan
RAREST = 3  # of these the postings are read


def with_runs(texts: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the distinct runs of three characters in lower case; of a shorter text the text itself.

    One expression walks the text: it looks three characters ahead and takes one, so no array of single characters is
    made. A generator of one row brings the runs: as a mere expression they would be found again by each of the filters
    that Spark derives from an explode.
    """

    def of(lower: Column) -> Column:
        runs = F.array_distinct(F.regexp_extract_all(lower, F.lit(EVERY_RUN), F.lit(1)))
        return F.when(F.length(lower) < RUN, F.array(lower)).otherwise(runs)

    return texts.select("*", F.explode(F.transform(F.array(F.lower(text)), of)).alias(name))


class NewsIndex:
    """``table`` holds articles with title and description; the index lies at ``path``."""

    def __init__(self, table: SnapshotTable, path: str):
        self.table = table
        self.spark = table.spark
        (self.key,) = table.keys
        self._root = path.rstrip("/")
        self._postings, self._runs = f"{self._root}/postings", f"{self._root}/runs"
        self._key_kind = table.schema[self.key].dataType.simpleString()

    def refresh(self, batch: DataFrame | None = None) -> None:
        """Index what the table holds now, in the buckets of the batch's keys or in all."""
        rows = self.table.placed()
        if batch is not None:
            touched = self.table.with_bucket(batch.select(self.key)).select(BUCKET).distinct().where(F.col(BUCKET) >= 0)
            rows = rows.join(touched, BUCKET, "left_semi")
        texts = F.array(*(F.struct(F.lit(c == "title").alias("in_title"), F.col(c).alias("text")) for c in ("title", "description")))
        told = rows.select(BUCKET, self.key, F.explode(texts).alias("t"))
        told = with_runs(told.select(BUCKET, self.key, "t.*"), "text", "runs")
        postings = told.select(BUCKET, self.key, "in_title", F.explode("runs").alias("run"))
        self._write(postings, self._postings)
        held = self._read(self._postings)
        if batch is not None:
            held = held.join(touched, BUCKET, "left_semi")
        self._write(held.groupBy(BUCKET, "run").agg(F.count(F.lit(1)).alias("n")), self._runs)

    def _write(self, rows: DataFrame, path: str) -> None:
        laid = rows.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, "run")
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)

    def _read(self, path: str) -> DataFrame:
        rest = "n BIGINT" if path == self._runs else f"{self.key} {self._key_kind}, in_title BOOLEAN"
        kinds = f"run STRING, {rest}, {BUCKET} INT"
        if not Folder(self.spark, self._root).holds(path.rpartition("/")[2]):
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(path)

    def candidates(self, word: str, titles_only: bool = False) -> DataFrame:
        """(bucket, key) of all articles that may contain the word, and of few others."""
        postings = self._read(self._postings)
        if titles_only:
            postings = postings.where("in_title")
        place = [BUCKET, self.key]
        given = self.spark.createDataFrame([(word,)], "word STRING")
        length, runs = with_runs(given, "word", "runs").select(F.length(F.lower("word")), "runs").first()
        if length < RUN:
            around = self._read(self._runs).where(F.col("run").contains(F.lower(F.lit(word)))).select("run").distinct()
            return postings.join(around, "run", "left_semi").select(*place).distinct()
        step = -(-len(runs) // LOOKED_UP)
        runs = runs[::step]
        counts = self._read(self._runs).where(F.col("run").isin(runs)).groupBy("run").agg(F.sum("n").alias("n"))
        known = {r.run: r.n for r in counts.collect()}  # as many rows as are looked up
        if len(known) < len(runs):
            return postings.select(*place).where(F.lit(False))
        rare = sorted(runs, key=lambda run: (known[run], run))[:RAREST]
        found = postings.where(F.col("run").isin(rare)).groupBy(*place, "in_title").agg(F.count(F.lit(1)).alias("n"))
        return found.where(F.col("n") == len(rare)).select(*place).distinct()

    def matching(self, query_text: str = "", player: str = "", team: str = "", days: int = DEFAULT_DAYS,
                 now: Column | None = None, teams: DataFrame | None = None) -> DataFrame:
        """The articles that ``matching_news`` finds in the table, by way of the index."""
        rows = self.table.placed()
        wanted = []
        if words := query_text.split():
            wanted.append(reduce(DataFrame.union, (self.candidates(w) for w in words)).distinct())
        if player:
            wanted.append(self.candidates(player, titles_only=True))
        for found in wanted:
            # every bucket is 0 or more: a join prunes partitions only by a side that has a filter
            rows = rows.join(found.where(F.col(BUCKET) >= 0), [BUCKET, self.key], "left_semi")
        news = rows.select(*self.table.schema.fieldNames())
        return matching_news(news, query_text=query_text, player=player, team=team, days=days, now=now, teams=teams)
