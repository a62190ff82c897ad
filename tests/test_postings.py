"""The trigram index against a scan of all texts."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from snaplake.plans.postings import NewsIndex, with_runs
from snaplake.plans.search import matching_news
from snaplake.sources.target import SnapshotTable
from snaplake.tables import INJURY_NEWS

NOW = datetime(2026, 10, 6, tzinfo=timezone.utc)
PARTS = ["knee", "O'Neal", "50%", "a_b", "\\\\", "Straße", "日本語", "🙂🙂", "x", "aaa", "aaaa", "%", "Wolf", "wolfgang", " ", "\n"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    make = lambda: rnd.choice([None, "", "ab", "".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 9))), " ".join(rnd.choices(PARTS, k=4))])
    return {i: (make(), make()) for i in range(300)} | {300: ("long " * 30000 + "needle", None)}


def rows(spark, texts, at=NOW):
    made = [(i, t, d, "KC", NOW - timedelta(days=i % 20), at, "f") for i, (t, d) in texts.items()]
    df = spark.createDataFrame(made, "id LONG, title STRING, description STRING, team_id STRING, created_at TIMESTAMP, snapshot_at TIMESTAMP, source_file STRING")
    kinds = {f.name: f.dataType for f in INJURY_NEWS.schema}
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in INJURY_NEWS.columns))


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    root = tmp_path_factory.mktemp("news")
    target = SnapshotTable(spark, str(root / "news"), INJURY_NEWS, buckets=8)
    index = NewsIndex(target, str(root / "index"))
    for part in range(2):
        batch = rows(spark, {i: t for i, t in texts.items() if i % 2 == part})
        target.upsert(batch)
        index.refresh(batch)
    return index


@pytest.mark.parametrize("asked", [
    {"query_text": "knee"}, {"query_text": "KNEE wolf"}, {"query_text": "%"}, {"query_text": "_"}, {"query_text": "50%"}, {"query_text": "a_b"},
    {"query_text": "\\\\"}, {"query_text": "ß"}, {"query_text": "aße"}, {"query_text": "本"}, {"query_text": "日本語"}, {"query_text": "🙂"}, {"query_text": "🙂🙂"},
    {"query_text": "aaaa"}, {"query_text": "ab"}, {"query_text": "wolfgang aaaaaaaa"}, {"query_text": "nowhere"}, {"query_text": ""},
    {"query_text": "needle"}, {"query_text": "ng l"}, {"player": "o'neal"}, {"player": "x k"}, {"player": "knee", "query_text": "wolf"},
    {"query_text": "knee", "team": "kc", "days": 5}, {"query_text": "knee", "team": "TB"},
])
def test_index_finds_what_a_scan_finds(spark, index, asked):
    got = {r.id for r in index.matching(now=F.lit(NOW), **asked).select("id").collect()}
    assert got == {r.id for r in matching_news(index.table.read(), now=F.lit(NOW), **asked).select("id").collect()}


def test_a_changed_article_is_found_by_its_new_words_only(spark, index, texts):
    batch = rows(spark, {7: ("zebra crossing", "okapi")}, NOW + timedelta(days=1))
    before = {p for p in _files(index)}
    index.table.upsert(batch)
    index.refresh(batch)
    assert [r.id for r in index.matching("okapi", now=F.lit(NOW)).collect()] == [7]
    (old,) = [w for w in (texts[7][0] or "").split()[:1]] or ["nowhere"]
    assert 7 not in {r.id for r in index.matching(old, now=F.lit(NOW)).collect()}
    kept = before & set(_files(index))
    assert kept and len({p.split("_bucket=")[1].split("/")[0] for p in before - kept}) == 1  # one bucket was indexed anew
    index.refresh()
    assert [r.id for r in index.matching("okapi", now=F.lit(NOW)).collect()] == [7]


def _files(index):
    from pathlib import Path

    return [str(p) for p in Path(index._postings).rglob("*.parquet")]


def test_buckets_without_candidates_are_not_read(spark, index):
    plan = index.matching("okapi", now=F.lit(NOW))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "description" in line]
    assert scans and all("dynamicpruning" in line for line in scans)


def test_runs_of_three(spark):
    df = spark.createDataFrame([("ABcabc",), ("é日🙂x",), ("ab",), ("",), (None,)], "t STRING")
    assert [r[0] for r in with_runs(df, "t", "runs").select("runs").collect()] == [["abc", "bca", "cab"], ["é日🙂", "日🙂x"], ["ab"], [""], None]


def test_a_new_index_knows_nothing(spark, index, tmp_path):
    assert NewsIndex(index.table, str(tmp_path)).matching("knee", now=F.lit(NOW)).count() == 0


def test_the_service_searches_by_way_of_the_index(spark, index, monkeypatch):
    import snaplake.plans.search as S
    from snaplake.plans.service import QueryService
    from snaplake.sources.catalog import Catalog

    asked = {"query_text": "needle knee", "days": 100_000, "limit": 20}
    plain, indexed = (QueryService(Catalog(spark, {"injury_news": index.table}), i) for i in (None, index))
    want = plain.search_news(**asked)
    assert want["count"] == 20
    monkeypatch.setattr(S, "matching_news", None)
    assert indexed.search_news(**asked) == want


def test_the_runs_of_a_text_are_found_once(spark):
    """Not once more for each filter that an explode brings; NULL and short texts keep their row."""
    df = spark.createDataFrame([("Abcd",), ("a\r\nb",), ("ab",), (None,)], "t STRING").repartition(2)
    told = with_runs(df, "t", "runs")
    plan = told.select(F.explode("runs"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1
    assert sorted(r.runs or [] for r in told.collect()) == [[], ["a\r\n", "\r\nb"], ["ab"], ["abc", "bcd"]]
