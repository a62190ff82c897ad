import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snaplake.functions import scalars as S

NUMBER = re.compile(r"[ \t\n\x0b\f\r]*-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?[ \t\n\x0b\f\r]*")


def model_real(text):
    return float(text) if text is not None and NUMBER.fullmatch(text) else None


def model_whole(text):
    value = model_real(text)
    if value is None or math.isinf(value) or not -(2.0**63) <= value < 2.0**63:
        return None
    return math.trunc(value)


def model_pair(text, separator):
    if text is None:
        return None, None
    parts = [*text.split(separator), None]
    return model_whole(parts[0]), model_whole(parts[1]) if parts[1] is not None else None


def evaluate(spark, values, *makers):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    rows = df.select("i", *(make("v").alias(f"r{n}") for n, make in enumerate(makers))).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


CASES = ["5", "-5", "+5", ".5", "5.", "3.7", "-3.7", "1e3", "1e400", "1,000", "--", "-", "", "\t5\n", None,
         "9223372036854775807", "99999999999999999999", "NaN", "1d", "٣"]


def test_numbers(spark):
    for text, (real, whole) in zip(CASES, evaluate(spark, CASES, S.real, S.whole)):
        assert real == model_real(text), text
        if text != "9223372036854775807":  # rounds up to 2**63 as a DOUBLE
            assert whole == model_whole(text), text


def test_pairs_and_clock(spark):
    texts = ["9-17", "x-y", "3-", "-", "", None, "4", "1-2-3"]
    got = evaluate(spark, texts, lambda c: S.pair(c, "-")[0], lambda c: S.pair(c, "-")[1])
    assert got == [model_pair(t, "-") for t in texts]
    clocks = ["33:42", "bad", "12:", "0:05", None, "9223372036854775807:1"]
    assert evaluate(spark, clocks, S.clock_seconds) == [(2022,), (None,), (None,), (5,), (None,), (None,)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789-+.,eE/: \t", max_size=12), min_size=1, max_size=60))
def test_generated_texts_match_the_model(spark, texts):
    got = evaluate(
        spark, texts, S.real, S.whole, lambda c: S.pair(c, "-")[0], lambda c: S.pair(c, "-")[1],
        lambda c: S.pair(c, "/")[0], lambda c: S.pair(c, "/")[1],
    )
    for text, row in zip(texts, got):
        want = (model_real(text), model_whole(text), *model_pair(text, "-"), *model_pair(text, "/"))
        assert row == want, repr(text)


def test_instants_and_dates(spark):
    def text(make):
        return lambda c: make(c).cast("string")

    texts = ["2026-09-15T00:15Z", "2026-09-15T00:15:30Z", "2026-09-15T02:15+02", "2026-09-15", "x", None]
    got = evaluate(spark, texts, text(S.instant), text(S.leading_date))
    assert [g[0] for g in got] == ["2026-09-15 00:15:00", "2026-09-15 00:15:30", "2026-09-15 00:15:00"] + [None] * 3
    assert [g[1] for g in got] == ["2026-09-15"] * 4 + [None, None]
    zoneless = evaluate(spark, ["2026-10-02 16:05:28", "later"], text(S.zoneless_instant))
    assert zoneless == [("2026-10-02 16:05:28",), (None,)]


@pytest.mark.parametrize("day,season", [("2026-01-31", 2025), ("2026-02-28", 2025), ("2026-03-01", 2026),
                                        ("2026-09-10", 2026), ("2026-12-31", 2026)])
def test_season_year(spark, day, season):
    assert evaluate(spark, [day], lambda c: S.season_year(F.col(c).cast("date"))) == [(season,)]


def test_texts(spark):
    assert evaluate(spark, ["A40227", "", None], S.hex_color) == [("#a40227",), (None,), (None,)]
    assert evaluate(spark, ["  two  words\n", ""], S.words) == [(["two", "words"],), ([],)]
    assert evaluate(spark, ["about -3.5 or 4", "none"], S.first_number) == [(-3.5,), (None,)]
    assert evaluate(spark, [" The answer is the KC. ", "It was 5!"], S.bare_answer) == [("answer KC",), ("It 5",)]
    assert evaluate(spark, ["**KC__ a_b*"], S.without_markdown) == [("kc ab*",)]
    assert evaluate(spark, ["x" * 150], lambda c: F.length(S.excerpt(c))) == [(100,)]
    found = evaluate(spark, ["100% Sure", "100 sure", "a_b"], lambda c: S.contains_text(c, "0% s"),
                     lambda c: S.contains_text(c, "A_B"))
    assert found == [(True, False), (False, False), (False, True)]
    assert S.escape_like(r"50%_\x") == r"50\%\_\\x"
    like = evaluate(spark, ["50%_\\x"], lambda c: F.col(c).like("%" + S.escape_like("%_\\") + "%"))
    assert like == [(True,)]


def test_landing_name(spark):
    got = spark.sql("SELECT TIMESTAMP'2026-10-05 06:00:00.123' AS t").select(S.landing_name("injury", "t")).first()[0]
    assert got == "injury/2026-10-05/2026-10-05T06:00:00.123Z.json"
