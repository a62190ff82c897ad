"""Grading answers against expected values, and rolling the grades up."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.functions.scalars import as_column, first_number, stripped, without_markdown

# What counts as a refusal, and how far a number may be off.
REFUSAL_PHRASES = (
    "don't have", "no data", "not available", "not in", "unable to",
    "cannot", "don't track", "i lack", "not recorded", "no information",
)
RELATIVE_TOLERANCE = 0.05
ABSOLUTE_TOLERANCE = 1.0

NUMERIC, STRING, REFUSAL = "numeric", "exact_string", "refusal"
WRONG_VALUE, BAD_REFUSAL, UNKNOWN, CRASH = "wrong_value", "bad_refusal", "unknown_match_type", "crash"
GRADE_ERROR = "grade_error"


def numeric_grade(answer: Column | str, expected: Column | str) -> Column:
    """First number of the answer within 5 % or 1 of the expected one, whichever allows more.

    Expected 0 asks for exactly 0; an expected NULL is met by no answer or a bare ``0``. Nothing meets
    an expected text that is no number.
    """
    answer, expected = as_column(answer), as_column(expected)
    wanted = expected.try_cast("double")
    found = first_number(answer)
    allowed = F.greatest(F.abs(wanted) * RELATIVE_TOLERANCE, F.lit(ABSOLUTE_TOLERANCE))
    near = F.when(wanted == 0, found == 0).otherwise(F.abs(found - wanted) <= allowed)
    nothing = answer.isNull() | (answer == "0")
    return F.when(expected.isNull(), nothing).otherwise(F.coalesce(near, F.lit(False)))


def string_grade(answer: Column | str, expected: Column | str) -> Column:
    """The expected text occurs in the answer, whatever the case and the markdown."""
    answer, wanted = as_column(answer), as_column(expected)
    occurs = without_markdown(answer).contains(F.lower(stripped(wanted)))
    nothing = answer.isNull() | (stripped(answer) == "")
    return F.when(wanted.isNull(), nothing).otherwise(F.coalesce(occurs, F.lit(False)))


def refusal_grade(answer: Column | str) -> Column:
    """The answer says that it lacks the data."""
    text = F.lower(as_column(answer))
    return F.coalesce(reduce(or_, (text.contains(p) for p in REFUSAL_PHRASES)), F.lit(False))


def grade(answers: DataFrame) -> DataFrame:
    """Adds ``correct`` and ``failure`` to rows with match, expected, answer and error.

    ``expected`` is text. A missing answer or an error is a crash, whatever was expected; an expected
    number that cannot be read is an error of the grading.
    """
    unreadable = F.col("expected").isNotNull() & F.col("expected").try_cast("double").isNull()
    match = F.col("match")
    crashed = F.col("error").isNotNull() | F.col("answer").isNull()
    correct = (
        F.when(crashed, False)
        .when(match == NUMERIC, numeric_grade("answer", "expected"))
        .when(match == STRING, string_grade("answer", "expected"))
        .when(match == REFUSAL, refusal_grade("answer"))
        .otherwise(False)
    )
    failure = (
        F.when(crashed, CRASH)
        .when(F.col("correct"), F.lit(None).cast("string"))
        .when((match == NUMERIC) & unreadable, GRADE_ERROR)
        .when(match.isin(NUMERIC, STRING), WRONG_VALUE)
        .when(match == REFUSAL, BAD_REFUSAL)
        .otherwise(UNKNOWN)
    )
    return answers.withColumn("correct", correct).withColumn("failure", failure)


def verdicts(graded: DataFrame, *keys: str) -> DataFrame:
    """One row per question: correct if all its runs are, with its most frequent failure.

    Counted per failure first, so a question with very many runs is a few rows when it is grouped.
    Equally frequent failures: the alphabetically first.
    """
    keys = keys or ("id", "category")
    per_failure = graded.groupBy(*keys, "failure").agg(
        F.count(F.lit(1)).alias("n"), F.every("correct").alias("all_correct")
    )
    failed = F.col("failure").isNotNull()
    rank = F.when(failed, F.struct((-F.col("n")).alias("n"), F.col("failure").alias("failure")))
    return per_failure.groupBy(*keys).agg(
        F.sum("n").alias("runs"),
        F.every("all_correct").alias("correct"),
        F.min(rank)["failure"].alias("failure"),
    )


def _accuracy() -> tuple[Column, Column, Column]:
    total, correct = F.count(F.lit(1)), F.count_if("correct")
    percent = F.when(total > 0, correct * 100.0 / total).otherwise(F.lit(0.0))
    return total.alias("total"), correct.alias("correct"), percent.alias("accuracy")


def overall(judged: DataFrame) -> DataFrame:
    return judged.agg(*_accuracy())


def by_category(judged: DataFrame, *keys: str) -> DataFrame:
    return judged.groupBy(*keys, "category").agg(*_accuracy())


RESULT_SCHEMA = """
    label STRING, questions ARRAY<STRUCT<id: STRING, category: STRING,
        verdicts: ARRAY<STRUCT<correct: BOOLEAN, failure: STRING>>>>
"""


def stored_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """One row per label and question of stored result files, judged anew from the verdict of each run.

    A result file is one JSON object. A question without runs counts as correct, as nothing failed.
    """
    files = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path)
    questions = files.select("label", F.explode("questions").alias("q"))
    runs = questions.select("label", "q.id", "q.category", F.explode_outer("q.verdicts").alias("v"))
    graded = runs.select("label", "id", "category", F.coalesce("v.correct", F.col("v").isNull()).alias("correct"), "v.failure")
    return verdicts(graded, "label", "id", "category")


def by_failure(judged: DataFrame) -> DataFrame:
    failed = judged.filter(F.col("failure").isNotNull())
    return failed.groupBy("failure").agg(F.count(F.lit(1)).alias("questions"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two category reports side by side with the difference in correct answers.

    A category only one run has counts 0 in the other.
    """
    first = before.select("category", F.col("correct").alias("correct_before"))
    second = after.select("category", F.col("correct").alias("correct_after"))
    both = first.join(second, "category", "full_outer").fillna(0, ["correct_before", "correct_after"])
    return both.withColumn("change", F.col("correct_after") - F.col("correct_before"))
