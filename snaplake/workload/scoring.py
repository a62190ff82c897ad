"""Grading and roll-up: documents stand in for answers, their character count for what is expected."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.plans import scorecard as C
from snaplake.workload import landing
from snaplake.workload.registry import query


def _answers(spark, sf_dir, run: int):
    """Run 1 answers with the whole text, in part followed by a number or a refusal; run 2 is terse."""
    documents = landing.table(spark, sf_dir, "documents")
    labels = landing.table(spark, sf_dir, "labels")
    marked = documents.join(labels, "doc_id", "left")
    kind = F.expr("int(substr(source, 4)) % 4")
    match = F.get(F.array(*map(F.lit, ("numeric", "exact_string", "refusal", "essay"))), kind)
    expected = (
        F.when(kind == 0, F.when(F.col("lang") != "es", F.col("n_chars").cast("string")))
        .when(kind == 1, F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
    )
    if run == 1:
        extra = (
            F.when(F.col("toxic") == 1, F.lit(" I cannot say that."))
            .when(F.col("quality") == 1, F.format_string(" It is **%d** for **%s**", "n_chars", "lang"))
            .otherwise("")
        )
        answer = F.concat("text", extra)
    else:
        answer = F.format_string("_%d_ characters in __%s__, not recorded", F.col("n_chars") + 3, "lang")
    failed = F.col("source") == "src19"
    return marked.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("category"),
        match.alias("match"),
        expected.alias("expected"),
        F.lit(run).cast("bigint").alias("run"),
        F.when(~failed, answer).alias("answer"),
        F.when(failed & (F.col("lang") == "en"), F.lit("timeout")).alias("error"),
    )


_PLAIN = r"regexp_replace(lower(answer), '\*\*|_', '', 'g')"


def _answers_sql(run: int) -> str:
    answer = """concat(text, CASE WHEN toxic = 1 THEN ' I cannot say that.'
            WHEN quality = 1 THEN concat(' It is **', n_chars, '** for **', lang, '**') ELSE '' END)"""
    if run == 2:
        answer = "concat('_', n_chars + 3, '_ characters in __', lang, '__, not recorded')"
    return f"""
        SELECT doc_id AS id, lang AS category, CAST({run} AS BIGINT) AS run, kind,
            CASE kind WHEN 0 THEN CASE WHEN lang <> 'es' THEN CAST(n_chars AS VARCHAR) END
                WHEN 1 THEN concat(' ', upper(lang), ' ') END AS expected,
            CASE WHEN source <> 'src19' THEN {answer} END AS answer
        FROM (SELECT *, CAST(substr(source, 4) AS INT) % 4 AS kind FROM documents) d
        LEFT JOIN labels USING (doc_id)"""


def _graded_sql(run: int) -> str:
    return rf"""
        SELECT id, category, run,
            CASE WHEN answer IS NULL THEN FALSE
                WHEN kind = 0 THEN coalesce(expected IS NOT NULL AND CASE WHEN CAST(expected AS DOUBLE) = 0
                    THEN number = 0 ELSE abs(number - CAST(expected AS DOUBLE))
                        <= greatest(abs(CAST(expected AS DOUBLE)) * 0.05, 1) END, FALSE)
                    OR (expected IS NULL AND answer = '0')
                WHEN kind = 1 THEN contains({_PLAIN}, lower(trim(expected)))
                WHEN kind = 2 THEN regexp_matches(lower(answer), 'don''t have|no data|not available|not in|unable to|cannot|don''t track|i lack|not recorded|no information')
                ELSE FALSE END AS correct,
            kind, answer
        FROM (SELECT *, TRY_CAST(NULLIF(regexp_extract(answer, '-?[0-9]+(?:\.[0-9]+)?', 0), '') AS DOUBLE) AS number
              FROM ({_answers_sql(run)}))"""


def _judged_sql(*runs: int) -> str:
    graded = " UNION ALL ".join(_graded_sql(run) for run in runs)
    return f"""
        WITH g AS (
            SELECT *, CASE WHEN answer IS NULL THEN 'crash' WHEN correct THEN NULL
                WHEN kind IN (0, 1) THEN 'wrong_value' WHEN kind = 2 THEN 'bad_refusal'
                ELSE 'unknown_match_type' END AS failure
            FROM ({graded})),
        counted AS (
            SELECT id, failure, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, failure) AS place
            FROM g WHERE failure IS NOT NULL GROUP BY id, failure)
        SELECT q.id AS id, q.category AS category, q.runs AS runs, q.correct AS correct, c.failure AS failure
        FROM (SELECT id, category, CAST(count(*) AS BIGINT) AS runs, bool_and(correct) AS correct
              FROM g GROUP BY id, category) q
        LEFT JOIN counted c ON c.id = q.id AND c.place = 1"""


def _judged(spark, sf_dir, *runs: int):
    answers = _answers(spark, sf_dir, runs[0])
    for run in runs[1:]:
        answers = answers.unionByName(_answers(spark, sf_dir, run))
    return C.verdicts(C.grade(answers))


def _register_grade(name: str, kind: int, match: str) -> None:
    both = " UNION ALL ".join(_graded_sql(run) for run in (1, 2))

    @query(name, f"SELECT id, run, correct FROM ({both}) WHERE kind = {kind}")
    def graded(spark, sf_dir):
        answers = _answers(spark, sf_dir, 1).unionByName(_answers(spark, sf_dir, 2))
        return C.grade(answers.filter(F.col("match") == match)).select("id", "run", "correct")


_register_grade("grade_numeric", 0, "numeric")
_register_grade("grade_string", 1, "exact_string")
_register_grade("grade_refusal", 2, "refusal")


@query("verdicts", _judged_sql(1, 2))
def verdicts(spark, sf_dir):
    """A question is right if both runs are; its failure is the more frequent one."""
    return _judged(spark, sf_dir, 1, 2)


_ACCURACY = """CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct,
    round(100.0 * count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy"""


@query("scorecard", f"SELECT category, {_ACCURACY} FROM ({_judged_sql(1, 2)}) GROUP BY category")
def scorecard(spark, sf_dir):
    report = C.by_category(_judged(spark, sf_dir, 1, 2))
    return report.withColumn("accuracy", F.round("accuracy", 6))


@query("scorecard_overall", f"SELECT {_ACCURACY} FROM ({_judged_sql(1, 2)})")
def scorecard_overall(spark, sf_dir):
    return C.overall(_judged(spark, sf_dir, 1, 2)).withColumn("accuracy", F.round("accuracy", 6))


@query("scorecard_failures", f"""
    SELECT failure, CAST(count(*) AS BIGINT) AS questions FROM ({_judged_sql(1, 2)})
    WHERE failure IS NOT NULL GROUP BY failure
""")
def scorecard_failures(spark, sf_dir):
    return C.by_failure(_judged(spark, sf_dir, 1, 2))


@query("scorecard_compare", f"""
    WITH a AS (SELECT category, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS n FROM ({_judged_sql(1)}) GROUP BY 1),
        b AS (SELECT category, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS n FROM ({_judged_sql(2)}) GROUP BY 1)
    SELECT category, a.n AS correct_before, b.n AS correct_after, b.n - a.n AS change FROM a JOIN b USING (category)
""")
def scorecard_compare(spark, sf_dir):
    """The two runs as two labelled reports, category by category."""
    return C.compare(C.by_category(_judged(spark, sf_dir, 1)), C.by_category(_judged(spark, sf_dir, 2)))
