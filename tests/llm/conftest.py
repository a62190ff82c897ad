import random

import pytest

from snaplake.llm.store import importable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def workers(spark):
    """The session, with workers that can import the package."""
    return importable(spark)


@pytest.fixture(scope="session")
def make_docs(workers):
    def make(rows, extra=False):
        """(doc_id, text) rows; with ``extra``, columns whose names clash with what the operators make."""
        if not extra:
            return workers.createDataFrame(rows, "doc_id long, text string")
        wide = [(i, t, "x", 7, None, 1.5) for i, t in rows]
        return workers.createDataFrame(wide, "doc_id long, text string, id string, row long, score double, fingerprint double")

    return make


ODD = [
    (None, "a null id, and words enough to be counted by anything that counts words"),
    (900, None),
    (901, ""),
    (902, " \n\t "),
    (903, "short"),
    (904, "éÉ日本 🙂 ĀĂ"),
    (905, "word " * 3000),
    (906, "x" * 20000),
    (907, "same text twice, under one id"),
    (907, "same text twice, under one id"),
    (908, "<|endoftext|> don't  we'll    end <|startoftext|>"),
]


@pytest.fixture(scope="session")
def small_rows():
    """A small corpus with copies, near copies, shared passages and odd texts."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéstr") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [text(60) for _ in range(4)]
    rows = []
    for i in range(120):
        body = text(rnd.randint(1, 120))
        if i % 3 == 0:
            body += "\n" + rnd.choice(passages) + " " + text(rnd.randint(0, 20))
        if i % 10 == 9:
            body = rows[i - 5][1]
        if i % 10 == 8:
            body = rows[i - 5][1] + "."
        rows.append((i, body.capitalize()))
    return rows + ODD
