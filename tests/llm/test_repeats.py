import hashlib
import random
from collections import Counter

import pytest

from snaplake.llm import repeats as rp


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    line = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    shared = [line("abcdeé ", 600) for _ in range(6)]
    out = []
    for i in range(100):
        text = line("abcdefgé ", rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, 400)
            text += rnd.choice(shared)[at : at + rnd.randint(100, 400)] + line("xyz", rnd.randint(0, 40))
        out.append((i, text))
    twice = out[5][1] + line("q", 5) + shared[0]
    return [*out, (200, "a" * 500), (201, "ab" * 300), (202, None), (203, ""), (204, twice), (204, twice), (None, out[6][1]), (205, "q" * 199), (206, "r" * 200)]


def covered(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield b, gone


def brute(rows):
    for (i, _), (b, gone) in zip(rows, covered(rows), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [rp.HOT, 2])
def test_report_equals_brute_force(make_docs, rows, hot, monkeypatch):
    monkeypatch.setattr(rp, "HOT", hot)
    got = [tuple(r) for r in rp.report(make_docs(rows, extra=True)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_other_lengths(make_docs, rows):
    rows = rows[:40]
    got = rp.report(make_docs(rows), length=64, gram=20).collect()
    want = [sum(gone) for _, gone in covered(rows, 64)]
    assert {r.doc_id: r.n_removed for r in got} == {i: n for (i, _), n in zip(rows, want, strict=True)}


def test_removal_keeps_columns_and_nulls(make_docs, rows):
    docs = make_docs(rows, extra=True)
    out = rp.remove_repeats(docs)
    assert out.schema == docs.schema
    want = [
        (i, t if t is None else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore"))
        for (i, t), (b, gone) in zip(rows, covered(rows), strict=True)
    ]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert rp.remove_repeats(make_docs([], extra=True)).count() == 0
    assert rp.report(make_docs([])).count() == 0
