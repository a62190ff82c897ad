import hashlib
import re

import pytest

from snaplake.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            m = min(len(p), 13)
            windows = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if m else set()
            for i in range(len(w) - m + 1) if m else ():
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(small_rows):
    long = small_rows[0][1].split()
    return [
        (1, " ".join(long[:30]) + "!"), (1, " ".join(long[2:40])), (10, "Short: SAME text"), (2, None), (3, ""), (4, "..."),
        (None, "twice under"), (5, "日本"), (6, " ".join(small_rows[3][1].split()[-25:])),
    ]


@pytest.mark.parametrize("limit", [dc.BENCHMARK_BYTES, 150])
def test_scan_equals_brute_force(workers, make_docs, small_rows, items, limit, monkeypatch):
    monkeypatch.setattr(dc.benchmark_blocks, "__defaults__", (dc.WINDOW, limit))
    bench = workers.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in dc.scan(make_docs(small_rows, extra=True), bench).collect()]
    assert sorted(got, key=repr) == brute(small_rows, items)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_removal(workers, make_docs, small_rows, items):
    bench = workers.createDataFrame(items, "item_id long, text string")
    docs = make_docs(small_rows, extra=True)
    bad = {(r[0], r[1]) for r, b in zip(small_rows, [brute([r], items)[0][5] for r in small_rows], strict=True) if b}
    kept = dc.remove_contaminated(docs, bench)
    assert kept.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted((r for r in small_rows if r not in bad), key=repr)
    cut = {r.doc_id: r.text for r in dc.remove_spans(docs, bench).collect()}
    assert "twice" not in cut[907] and cut[903] == "short"
    assert cut[900] is None and cut[901] == ""


def test_empty_tables(workers, make_docs, small_rows):
    none = workers.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in dc.scan(make_docs(small_rows), none).collect())
    assert dc.scan(make_docs([]), none).count() == 0
