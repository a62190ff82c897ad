import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from snaplake.llm import syncmers as sy
from snaplake.llm.text import blocks


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))


@pytest.mark.parametrize("size", [sy.RANGE_BYTES, 3000])
def test_pairs(make_docs, small_rows, size, monkeypatch):
    monkeypatch.setattr(sy, "RANGE_BYTES", size)
    got = sy.fingerprint_pairs(make_docs(small_rows, extra=True)).collect()
    rows = ordered(small_rows)
    want = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 3
        whole = t[: len(t) - n] + after[:n]
        a, b, c = sy.prints([t, whole, after])
        want.append((i, len(t), hashlib.sha256(whole.encode()).hexdigest(), sy.written(a), sy.written(b), sy.likeness(a, b), sy.likeness(a, c)))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_anchors_depend_on_their_own_bytes_only(small_rows):
    text = " ".join(t for _, t in small_rows[:30])

    def found(s):
        return [(p, h) for part in blocks(pa.array([s])) for p, h in zip(*(x.tolist() for x in sy.anchors(part)[1:]), strict=True)]

    whole = found(text)
    for cut in (1, 17, 500):
        tail = found(text[cut:])
        shift = len(text[:cut].encode())
        assert [(p + shift, h) for p, h in tail] == [(p, h) for p, h in whole if p >= shift]
    for p, _ in whole:  # the least inner string is the first or the last
        inner = [sy.BYTES.spans(sy.BYTES.sums(part.data), *([p + k], [p + k + sy.S]))[0] for part in blocks(pa.array([text])) for k in range(0, sy.K - sy.S + 1)] if p < 200 else None
        assert inner is None or min(inner) in (inner[0], inner[-1]) or min(x >> 16 for x in inner) in (inner[0] >> 16, inner[-1] >> 16)


def test_likeness():
    texts = ["".join(f"{hash((k, i)) % 99991} " for i in range(400)) for k in range(3)]
    a, b, c = sy.prints(texts)
    assert sy.likeness(a, a) == 1 and sy.likeness(a, b) < 0.1
    half = sy.prints([texts[0][: len(texts[0]) * 2 // 3] + texts[2][: len(texts[0]) // 3]])[0]
    assert 0.3 < sy.likeness(a, half) < 0.7
    empty, tiny, other = sy.prints(["", "ab", "abc"])
    assert (sy.likeness(empty, empty), sy.likeness(empty, tiny), sy.likeness(tiny, other)) == (1, 0, 0)
    assert sy.written(empty) == "" and sy.written(tiny) != sy.written(other)


def test_one_document_and_none(make_docs):
    (r,) = sy.fingerprint_pairs(make_docs([(1, "abcdefghi")])).collect()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest()
    assert sy.fingerprint_pairs(make_docs([])).count() == 0


def test_places_of_long_texts_are_whole_and_fingerprints_can_be_read_back():
    rnd = random.Random(12)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3 << 20))
    moved = long[1 << 20 :] + long[: 1 << 20]  # the same strings, in another order
    a, b = sy.prints([long, moved])
    assert max(a.values()) > 0xFFFF
    places = {long.encode().index(g) // 16 for g in _least_grams(long)}
    assert set(a.values()) == places
    for x, y in ((a, b), (a, a), (a, {})):
        assert sy.read(sy.written(x)) == x and list(sy.read(sy.written(x))) == list(x)
        assert sy.likeness(sy.read(sy.written(x)), sy.read(sy.written(y))) == sy.likeness(x, y)
    assert 0.4 < sy.likeness(a, b) < 0.9


def _least_grams(text):
    """The grams with the least hashes among closed syncmers, found string by string."""
    data = text.encode()
    (part,) = blocks(pa.array([text]), limit=1 << 30)
    sums = sy.BYTES.sums(part.data)
    _, place, gram = sy.anchors(part)
    first = {}
    for p, g in zip(place.tolist(), gram.tolist(), strict=True):
        first.setdefault(g, p)
    assert sums is not None and len(first) == len(place)  # random text: no gram stands twice
    with_hash = sorted((int(sy.mix(np.array([g], np.uint64))[0] >> np.uint64(32)), p) for g, p in first.items())
    return [data[p : p + sy.K] for _, p in with_hash[: sy.SIZE]]
