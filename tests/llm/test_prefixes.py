"""The prefix trie against rebuilt conversations held whole in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.errors import PySparkException

from snaplake.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, key(*t[1:])))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5  # the remainder of division toward zero
        whole[c] = tuple(t[1:] for t in own.get(c - base, [])[:h] + turns[h:])
    members = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[q] for q in children.get(p, [])]
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        sums[p] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = []
    for p, held in members.items():
        ends = ",".join(str(c) for c in held if len(whole[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out.append((held[0], len(p), parent, len(held), len(children.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def conversations():
    rnd = random.Random(4)
    rows = []
    for c in range(-30, 260):
        if c % 11 == 3:
            continue  # some conversations that would lend a head are absent
        same = rnd.random() < 0.4
        for t in range(rnd.choice([1, 2, 3, 5, 8, 12, 20])):
            text = f"common {t}" if same else rnd.choice(["x", "é日", "", None, "y" * 300, f"own {c}"])
            rows.append((c, t if rnd.random() < 0.9 else rnd.choice([None, t + 1]), rnd.choice(["user", "assistant", None]) if not same else "user", text))
    rows += [(1000 + k, t, "user", f"common {t}") for k in range(60) for t in range(12)]
    rows += [(2000, t, "user", f"long {t}") for t in range(300)] + [(2005, t, "user", f"long {t}") for t in range(200)]
    rows += [(3000, 0, "user", "z" * 400000), (3001, 0, "user", "z" * 400000), (None, 0, "user", "no id"), (4000, 0, "user", "twice"), (4000, 0, "user", "twice")]
    return rows


def trie(workers, rows, **more):
    return sorted((tuple(r) for r in prefixes.prefix_trie(workers.createDataFrame(rows, SCHEMA), **more).collect()), key=repr)


def test_trie(workers, conversations):
    assert trie(workers, conversations) == brute(conversations)


def test_many_ends_of_one_node(workers, conversations, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 7)
    few = [r for r in conversations if r[0] is not None and r[0] >= 1000 and r[0] < 2000]
    assert trie(workers, few) == brute(few)


def test_one_empty_rebuilt_conversation_and_no_rows(workers):
    lone = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # its base is absent
    assert trie(workers, [(lone, 0, "user", "gone")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert trie(workers, []) == []


def test_products_compose():
    rnd = random.Random(1)
    a, b, c = ((rnd.randrange(prefixes.PRIME), rnd.randrange(prefixes.PRIME)) for _ in range(3))
    assert prefixes.compose(prefixes.compose(a, b), c) == prefixes.compose(a, prefixes.compose(b, c))
    assert prefixes.compose(prefixes.UNIT, a) == a == prefixes.compose(a, prefixes.UNIT)


def test_equal_hashes_of_unlike_sequences_are_found(workers):
    """With base 0 only the last turn counts, so sequences that end alike clash."""
    rows = [(c, t, "user", f"{c} {t}" if t == 0 else "same") for c in (0, 5) for t in (0, 1)]
    with pytest.raises(PySparkException, match="another base"):
        trie(workers, rows, base=0)


def test_other_columns(workers):
    wide = workers.createDataFrame([(5, 0, "user", "x", 1, "a", 2.0, 3)], SCHEMA + ", id long, head string, depth double, at int")
    assert [tuple(r)[:7] for r in prefixes.prefix_trie(wide).sort("depth").collect()] == [(5, 0, None, 1, 1, 1, 0), (5, 1, 5, 1, 0, 1, 0)]
