import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from snaplake.llm import lm

TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


class Plain:
    """The same model with dictionaries, one symbol after another."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for context, symbol in (x for t in texts for x in self.symbols(t)):
            for k in range(lm.ORDER + 1):
                self.seen[context[lm.ORDER - k :]][symbol] += 1

    @staticmethod
    def symbols(text):
        data = b"\xff" * lm.ORDER + text + b"\xff"
        return [(data[i - lm.ORDER : i], data[i]) for i in range(lm.ORDER, len(data))]

    def log10(self, context, symbol):
        out, gone = 0.0, set()
        for k in range(lm.ORDER, -1, -1):
            found = {s: n for s, n in self.seen.get(context[lm.ORDER - k :], {}).items() if s not in gone}
            total = sum(found.values())
            if symbol in found:
                return out + math.log10((found[symbol] - 0.5) / total)
            if found:
                out += math.log10(0.5 * len(found) / total)
                gone |= set(found)
        return out - math.log10(256 - len(gone))

    def score(self, text):
        return sum(self.log10(c, s) for c, s in self.symbols(text))


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.mark.parametrize("limits", [{}, {"limit": 700, "frequent": 20}, {"frequent": 0}])
def test_scores_equal_the_plain_model(make_docs, small_rows, limits):
    rows = [r for r in small_rows if r[0] != 905 and r[0] != 906][-50:]
    training = [lower(t) for i, t in rows if not held(i)]
    model, tokens = Plain(training), Counter()
    for t in training:
        tokens.update([*TOKEN.findall(t), None])
    n, v = sum(tokens.values()), len(tokens)
    want = []
    for i, t in rows:
        own = [*TOKEN.findall(lower(t)), None]
        base = sum(math.log10((tokens[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)
        want.append((i, held(i), len(own), sum(tokens[x] > 0 for x in own), n, base, model.score(lower(t))))
    got = sorted((tuple(r) for r in lm.score_held_out(make_docs(rows, extra=True), **limits).collect()), key=repr)
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:])


def test_probabilities_add_up_to_one(small_rows):
    plain = Plain([lower(t) for _, t in small_rows[:40]])
    keys = Counter(int.from_bytes(c[::-1] + bytes([s]), "big") for _, t in small_rows[:40] for c, s in Plain.symbols(lower(t)))
    own, counts = np.array(sorted(keys), np.uint64), np.array([keys[k] for k in sorted(keys)], float)
    low = lm._grouped(own >> np.uint64(40) << np.uint64(8) | own & np.uint64(255), counts)
    trie = lm.Trie(own, counts, *low)
    for context in (b"abcde", b"\xff" * 5, b" the ", b"zzzzz", small_rows[0][1][3:8].encode()[:5]):
        key = np.uint64(int.from_bytes(context[::-1] + b"\0", "big")) | np.arange(256, dtype=np.uint64)
        got = trie.code(key)
        assert (10**got).sum() == pytest.approx(1)
        assert got.tolist() == pytest.approx([plain.log10(context, s) for s in range(256)])


def test_without_training_rows_and_without_rows(make_docs):
    docs = make_docs([(1, "abc"), (2, None)])
    got = {r.doc_id: r for r in lm.score(docs, docs.limit(0)).collect()}
    assert got[1].score == pytest.approx(-4 * math.log10(256)) and got[2].score == pytest.approx(-math.log10(256))
    assert (got[1].n_known, got[1].train_tokens, got[1].base_score) == (0, 0, 0.0)
    assert lm.score(docs.limit(0), docs).count() == 0
