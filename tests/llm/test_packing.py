import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from snaplake.llm import packing as pk

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """The least number of bins, by search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            k = rooms.index(r)
            place(i + 1, rooms[:k] + [r - lengths[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - lengths[i]])

    place(0, [])
    return best[0]


def bins_of(count, capacity):
    left = dict(count)
    fixed = pk.reduce_by_dominance(left, capacity)
    return fixed, fixed + pk.best_fit(left, capacity), left


def test_plans_hold_every_piece_once():
    rnd = random.Random(1)
    for _ in range(500):
        capacity = rnd.randint(3, 60)
        count = {rnd.randint(1, capacity): rnd.randint(1, 6) for _ in range(rnd.randint(1, 9))}
        _, bins, _ = bins_of(count, capacity)
        held = Counter()
        for n, parts in bins:
            assert n > 0 and sum(x * k for x, k in parts) <= capacity
            for x, k in parts:
                held[x] += n * k
        assert held == Counter(count)


def test_reduction_keeps_the_optimum():
    rnd = random.Random(2)
    for _ in range(150):
        capacity = rnd.randint(8, 30)
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 8))]
        fixed, _, left = bins_of(Counter(lengths), capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packed_documents(make_docs, small_rows, capacity):
    from tokenizers import Tokenizer

    rows = pk.pack_documents(make_docs(small_rows, extra=True), WORD, capacity=capacity).collect()
    encoded = Tokenizer.from_file(WORD).encode_batch([t or "" for _, t in small_rows], add_special_tokens=False)
    want = []
    for (i, _), e in zip(small_rows, encoded, strict=True):
        ids = np.array([*e.ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            want.append((i, k, at, len(piece), zlib.crc32(piece.tobytes())))
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(held) <= 1.1 * sum(r.length for r in rows) / capacity + 1


def test_no_documents(make_docs):
    assert pk.pack_documents(make_docs([]), WORD).count() == 0
