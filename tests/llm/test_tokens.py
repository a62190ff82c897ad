import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from snaplake.llm import bpe, packing  # noqa: E402
from snaplake.llm.text import blocks  # noqa: E402

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(small_rows):
    rnd = random.Random(2)
    letters = "ab1'.,!sé ́tdveIİ…日\n<|    ß"
    letters += "\u00a0\u2003\x85\x1c\u0301\u0345\u03a3AK"
    return [t for _, t in small_rows] + ["".join(rnd.choice(letters) for _ in range(60)) for _ in range(1500)] + ["a" * 999, "=" * 500]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(texts):
    counter = bpe.merger(BYTE)
    for _ in range(2):  # unknown units, then known ones
        got = np.concatenate([counter.count(p) for p in blocks(pa.array(texts, pa.string()), limit=5000)])
        assert got.tolist() == list(map(len, library(BYTE, texts)))


def test_counts_survive_a_full_cache(texts, monkeypatch):
    counter = bpe.Merger(BYTE)
    monkeypatch.setattr(counter.known, "_limit", 50)
    got = np.concatenate([counter.count(p) for p in blocks(pa.array(texts, pa.string()), limit=2000)])
    assert got.tolist() == list(map(len, library(BYTE, texts)))


def test_query(make_docs, small_rows):
    got = sorted((tuple(r) for r in bpe.count_tokens(make_docs(small_rows, extra=True), BYTE).collect()), key=repr)
    ids = library(BYTE, [t for _, t in small_rows])
    want = [(i, len((t or "").encode()), len(x), len(x) > 1024) for (i, t), x in zip(small_rows, ids, strict=True)]
    assert got == sorted(want, key=repr)
    assert bpe.count_tokens(make_docs([]), BYTE).count() == 0


def test_ids_equal_the_library(texts):
    coder = packing.encoder(WORD)
    for _ in range(2):
        got = []
        for part in blocks(pa.array(texts, pa.string()), pad=1, limit=5000):
            ids, count = coder.encode(part)
            got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
        assert got == library(WORD, texts)


def thue_morse(n, a, b):
    """Two strings of n letters whose sums of powers modulo 2^64 are equal for every base."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("n", [64, 256, 1024, 2048])
def test_strings_whose_sums_of_powers_are_equal_are_told_apart(n):
    letters = "abinsxEQ09_éß"
    pairs = [t for a in letters for b in letters if a < b for t in thue_morse(n, a, b)]
    counter = bpe.Merger(BYTE)
    got = np.concatenate([counter.count(p) for p in blocks(pa.array(pairs, pa.string()))])
    assert got.tolist() == list(map(len, library(BYTE, pairs)))
    encoder = packing.Encoder(WORD)
    ids, count = encoder.encode(next(iter(blocks(pa.array(pairs, pa.string()), pad=1, limit=1 << 30))))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == library(WORD, pairs)
