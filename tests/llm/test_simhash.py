import re

import numpy as np
import xxhash

from snaplake.llm import simhash as sh

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def print_of(text):
    w = WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def labels(prints, radius=3):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(label)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_groups_equal_brute_force(make_docs, small_rows, monkeypatch):
    rows = sorted(small_rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = np.array([print_of(t) for _, t in rows], np.uint64)
    label = labels(prints)
    want = sorted(((i, f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints.tolist(), label, strict=True)), key=repr)
    for shard, largest in ((sh.SHARD, sh.LARGEST), (8, sh.LARGEST), (30, 7)):
        monkeypatch.setattr(sh, "LARGEST", largest)
        got = sh.near_duplicates(make_docs(small_rows, extra=True), shard=shard).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_shards_and_leaves_lose_no_link():
    rng = np.random.default_rng(4)
    some = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    for _ in range(8):
        more = some[rng.integers(0, len(some), 150)] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
        some = np.unique(np.append(some, more))
    edges = []
    for shift, mask in sh._HALVES:
        keys = some >> shift & mask
        top = sh.Top(keys[:300], 40, 1)
        row, shard, home = top.route(keys)
        assert home.sum() == len(some)
        for k in range(top.shards):
            mine = row[shard == k]
            edges += [(mine[a], mine[b]) for a, b in sh.shard_links(keys[mine], some[mine], home[shard == k], 3, 1)]
    assert all(np.bitwise_count(some[a] ^ some[b]) <= 3 for a, b in edges)
    parent = labels(some)
    near = np.zeros((len(some), len(some)), bool)
    np.fill_diagonal(near, True)
    for a, b in edges:
        near[a, b] = near[b, a] = True
    label = np.arange(len(some))
    while not ((new := np.where(near, label[None, :], len(label)).min(axis=1)) == label).all():
        label = new
    assert (label == parent).all()


def test_a_ball_too_dense_to_cut():
    """Thousands of prints within few bits of one: a forest, not all pairs, comes out."""
    rng = np.random.default_rng(1)
    bits = np.uint64(1) << rng.integers(0, 64, (1500, 2)).astype(np.uint64)
    ball = np.unique(np.uint64(0x123456789ABCDEF0) ^ bits[:, 0] ^ bits[:, 1])
    edges = sh.shard_links(ball & np.uint64(0xFFFFFFFF), ball, np.ones(len(ball), bool), 3, 1)
    assert len(edges) < 40 * len(ball)


def test_components_of_a_long_path(workers):
    edges = workers.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in sh.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_keep_one(make_docs, small_rows):
    docs = make_docs(small_rows, extra=True)
    groups = sh.near_duplicates(docs).collect()
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in groups}
    assert sh.keep_one(make_docs([])).count() == 0


def test_keep_one_counts_rows(make_docs):
    """Repeated rows, null ids alone and beside others, and one id in two groups: one row of each group stays."""
    one, two, three = ("".join(f"{w}{i} " for i in range(40)) for w in ("ab", "cd", "ef"))
    rows = [(1, one), (1, one), (2, one), (None, two), (None, two), (None, two), (None, one), (3, three), (None, three), (3, two + three), (3, two + three)]
    kept = sh.keep_one(make_docs(rows, extra=True)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, one), (None, two), (3, three), (3, two + three)], key=repr)
