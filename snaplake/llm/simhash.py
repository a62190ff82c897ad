"""SimHash near-duplicates: exact pairs within a Hamming radius by vantage-point trees.

Fingerprints are made of distinct words shingles hashed by XXH64. Only distinct fingerprints are
compared. Two fingerprints at most 3 bits apart differ in at most 1 bit in one of their halves, so two
trees, one per half, search within radius 1 there and check the whole fingerprint. The top of each tree
is fitted on a bounded sample and broadcast; it cuts the fingerprints into shards. A fingerprint has one
home shard and visits each shard whose boundary the triangle bound does not put out of reach. Each shard
continues the tree in memory, compares its leaves in blocks, and returns only the edges of a spanning
forest. Components are found by alternating star contraction, on stored edges.

Edge cases: null or word-less texts have fingerprint zero and link like any other; a text of fewer words
than a shingle is one shingle; equal fingerprints are one node, however many rows they have. Component ids
are the least id reached; a null id takes part but is never a label unless all ids are null. An empty
table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.store import stored
from snaplake.llm.text import LOWER, Texts, blank, blocks, mix, spread

SHINGLE = 3
RADIUS = 3
SEED = 42
#: The top trees are fitted on at most so many fingerprints; what they cut holds for all.
SAMPLE = 1 << 14
SHARD = 1 << 13
#: A shard of more rows than this (prints so close together that no tree cuts them) is compared in blocks of it.
LARGEST = 1 << 17
LEAF = 256
COMPARE = 1 << 22

_HALVES = ((np.uint64(0), np.uint64(0xFFFFFFFF)), (np.uint64(32), np.uint64(0xFFFFFFFF)))


def fingerprints_of(part: Texts, shingle: int = SHINGLE) -> np.ndarray:
    """A bit is 1 if it is set in over half of the hashes of the shingles, repeats included."""
    low = LOWER[part.data]
    inside = ~blank(low)
    # one blank between words, none around them
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    text = np.where(inside, low, np.uint8(0x20))[keep].tobytes()
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    word_of = np.searchsorted(part.starts, edge[::2], side="right") - 1
    count = np.bincount(word_of, minlength=len(part.starts))
    lengths = edge[1::2] - edge[::2]
    begin = np.cumsum(lengths + 1) - lengths - 1
    out = np.zeros(len(count), np.uint64)
    last = np.cumsum(count)
    n_shingles = np.where(count > shingle, count - shingle + 1, np.minimum(count, 1))
    i = np.arange(len(begin))
    left = last[word_of] - i  # words from here to the end of the text
    first = (left >= shingle) | (i == (last - count)[word_of])
    at = i[first]
    to = at + np.minimum(left[first], shingle) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(text[a:b], SEED) for a, b in zip(begin[at].tolist(), (begin[to] + lengths[to]).tolist(), strict=True)), np.uint64, len(at)
    )
    some = np.flatnonzero(n_shingles)
    if len(some):
        start = (np.cumsum(n_shingles) - n_shingles)[some]
        ones = _bit_counts(hashes, start)
        bits = ones * 2 > n_shingles[some][:, None]
        out[some] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits, highest first, is set in each run of hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, more: Sequence[str] = ()) -> DataFrame:
    """(id, fingerprint as a signed long) of every row, and its columns ``more``, which are longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(part, shingle) for part in blocks(batch.column(1), pad=1, limit=1 << 18)]
            found = np.concatenate(found) if found else np.zeros(0, np.uint64)
            columns = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fingerprint", *more])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *more)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"id {kind}, fingerprint long", *(f"{c} long" for c in more)]))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Top:
    """The top of a vantage-point tree: inner nodes (point, radius, near child, far child); shards are -1 - child."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int):
        self.nodes: list[list[int]] = []
        self.shards, self.radius = 0, radius
        self.root = self._grow(sample, leaf)

    def _grow(self, own: np.ndarray, leaf: int) -> int:
        cut = _cut(own) if len(own) > leaf else None
        if cut is None:
            self.shards += 1
            return -self.shards
        point, middle, d = cut
        at = len(self.nodes)
        self.nodes.append([])
        near, far = self._grow(own[d <= middle], leaf), self._grow(own[d > middle], leaf)
        self.nodes[at] = [int(point), middle, near, far]
        return at

    def route(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, whether at home) of each key: its home, and the shards within reach of it."""
        out = []
        todo = [(self.root, np.arange(len(keys)), np.ones(len(keys), bool))]
        while todo:
            node, row, home = todo.pop()
            if node < 0:
                out.append((row, np.full(len(row), -1 - node), home))
            elif len(row):
                point, middle, near, far = self.nodes[node]
                d = distance(keys[row], np.uint64(point)).astype(np.int64)
                inside = d <= middle
                for child, there, reach in ((near, inside, d <= middle + self.radius), (far, ~inside, d > middle - self.radius)):
                    todo.append((child, row[reach], home[reach] & there[reach]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cut(own: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """The best of a few vantage points: the one whose median ball has the fewest points near its boundary."""
    best = None
    for point in {*own[:: max(1, len(own) // 4)][:4].tolist(), 0}:
        d = distance(own, np.uint64(point)).astype(np.int64)
        middle = int(np.median(d))
        for m in (middle - 1, middle):
            inside = int((d <= m).sum())
            if 0 < inside < len(own):
                largest = max(int((d <= m + 1).sum()), int((d >= m).sum()))
                if best is None or largest < best[0]:
                    best = (largest, np.uint64(point), m, d)
    return None if best is None or best[0] >= 0.95 * len(own) else best[1:]


def _spanning(whole: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a leaf, each row compared in blocks; links between visitors are not sought."""
    linked = np.zeros(len(whole), bool)
    step = max(1, COMPARE // len(whole))
    own = np.flatnonzero(home)
    for at in range(0, len(own), step):
        block = own[at : at + step]
        near = distance(whole[block][:, None], whole[None, :]) <= radius
        near[np.arange(len(block)), block] = False
        linked[block] |= near.any(axis=1)
        linked |= near.any(axis=0)
    edges: list[tuple[int, int]] = []
    left = np.flatnonzero(linked)
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[:step], front[step:]
            near = distance(whole[block][:, None], whole[left][None, :]) <= radius
            hit = near.any(axis=0)
            edges += zip(block[near[:, hit].argmax(axis=0)].tolist(), left[hit].tolist(), strict=True)
            front, left = np.concatenate((front, left[hit])), left[~hit]
    return edges


def shard_links(keys: np.ndarray, whole: np.ndarray, home: np.ndarray, radius: int, reach: int) -> list[tuple[int, int]]:
    """Links (a spanning forest of them) of what is at home in a shard; ``keys`` are the halves the tree is on."""
    edges: list[tuple[int, int]] = []
    todo = [(np.arange(len(whole)), home)]
    while todo:
        rows, own = todo.pop()
        if not own.any():
            continue
        cut = _cut(keys[rows]) if len(rows) > LEAF else None
        if cut is None:
            edges += ((int(rows[a]), int(rows[b])) for a, b in _spanning(whole[rows], own, radius))
            continue
        _, middle, d = cut
        for there, near in ((d <= middle, d <= middle + reach), (d > middle, d > middle - reach)):
            todo.append((rows[near], (own & there)[near]))
    return edges


def links(nodes: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(a, b): edges that connect the fingerprints within ``radius`` bits, at most two per visit of a shard."""
    spark = nodes.sparkSession
    size = nodes.count()
    fitted = nodes.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(sample).toArrow()
    fitted = fitted["fingerprint"].to_numpy().view(np.uint64)
    reach = radius // len(_HALVES)
    leaf = max(8, shard * len(fitted) // max(size, 1))
    tops = spark.sparkContext.broadcast([Top(fitted >> shift & mask, leaf, reach) for shift, mask in _HALVES])

    def route(parts: dict[tuple[int, int], int]):
        """``parts`` has the shards to be compared in so many parts, each part at home against each part visiting."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column(0).to_numpy()
                for tree, (shift, mask) in enumerate(_HALVES):
                    row, place, home = tops.value[tree].route(found.view(np.uint64) >> shift & mask)
                    n = np.array([parts.get((tree, k), 1) for k in range(tops.value[tree].shards)])[place]
                    own = (mix(found[row].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
                    again, other = spread(n)
                    row, place, home, own = row[again], place[again], home[again], own[again]
                    at_home = home & (other == own)
                    out = [(row, place, other * LARGEST + own, at_home)]  # visiting each part, at home in its own
                    more = np.flatnonzero(home & (other != own))  # at home against the parts that visit
                    out.append((row[more], place[more], own[more] * LARGEST + other[more], home[more]))
                    for row_, place_, block, home_ in out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(row_), tree)), pa.array(place_), pa.array(block), pa.array(found[row_]), pa.array(home_)],
                            names=["tree", "shard", "block", "fingerprint", "home"],
                        )

        return run

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shift, mask = _HALVES[key[0]]
        found = rows["fingerprint"].to_numpy()
        whole = found.view(np.uint64)
        edges = np.array(shard_links(whole >> shift & mask, whole, rows["home"].to_numpy(bool), radius, reach), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": found[edges[:, 0]], "b": found[edges[:, 1]]})

    def routed(parts: dict[tuple[int, int], int]) -> DataFrame:
        return nodes.select("fingerprint").mapInArrow(route(parts), "tree long, shard long, block long, fingerprint long, home boolean")

    sizes = routed({}).groupBy("tree", "shard").agg(F.count("*").alias("n")).where(F.col("n") > LARGEST)
    parts = {(r.tree, r.shard): -(-r.n // LARGEST) for r in sizes.collect()}  # at most as many as the sample has shards
    return routed(parts).groupBy("tree", "shard", "block").applyInPandas(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: large and small stars in turn until nothing changes."""
    forest = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = forest.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return forest.select(F.col("a").alias("node"), F.col("b").alias("root")).union(forest.select("b", "b")).distinct()
        state = now
        both = forest.union(forest.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        forest = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")


def _rooted(prints: DataFrame, least, radius: int, sample: int, shard: int) -> DataFrame:
    """(fingerprint, least of its rows, root of its group) of every distinct fingerprint."""
    nodes = stored(prints.groupBy("fingerprint").agg(F.min(least).alias("least")), "nodes")
    roots = stored(components(links(nodes, radius, sample, shard)), "roots")
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left")
    return rooted.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the least id of its group."""
    prints = stored(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    rooted = _rooted(prints, F.col("id"), radius, sample, shard)
    label = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(label, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """One row of each group, every column as it was: one with the group's least id (null is the greatest).

    Rows are told apart by 128 bits of hashes of id and text; of rows equal in both any one stays.
    """
    key = {"_key": F.xxhash64(id_column, text_column), "_check": F.xxhash64(F.lit(SEED), text_column, id_column)}
    keyed = docs.withColumns(key)
    prints = stored(fingerprints(keyed, id_column, text_column, shingle, [*key]), "fingerprints")
    rooted = _rooted(prints, F.struct(F.col("id").isNull().alias("absent"), "id", *key), radius, sample, shard)
    stay = rooted.groupBy("root").agg(F.min("least").alias("least")).select(*(f"least.{c}" for c in key))
    return keyed.join(stay, [*key], "left_semi").dropDuplicates([*key]).drop(*key)
