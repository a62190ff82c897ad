"""Best-fit packing of tokenised documents, after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. Packing needs only how many pieces have each
length, at most ``capacity`` numbers: on them the reduction fixes every small set of pieces that
dominates all other sets with its longest piece, and best-fit (longest first) packs what is left.
The plan says which length takes which places; a piece finds its place by its rank among the pieces
of its length, counted in salted groups, so a length that a third of all pieces share is no hot key.

Edge cases: a null text is the empty text, one piece holding only the end id. Repeated rows, with equal
ids too, are separate documents. An empty table gives no rows. Special strings inside a text are what
the library makes of them. Only the id and text columns are read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm.store import stored
from snaplake.llm.text import LOWER, Known, Texts, blank, blocks, span_keys, spread

CAPACITY = 4096
END = 1
SALTS = 256

_PLAIN = np.zeros(256, bool)  # letters and digits of ASCII
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)  # other visible ASCII; an apostrophe can start a token with letters after it
_MARK[[b for b in range(0x21, 0x7F) if not _PLAIN[b] and b != ord("'")]] = True


class Encoder:
    """Token ids by the library, asked once for each unit of text it has not met.

    The vocabulary lower-cases, drops white space, and never puts a letter or digit into one token with
    other characters but after an apostrophe. So texts can be cut at white space and where an ASCII
    letter or digit stands next to another visible ASCII character that is no apostrophe.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)).encode() or rb"(?!)")
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.at = Known(1 << 19), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> np.ndarray:
        found = self._encode(texts)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))
        self.ids = np.concatenate((self.ids, flat))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(lengths)))
        return self.known.add(keys)

    def encode(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a padded block one after another, and how many each text has; no end ids yet."""
        low = LOWER[part.data]
        inside = ~blank(low)
        plain, mark = _PLAIN[low], _MARK[low]
        cut = inside[1:] & (~inside[:-1] | plain[1:] & mark[:-1] | mark[1:] & plain[:-1])
        starts = np.flatnonzero(cut) + 1
        stop = np.flatnonzero(~inside)
        ends = np.minimum(np.append(starts[1:], len(low)), stop[np.searchsorted(stop, starts)])
        key = span_keys(low, starts, ends)
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        slot, known = self.known.find(unique)
        if not known.all():
            if self.known.full(int((~known).sum())):
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            slot[new] = self._learn(unique[new], [low[starts[i] : ends[i]].tobytes().decode() for i in first[new]])
        slot = slot[inverse]
        lengths = self.at[slot + 1] - self.at[slot]
        row, place = spread(lengths)
        ids = self.ids[self.at[slot][row] + place]
        text = np.searchsorted(part.ends, starts, side="right")
        count = np.bincount(text, weights=lengths, minlength=len(part.starts)).astype(np.int64)
        if self.special.search(part.data):
            ids, count = self._with_special(part, ids, count)
        return ids, count

    def _with_special(self, part: Texts, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum(count)
        rows = [ids[e - n : e] for e, n in zip(end, count, strict=True)]
        for i in range(len(rows)):
            if self.special.search(text := part.text(i)):
                rows[i] = np.array(self._encode([text.decode()])[0], np.uint32)
        return np.concatenate(rows), np.array(list(map(len, rows)), np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, kept between its tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
           capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """Per piece of a document: id, piece, start, length and the CRC-32 of its ids."""

    def rows(part: Texts, coder: Encoder) -> Iterator[tuple]:
        ids, count = coder.encode(part)
        stop = np.cumsum(count)
        for i, (n, s) in enumerate(zip(count.tolist(), stop.tolist(), strict=True)):
            whole = np.append(ids[s - n : s], np.uint32(end_id)).astype("<u4")
            for k, at in enumerate(range(0, n + 1, capacity)):
                piece = whole[at : at + capacity]
                yield part.first + i, k, at, len(piece), zlib.crc32(piece.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            found = [r for part in blocks(batch.column(1), pad=1) for r in rows(part, coder)]
            row, piece, start, length, crc = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


Bins = list[tuple[int, list[tuple[int, int]]]]
"""(how many bins, the (length, how many) they hold)"""


def reduce_by_dominance(count: dict[int, int], capacity: int) -> Bins:
    """Fix sets that dominate: take them out of ``count``, return them as bins.

    For the longest piece j and the longest k that fits beside it, {j, k} dominates every other set with
    j if k fills the bin, if no two other pieces fit beside j, or if only pairs do and none exceeds k.
    {j} alone does if nothing fits. The reduction goes on until the longest piece has no such set; exact
    complements are fixed whatever their place in the order.
    """
    bins: Bins = []
    lengths = sorted(n for n, c in count.items() if c)

    def fix(j: int, k: int | None) -> None:
        n = count[j] if k is None else count[j] // 2 if k == j else min(count[j], count[k])
        bins.append((n, [(j, 1)] if k is None else [(j, 2)] if k == j else [(j, 1), (k, 1)]))
        for x in {j, k} - {None}:
            count[x] -= 2 * n if k == j else n
            if not count[x]:
                lengths.pop(bisect_left(lengths, x))

    for j in reversed(lengths.copy()):
        k = capacity - j
        if count.get(j) and (count.get(k) if k != j else count[j] > 1):
            fix(j, k)
    while lengths:
        j = lengths[-1]
        room = capacity - j
        others = [n for n in lengths if n != j or count[j] > 1]
        fit = bisect_left(others, room + 1)
        if not fit:
            fix(j, None)
            continue
        k, least = others[fit - 1], others[0]
        second = least if count[least] - (least == j) > 1 else others[1] if fit > 1 else room
        third = least if count[least] - (least == j) > 2 else second
        alone = least + second > room
        pairs_only = least + second + third > room
        if alone or (pairs_only and k >= _best_pair(others[:fit], count, j, room)):
            fix(j, k)
        else:
            break
    return bins


def _best_pair(lengths: list[int], count: dict[int, int], j: int, room: int) -> int:
    """The most that two pieces beside j can fill."""
    best, hi = 0, len(lengths) - 1
    for lo, x in enumerate(lengths):
        while hi >= 0 and x + lengths[hi] > room:
            hi -= 1
        if hi < lo:
            break
        y = lengths[hi]
        if hi == lo and count[x] - (x == j) < 2:
            y = lengths[hi - 1] if hi else 0
        best = max(best, x + y if y else 0)
    return best


def best_fit(count: dict[int, int], capacity: int) -> Bins:
    """Best fit, longest first, all pieces of a length at once: each goes to the fullest bin that takes it."""
    open_bins: dict[int, Bins] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, n: int, held: list[tuple[int, int]]) -> None:
        if n:
            if not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append((n, held))

    for length in sorted((n for n, c in count.items() if c), reverse=True):
        left = count[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, n, held = capacity, -(-left // (capacity // length)), []
            else:
                room = rooms[at]
                n, held = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
            per = room // length
            whole = min(n, left // per)
            put(room - per * length, whole, [*held, (length, per)])
            left -= whole * per
            if whole < n and left:
                put(room - left * length, 1, [*held, (length, left)])
                whole, left = whole + 1, 0
            put(room, n - whole, held) if held else None
    return [b for bins in open_bins.values() for b in bins]


class Places:
    """Where the r-th piece of a length goes, for a list of bins."""

    def __init__(self, bins: Bins):
        taken: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for n, held in bins:
            offset = 0
            for length, per in held:
                rows.append((length, taken[length], per, sequence, offset))
                taken[length] += n * per
                offset += length * per
            sequence += n
        rows.sort()
        self.length, self.first, self.per, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.sequences = sequence

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece; (length, first) pairs are searched as one number."""
        at = np.searchsorted(self.length << 48 | self.first, length << 48 | rank, side="right") - 1
        r = rank - self.first[at]
        return self.sequence[at] + r // self.per[at], self.offset[at] + r % self.per[at] * self.length[at]


def pack(found: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Give the rows of ``pieces`` their sequence and the offset in it."""
    salted = stored(found.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts))), "pieces")
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most `capacity` rows: how many pieces there are of each length
    count = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    bins = reduce_by_dominance(count, capacity) + best_fit(count, capacity)
    places = salted.sparkSession.sparkContext.broadcast(Places(bins))
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            found = places.value.find(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *(pa.array(x, pa.int64()) for x in found)], names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

    kind = found.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, packed."""
    return pack(pieces(docs, path, id_column, text_column, capacity), capacity).withColumnRenamed("id", id_column)
