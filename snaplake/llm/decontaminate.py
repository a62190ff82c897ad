"""Benchmark decontamination: a broadcast set of normalised item n-grams, scanned over whole texts.

Words are lower-cased runs of digits, letters and non-ASCII characters. A window is 13 consecutive
words of an item; an item of fewer words is one window, an item without words none. Hash hits are
verified word by word before they count.

Edge cases: a null text has no words, no hits and is not contaminated; an empty benchmark marks
nothing; items with equal ids count once, an item with a null id counts as the id "". Repeated rows
are judged one by one. ``scan`` reads the two named columns only, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.text import ITEMS, LOWER, Texts, blocks, owner, runs, span_keys

WINDOW = 13
#: A broadcast carries the windows of at most so many bytes of benchmark text. A larger benchmark is
#: scanned block by block, each block within this bound.
BENCHMARK_BYTES = 32 << 20
#: A filter before the search has so many places a window, and this power of two of them at most.
FILTER_SHARE, FILTER_BITS = 64, 22

_WORD = np.ones(256, dtype=bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _words(part: Texts):
    """Lower-cased bytes, and start, end and text number of every word."""
    low = LOWER[part.data]
    starts, ends = runs(_WORD[low])
    return low, starts, ends, owner(part.starts, starts)


class Windows:
    """The distinct windows of a block of the benchmark: by length, sorted hashes with words and items."""

    def __init__(self, rows: list[tuple[object, str | None]], window: int = WINDOW):
        found: dict[int, dict[int, tuple[bytes, set[str]]]] = {}
        ids = ["" if r[0] is None else str(r[0]) for r in rows]
        for part in blocks(pa.array([r[1] for r in rows], pa.string()), pad=1):
            low, starts, ends, text = _words(part)
            words = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            sums = ITEMS.sums(span_keys(low, starts, ends))
            count = np.bincount(text, minlength=len(part.starts))
            first = np.cumsum(count) - count
            for i, n in enumerate(count):
                m = min(int(n), window)
                at = np.arange(first[i], first[i] + n - m + 1) if m else np.zeros(0, np.int64)
                for j, h in zip(at, ITEMS.spans(sums, at, at + m).tolist(), strict=True):
                    entry = found.setdefault(m, {}).setdefault(h, (b" ".join(words[j : j + m]), set()))
                    entry[1].add(ids[part.first + i])
        self.by_length = []
        for m, entries in sorted(found.items()):
            keys = np.array(sorted(entries), np.uint64)
            shift = np.uint64(64 - min(FILTER_BITS, (FILTER_SHARE * len(keys)).bit_length()))
            maybe = np.zeros(1 << (64 - int(shift)), bool)
            maybe[keys >> shift] = True
            held = [entries[int(k)] for k in keys]
            self.by_length.append((m, keys, shift, maybe, [h[0] for h in held], [sorted(h[1]) for h in held]))

    def hits(self, part: Texts) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Of each text: its number of words, whether each word (of all texts) is hit, the items found."""
        low, starts, ends, text = _words(part)
        count = np.bincount(text, minlength=len(part.starts))
        last = np.cumsum(count)[text]
        edge = np.zeros(len(starts) + 1, np.int64)
        items: list[set[str]] = [set() for _ in part.starts]
        sums = ITEMS.sums(span_keys(low, starts, ends)) if len(starts) else None
        for m, keys, shift, maybe, texts, ids in self.by_length if sums is not None else ():
            at = np.flatnonzero(np.arange(len(starts)) + m <= last)
            h = ITEMS.spans(sums, at, at + m)
            near = maybe[h >> shift]
            at, h = at[near], h[near]
            key = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[key] == h
            for i, k in zip(at[same].tolist(), key[same].tolist(), strict=True):
                if b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + m], ends[i : i + m], strict=True)) == texts[k]:
                    edge[i] += 1
                    edge[i + m] -= 1
                    items[text[i]].update(ids[k])
        return count, np.cumsum(edge[:-1]) > 0, items


def benchmark_blocks(benchmark: DataFrame, id_column: str, text_column: str, window: int = WINDOW, limit: int = BENCHMARK_BYTES):
    """The benchmark's windows in blocks of about ``limit`` bytes of text each, one after another."""
    items = benchmark.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-int(size) // limit)
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield Windows([tuple(r) for r in block.collect()], window)


def _verdict(words: int, hit: int, items: set[str]) -> tuple:
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return words, hit, len(items), digest, hit > 0 and 20 * hit >= words


def scan(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id, words, words inside an occurrence of a window, items found, and the verdict."""
    spark = docs.sparkSession
    found = list(_broadcasts(spark, benchmark, item_column, item_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for part in blocks(batch.column(1), pad=1) for r in _judge(part, found)]
            words, hit, n, digest, bad = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, hit, n)), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())],
                names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_column)


def _broadcasts(spark, benchmark, item_column, item_text):
    for windows in benchmark_blocks(benchmark, item_column, item_text):
        yield spark.sparkContext.broadcast(windows)


def _judge(part: Texts, found) -> list[tuple]:
    """Hits of all benchmark blocks together; a word is hit if any block hits it."""
    count, hit, items = None, None, None
    for held in found:
        n, h, i = held.value.hits(part)
        count, hit, items = (n, h, i) if count is None else (n, hit | h, [a | b for a, b in zip(items, i, strict=True)])
    if count is None:
        count, hit, items = Windows([]).hits(part)
    ends = np.cumsum(count)
    total = np.concatenate(([0], np.cumsum(hit)))
    hits = total[ends] - total[ends - count]
    return [_verdict(int(n), int(h), i) for n, h, i in zip(count, hits, items, strict=True)]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that are not contaminated, every column as it was."""
    found = list(_broadcasts(docs.sparkSession, benchmark, "item_id", "text"))
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not r[4] for part in blocks(batch.column(place), pad=1) for r in _judge(part, found)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """Every document, without the runs of hit words (from a run's first word to the end of its last)."""
    found = list(_broadcasts(docs.sparkSession, benchmark, "item_id", "text"))
    place = docs.columns.index(text_column)

    def cut(part: Texts) -> Iterator[str]:
        _, starts, ends, text = _words(part)
        hit = np.zeros(len(starts), bool)
        for held in found:
            hit |= held.value.hits(part)[1]
        a, b = runs(hit)
        for i, (start, end) in enumerate(zip(part.starts, part.ends, strict=True)):
            drop = np.zeros(end - start, bool)
            for x, y in zip(a, b, strict=True):
                lo, hi = max(x, np.searchsorted(text, i)), min(y, np.searchsorted(text, i, side="right"))
                if lo < hi:
                    drop[starts[lo] - start : ends[hi - 1] - start] = True
            yield part.data[start:end][~drop].tobytes().decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([t for part in blocks(batch.column(place), pad=1) for t in cut(part)], pa.string())
            old = batch.column(place)
            columns = [c if i != place else pc.if_else(old.is_null(), old, new) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
