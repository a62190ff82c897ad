"""Document fingerprints from closed syncmers, and how alike two fingerprints are.

A closed syncmer is a string of ``K`` bytes whose least inner string of ``S`` bytes is its first or its
last: whether a place is an anchor depends on its own bytes alone, so an edit moves only the anchors it
touches. Each anchor is an element of the document's multiset (the n-th occurrence of a string is an
element of its own). The fingerprint keeps the ``SIZE`` elements with the least hashes, each with its
place. Likeness compares the least elements of the union: those in both fingerprints whose places run in
the same order in both, by the number compared.

Edge cases: a text without anchors but not empty has one element, itself; the empty text (and null) has
the empty fingerprint, like only another empty one (likeness 1). Equal texts have equal fingerprints.
Documents follow each other by descending id; null ids come last, equal ids by text; the last is followed
by the first. A single document is its own next one. Repeated rows are separate documents. Very long texts are read
whole, one block at a time each; places in them are never cut. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.text import BYTES, Texts, blocks, mix, owner
from snaplake.llm.repeats import window_minimum

K, S = 16, 8
SIZE = 64
#: Neighbouring documents are brought together in ranges of about so many bytes of text.
RANGE_BYTES = 1 << 20
RANGES = 1 << 16

Print = dict[int, int]
"""Element (32 bits of its hash) to place, in units of 16 bytes."""


def anchors(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it and hash of every closed syncmer of a block."""
    if len(part.data) < K:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64)
    sums = BYTES.sums(part.data)
    at = np.arange(len(part.data) - S + 1)
    inner = window_minimum(BYTES.spans(sums, at, at + S), K - S + 1)
    at = at[: len(inner)]
    at = at[(inner == at) | (inner == at + K - S)]
    text = owner(part.starts, at)
    inside = at + K <= part.ends[text]
    at, text = at[inside], text[inside]
    return text, at - part.starts[text], BYTES.spans(sums, at, at + K)


def prints(texts: list[str]) -> list[Print]:
    """The fingerprint of each text."""
    out: list[Print] = []
    for part in blocks(pa.array(texts, pa.string()), limit=1 << 18):
        text, place, gram = anchors(part)
        count = np.bincount(text, minlength=len(part.starts))
        lone = np.flatnonzero((count == 0) & (part.ends > part.starts))
        if len(lone):
            whole = BYTES.spans(BYTES.sums(part.data), part.starts[lone], part.ends[lone])
            text, place, gram = np.append(text, lone), np.append(place, np.zeros(len(lone), np.int64)), np.append(gram, whole)
        own = mix(gram ^ text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own, kind="stable")
        begin = np.concatenate(([True], own[order][1:] != own[order][:-1]))[: len(order)]
        rank = np.arange(len(order))
        nth = np.empty(len(order), np.uint64)
        nth[order] = rank - np.maximum.accumulate(np.where(begin, rank, 0))
        element = mix(gram + nth * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)
        # only elements that can be among the least of their text are sorted: with n elements, those below 4 SIZE / n
        count = np.bincount(text, minlength=len(part.starts))
        bound = np.minimum(4.0 * SIZE / np.maximum(count, 1), 1.0) * 2.0**32
        low = np.flatnonzero(element < bound[text])
        few = np.bincount(text[low], minlength=len(count)) < np.minimum(count, SIZE)
        if few.any():
            low = np.flatnonzero((element < bound[text]) | few[text])
        low = low[np.lexsort((place[low], element[low], text[low]))]
        edges = np.searchsorted(text[low], np.arange(len(count) + 1))
        elements, places = element[low].tolist(), (place[low] // 16).tolist()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            found: Print = {}
            for i in range(a, b):
                if len(found) == SIZE:
                    break
                found.setdefault(elements[i], places[i])
            out.append(found)
    return out


def written(found: Print) -> str:
    """Elements in ascending order with their places, 8 hex digits each: enough for the places of any text."""
    return "".join(f"{e:08x}{p:08x}" for e, p in found.items())


def read(fingerprint: str) -> Print:
    """What ``written`` has written: likeness can be had from two stored fingerprints."""
    parts = (fingerprint[i : i + 16] for i in range(0, len(fingerprint), 16))
    return {int(x[:8], 16): int(x[8:], 16) for x in parts}


def likeness(a: Print, b: Print) -> float:
    if a == b:
        return 1.0
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    compared = sorted(a.keys() | b.keys())[:SIZE]
    pairs = sorted((a[e], b[e]) for e in compared if e in both)
    tails: list[int] = []  # the longest run of places that does not go back
    for _, p in pairs:
        at = bisect_left(tails, p + 1)
        tails[at : at + 1] = [p]
    return len(tails) / len(compared)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _ranges(source: DataFrame) -> np.ndarray:
    """Ids that stand in the table and cut it into ranges, descending: each is the largest id of its range."""
    size, largest = source.agg(F.sum(F.octet_length("text")), F.max("id")).first()
    n = int(min(RANGES, (size or 0) // RANGE_BYTES))
    if n < 2 or largest is None:
        return np.zeros(0, np.int64)
    sample = source.select("id").where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(4 * n).toArrow()["id"].to_numpy()
    ids = np.unique(np.append(np.sort(sample)[::4], largest))
    return ids[::-1].astype(np.int64)


def fingerprint_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and its likeness to that and to the next document's."""
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    heads = _ranges(source)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        if not len(heads):
            return pd.Series(np.zeros(len(ids), np.int32))
        found = len(heads) - 1 - np.searchsorted(heads[::-1], ids.fillna(heads[-1]).to_numpy(np.int64))
        return pd.Series(np.where(ids.isna(), len(heads) - 1, found).astype(np.int32))

    ranged = source.withColumn("range", range_of("id"))
    if len(heads) > 1:
        # the head of each range also ends the range before it, and the first head the last range
        spark = docs.sparkSession
        before = [(int(h), (k - 1) % len(heads)) for k, h in enumerate(heads)]
        also = F.broadcast(spark.createDataFrame(before, "id long, before int"))
        own = F.struct(F.col("range"), F.lit(False).alias("ghost"))
        ghost = F.struct(F.col("before").alias("range"), F.lit(True).alias("ghost"))
        ranged = ranged.join(also, "id", "left").select("id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ghost))).alias("at"))
        ranged = ranged.select("id", "text", "at.range", "at.ghost")
    else:
        ranged = ranged.withColumn("ghost", F.lit(False))
    ordered = ranged.repartition("range").sortWithinPartitions("range", "ghost", F.col("id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next one is not known yet: the last of a batch
        first: tuple | None = None  # the first row of the range at hand
        for batch in batches:
            ids, texts, ranges, ghosts = (c.to_pylist() for c in batch.select(["id", "text", "range", "ghost"]).columns)
            rows = held + list(zip(ids, texts, ranges, ghosts, prints(texts), strict=True))
            done = []
            for row, after in zip(rows, rows[1:], strict=False):
                first = row if first is None or first[2] != row[2] else first
                if not row[3]:
                    done.append((row, after if after[2] == row[2] else first))
            held = rows[-1:]
            yield answer(done)
        if held and not held[0][3]:
            first = held[0] if first is None or first[2] != held[0][2] else first
            yield answer([(held[0], first)])

    def answer(pairs: list[tuple]) -> pa.RecordBatch:
        changed = [edited(row[1], after[1]) for row, after in pairs]
        found = prints(changed)
        columns = (
            ([row[0] for row, _ in pairs], pa.int64()),
            ([len(row[1]) for row, _ in pairs], pa.int64()),
            ([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            ([written(row[4]) for row, _ in pairs], pa.string()),
            ([written(p) for p in found], pa.string()),
            ([likeness(row[4], p) for (row, _), p in zip(pairs, found, strict=True)], pa.float64()),
            ([likeness(row[4], after[4]) for row, after in pairs], pa.float64()),
        )
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns], names=names)

    out = ordered.mapInArrow(
        run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumnRenamed("id", id_column)
