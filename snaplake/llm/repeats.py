"""Removal of repeated byte strings: the suffixes of anchors, ordered to a bounded depth digit by digit.

Two equal strings of ``length`` bytes select the same anchor inside themselves: the leftmost of the
places whose next ``GRAM`` bytes have the least hash. So only suffixes at anchors need ordering, about
one in 75 places, each to the depth of the strings it stands for (those whose anchor it is). Digits, most
significant first:

1. the gram at the anchor. A group of one holds no repeat and leaves.
2. all bytes of all strings the anchor stands for. Where a group of equal grams has only one such class,
   or a class has several members, all strings of its members are repeats. One member of each class
   stays in the game for the others.
3. what is left, the edges of repeated passages: each single string. Equal groups are exactly the repeats.

Places of a text with the same two digits (a line it repeats) are one row from the start. Groups are counted
with map-side combination and joined back, so neither a passage that a third of all texts hold nor a group
of many copies meets in one task. Digits are compared by 64-bit hashes, together
128 bits and more. What is removed is the union of the repeated strings, judged on the input.

Edge cases: null is the empty text (null stays null in ``remove_repeats``); texts shorter than ``length``
lose nothing; repeated rows, also with equal ids, are each other's repeats; a string may repeat within its
own text, overlapping itself. An empty table gives no rows. Only the id and text columns are read by
``spans``; ``remove_repeats`` carries the others as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.store import stored
from snaplake.llm.text import BYTES, Rolling, Texts, blocks, mix

LENGTH = 200
GRAM = 50

_OTHER = Rolling(0xA0761D6478BD642F, seed=21)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each window of ``width`` values, leftmost of equal ones (by their high bits)."""
    n = len(values)
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = values >> bits << bits | np.arange(n, dtype=np.uint64)
    grid = np.full(-(-n // width) * width, ~np.uint64(0))
    grid[:n] = packed
    grid = grid.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[: n - width + 1], forward[width - 1 : n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _anchors(part: Texts, length: int, gram: int):
    """Of each anchor of a block: text, first and last start of its strings, its place, and the two first digits."""
    empty = np.zeros(0, np.int64)
    count = np.maximum(part.ends - part.starts - length + 1, 0)
    if not count.any():
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sums = BYTES.sums(part.data)
    at = np.arange(len(part.data) - gram + 1)
    grams = BYTES.spans(sums, at, at + gram)
    least = window_minimum(grams, length - gram + 1)
    text = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + part.starts[text]
    anchor = least[start]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(new[1:], len(start)) - 1
    first, last, anchor, text = start[new], start[last], anchor[new], text[new]
    shape = ((anchor - first) << 32 | (last - first)).astype(np.uint64)
    whole = mix(BYTES.spans(sums, first, last + length) ^ shape * np.uint64(0x9E3779B97F4A7C15))
    return text, first, last, anchor, grams[anchor], whole


#: Groups with more open members than this are settled string by string instead of in one task.
HOT = 1 << 15


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("row", F.xxhash64("id", "text"))


def _by_class(text: np.ndarray, gram: np.ndarray, whole: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The first anchor of each text, gram and whole, and the places of the others (null without any)."""
    key = mix(gram ^ whole * np.uint64(0x9E3779B97F4A7C15) ^ text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    begin = np.concatenate(([True], key[order][1:] != key[order][:-1]))[: len(order)]
    starts = np.flatnonzero(begin)
    others = np.diff(np.append(starts, len(order))) - 1
    offsets = pa.array(np.concatenate(([0], np.cumsum(others))), pa.int32())
    return order[starts], pa.ListArray.from_arrays(offsets, pa.array(place[order[~begin]]), mask=pa.array(others == 0))


def anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, place, more, gram, whole) of all anchors; a place packs first start, last start and anchor."""
    names = ["row", "place", "more", "gram", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(1).to_numpy()
            for part in blocks(batch.column(0), limit=1 << 18):
                text, first, last, anchor, gram_hash, whole = _anchors(part, length, gram)
                place = (first - part.starts[text]) << 24 | (last - first) << 12 | (anchor - first)
                one, more = _by_class(text, gram_hash, whole, place)
                made = (row[part.first + text[one]], place[one], more, gram_hash[one].view(np.int64), whole[one].view(np.int64))
                yield pa.RecordBatch.from_arrays([x if x is more else pa.array(x) for x in made], names=names)

    return keyed.select("text", "row").mapInArrow(run, "row long, place long, more array<long>, gram long, whole long")


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = place >> 24
    return first, first + (place >> 12 & 0xFFF), first + (place & 0xFFF)


def settle(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all anchors: (row, places) whose strings are all repeats; (row, place, gram, hot) still open.

    Counts are stored before they are joined back: with plain exchanges on both sides Spark can split a hot key.
    """
    times = F.sum(1 + F.coalesce(F.array_size("more"), F.lit(0)))
    groups = found.groupBy("gram").agg(times.alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    groups = stored(groups.where("n > 1").select("gram", (F.col("least") == F.col("most")).alias("one")), "groups")
    repeated = stored(found.join(groups, "gram"), "repeated")
    mixed = repeated.where("NOT one")
    classes = mixed.groupBy("gram", "whole").agg(times.alias("n"), F.min(F.struct("row", "place")).alias("member"))
    classes = stored(classes, "classes")
    several = mixed.join(classes.where("n > 1"), ["gram", "whole"])
    places = F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<bigint>"))).alias("places")
    settled = repeated.where("one").select("row", places).union(several.select("row", places))
    still = classes.select("gram", "member.row", "member.place")
    large = still.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gram", F.lit(True).alias("hot"))
    return settled, still.join(large, "gram", "left").select("row", "place", "gram", F.coalesce("hot", F.lit(False)).alias("hot"))


def _open_contexts(length: int):
    """(key, other, row, first, last, bytes): the bytes around open anchors, and the single strings of hot ones."""
    names = ["key", "other", "row", "first", "last", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            rows, at = batch.column(2).to_numpy(), lists.offsets.to_numpy()
            items = lists.values
            place, gram, hot = (items.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            first, last, _ = _unpacked(place)
            for part in blocks(batch.column(1)):
                other = None
                for i in range(len(part.starts)):
                    r = part.first + i
                    mine = slice(at[r], at[r + 1])
                    cold = np.flatnonzero(~hot[mine]) + at[r]
                    begin = part.starts[i]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(gram[cold]), pa.array(np.zeros(len(cold), np.int64)), pa.array(np.full(len(cold), rows[r])),
                            pa.array(first[cold]), pa.array(last[cold]),
                            pa.array([part.data[begin + a : begin + b + length].tobytes() for a, b in zip(first[cold], last[cold], strict=True)], pa.binary()),
                        ],
                        names=names,
                    )
                    warm = np.flatnonzero(hot[mine]) + at[r]
                    if not len(warm):
                        continue
                    if other is None:
                        sums, other = BYTES.sums(part.data), _OTHER.sums(part.data)
                    start = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[warm], last[warm], strict=True)])
                    keys = (x.spans(y, begin + start, begin + start + length).view(np.int64) for x, y in ((BYTES, sums), (_OTHER, other)))
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, keys), pa.array(np.full(len(start), rows[r])), pa.array(start), pa.array(start), pa.nulls(len(start), pa.binary())],
                        names=names,
                    )

    return run


def _settle_groups(length: int):
    """Of groups of contexts, sorted by key: (row, first, last) of the runs of strings that stand twice in a group."""

    def repeats(table: pa.Table) -> pa.RecordBatch:
        key, row, first, last = (table[c].to_numpy() for c in ("key", "row", "first", "last"))
        column = table["bytes"].combine_chunks().cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        sums = BYTES.sums(data)
        count = last - first + 1
        member = np.repeat(np.arange(len(count)), count)
        shift = np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count)
        at = (offsets[:-1] - offsets[0])[member] + shift
        string = mix(BYTES.spans(sums, at, at + length) ^ key.view(np.uint64)[member] * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, times = np.unique(string, return_inverse=True, return_counts=True)
        twice = times[inverse] > 1
        begin = twice & np.concatenate(([True], ~twice[:-1] | (member[1:] != member[:-1])))
        end = twice & np.concatenate((~twice[1:] | (member[1:] != member[:-1]), [True]))
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
        return pa.RecordBatch.from_arrays(
            [pa.array(row[member[begin]]), pa.array(first[member[begin]] + shift[begin]), pa.array(first[member[end]] + shift[end])], names=["row", "first", "last"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key = table["key"].to_numpy()
            before = np.flatnonzero(key != key[-1]) if len(key) else []
            whole = int(before[-1]) + 1 if len(before) else 0
            if whole:
                yield repeats(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and len(rest):
            yield repeats(rest)

    return run


def spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, runs): for each text with repeats, places that hold the first and last starts of its repeated strings."""
    settled, still = settle(anchors(keyed, length, gram))
    places = still.groupBy("row").agg(F.collect_list(F.struct("place", "gram", "hot")).alias("places"))
    texts = keyed.join(places, "row").select("id", "text", "row", "places")
    opened = texts.mapInArrow(_open_contexts(length), "key long, other long, row long, first long, last long, bytes binary")
    opened = stored(opened, "contexts")
    cold = opened.where("bytes IS NOT NULL").select("key", "row", "first", "last", "bytes")
    cold = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_settle_groups(length), "row long, first long, last long")
    hot = opened.where("bytes IS NULL")
    twice = stored(hot.groupBy("key", "other").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "strings")
    hot = hot.join(twice, ["key", "other"]).select("row", "first", "last")
    place = F.shiftleft("first", 24).bitwiseOR(F.shiftleft(F.col("last") - F.col("first"), 12))
    opened = cold.union(hot).select("row", F.array(place).alias("places"))
    return settled.union(opened).groupBy("row").agg(F.flatten(F.collect_list("places")).alias("runs"))


def _covered(part: Texts, first: np.ndarray, last: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a block repeated strings cover; ``at`` delimits each text's runs."""
    edge = np.zeros(len(part.data) + 1, np.int32)
    lo, hi = at[part.first], at[part.first + len(part.starts)]
    base = part.starts[np.repeat(np.arange(len(part.starts)), np.diff(at[part.first : part.first + len(part.starts) + 1]))]
    np.add.at(edge, base + first[lo:hi], 1)
    np.subtract.at(edge, base + last[lo:hi] + length, 1)
    return np.cumsum(edge[:-1]) > 0


def _runs_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First starts, last starts and the offsets of each row's; a null list is empty."""
    at = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64))))
    first, last, _ = _unpacked(column.flatten().to_numpy())
    return first, last, at


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: id, bytes, bytes removed, maximal removed runs, SHA-256 of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, at = _runs_of(batch.column(2))
            rows = []
            for part in blocks(batch.column(1)):
                gone = _covered(part, first, last, at, length)
                removed = np.concatenate(([0], np.cumsum(gone)))
                begin = gone & ~np.concatenate(([False], gone[:-1]))
                begin[part.starts[part.starts < part.ends]] |= gone[part.starts[part.starts < part.ends]]
                begun = np.concatenate(([0], np.cumsum(begin)))
                for a, b in zip(part.starts.tolist(), part.ends.tolist(), strict=True):
                    n = int(removed[b] - removed[a])
                    kept = part.data[a:b][~gone[a:b]] if n else part.data[a:b]
                    rows.append((b - a, n, int(begun[b] - begun[a]), hashlib.sha256(kept).hexdigest()))
            made = zip(*rows, strict=True) if rows else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    keyed = _keyed(docs, id_column, text_column)
    joined = keyed.join(spans(keyed, length, gram), "row", "left").select("id", "text", "runs")
    kind = keyed.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_column)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All documents and columns, without the repeated strings; characters that a cut splits go as a whole."""
    names = docs.columns
    place, width = names.index(text_column), len(names)

    def cut(part: Texts, gone: np.ndarray) -> Iterator[str]:
        for a, b in zip(part.starts, part.ends, strict=True):
            yield part.data[a:b][~gone[a:b]].tobytes().decode(errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, at = _runs_of(batch.column(width))
            old = batch.column(place)
            new = pa.array([t for part in blocks(old) for t in cut(part, _covered(part, first, last, at, length))], pa.string())
            columns = list(batch.columns[:width])
            columns[place] = pc.if_else(old.is_null(), old, new)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    keyed = _keyed(docs, id_column, text_column)
    named = docs.withColumn("_key", F.xxhash64(id_column, text_column))
    found = spans(keyed, length, gram)
    joined = named.join(found, named["_key"] == found["row"], "left").select(*(named[c] for c in docs.columns), "runs")
    return joined.mapInArrow(run, docs.schema)
