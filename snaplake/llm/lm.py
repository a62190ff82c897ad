"""Language-model scores: prediction by partial matching over byte contexts, beside a unigram base.

The model is a trie of up to ``ORDER`` preceding bytes, with counts of the byte (or end of text) that
followed, gathered from all training texts. A symbol is coded in the longest context seen; method D gives
escapes the share d / 2n (n symbols counted, d distinct), and after an escape the symbols of the longer
context are excluded from the shorter one. Because the symbols of a longer context are among those of the
shorter, what is excluded depends on the longer context alone, so each node stores it. Below the empty
context all symbols not seen are equally likely. Texts are scored and learned with A-Z lower-cased.

The trie is broadcast in blocks of at most ``MODEL_ENTRIES`` entries, by the last two context bytes: each
byte of a text is coded wholly within one block, so scores of several blocks add up. The base's token
counts are split: those of frequent tokens are broadcast (at most ``FREQUENT``), the others are joined, so
no joined token is frequent in the training texts.

Edge cases: a null text is empty (its end is still coded); without training texts every symbol has
probability 1/256 and c = N = V = 0. A null id is hashed as the empty text. Repeated rows are separate rows.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.store import stored
from snaplake.llm.text import LOWER, Texts, blank, blocks, owner, runs, span_keys

ORDER = 5
MODEL_ENTRIES = 1 << 23
FREQUENT = 1 << 19
END = 0xFF  # never a byte of UTF-8: the end of a text, and what stands before its start
END_TOKEN = -1
HELD_ENTRIES = 1 << 21
_SYMBOL_BITS = np.uint64(8)
_POSITION_BITS = 16


def _symbols(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of a padded block: contexts, nearest byte first, with the symbol last (48 bits); its text."""
    low = LOWER[part.data].astype(np.uint64)
    own = part.data != END
    own[part.ends] = True
    at = np.flatnonzero(own)
    key = low[at]
    for back in range(1, ORDER + 1):
        key = key | low[at - back] << np.uint64(8 * (ORDER + 1 - back))
    return key, owner(part.starts, at)


def _tokens(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word, end tokens left out."""
    low = LOWER[part.data]
    starts, ends = runs(~blank(low) & (low != END))
    return span_keys(low, starts, ends).view(np.int64), owner(part.starts, starts)


class _Tally:
    """Counts by key in bounded memory: ``add`` returns what has to leave, ``rest`` all that is left."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        key, count = np.unique(keys, return_counts=True)
        self.keys.append(key)
        self.counts.append(count)
        self.size += len(key)
        if self.size < 2 * HELD_ENTRIES:
            return []
        merged = self.rest()
        if len(merged[0][0]) > HELD_ENTRIES:
            return merged
        self.keys, self.counts, self.size = [merged[0][0]], [merged[0][1]], len(merged[0][0])
        return []

    def rest(self) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.keys:
            return []
        keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.size = [], [], 0
        return [(keys, counts)]


def gather(training: DataFrame) -> DataFrame:
    """(kind, key, n) of all training texts: kind 0 counts contexts with their symbol, kind 1 tokens."""

    def rows(kind: int, found) -> Iterator[pa.RecordBatch]:
        for keys, counts in found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "key", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = _Tally(), _Tally()
        for batch in batches:
            for part in blocks(batch.column(0), pad=ORDER, filler=END):
                ends = np.full(len(part.starts), END_TOKEN, np.int64)
                for kind, keys in enumerate((_symbols(part)[0], np.append(_tokens(part)[0], ends))):
                    yield from rows(kind, tallies[kind].add(keys))
        for kind, tally in enumerate(tallies):
            yield from rows(kind, tally.rest())

    return training.select("text").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=counts, minlength=len(unique))


class Trie:
    """Contexts of every order with their symbols, as sorted arrays."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray):
        """``keys`` may be one block of the full contexts; ``low_keys`` are all (last byte, symbol) pairs."""
        self.entries, self.count, self.contexts, self.total, self.distinct, self.hidden = [], [], [], [], [], []
        for k in range(ORDER + 1):
            own, n = (low_keys, low_counts) if k < 2 else (keys, counts)
            symbol = own & np.uint64(255)
            context = own >> np.uint64(8 * ((2 if k < 2 else ORDER + 1) - k))
            entry, count = _grouped(context << _SYMBOL_BITS | symbol, n)
            context, first = np.unique(entry >> _SYMBOL_BITS, return_index=True)
            edges = np.append(first, len(entry)).astype(np.int64)
            sums = np.concatenate(([0.0], np.cumsum(count)))
            hidden = np.zeros(len(context))
            if k and len(entry):
                parent = entry >> np.uint64(16) << _SYMBOL_BITS | entry & np.uint64(255)
                shared = self.count[k - 1][np.searchsorted(self.entries[k - 1], parent)]
                hidden = np.diff(np.concatenate(([0.0], np.cumsum(shared)))[edges])
            for held, value in zip(
                (self.entries, self.count, self.contexts, self.total, self.distinct, self.hidden),
                (entry, count, context, np.diff(sums[edges]), np.diff(edges).astype(float), hidden),
                strict=True,
            ):
                held.append(value)

    def code(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each distinct key."""
        out, symbol = np.zeros(len(keys)), keys & np.uint64(255)
        hidden, gone = np.zeros(len(keys)), np.zeros(len(keys))
        todo = np.arange(len(keys))
        for k in range(ORDER, -1, -1):
            if not len(todo):
                break
            context = keys[todo] >> np.uint64(8 * (ORDER + 1 - k))
            at, seen = _find(self.contexts[k], context)
            todo_seen, at = todo[seen], at[seen]
            entry, hit = _find(self.entries[k], context[seen] << _SYMBOL_BITS | symbol[todo_seen])
            n = self.total[k][at] - hidden[todo_seen]
            d = self.distinct[k][at] - gone[todo_seen]
            found, missed = todo_seen[hit], todo_seen[~hit]
            out[found] += np.log10((self.count[k][entry[hit]] - 0.5) / n[hit])
            some = d[~hit] > 0
            out[missed[some]] += np.log10(0.5 * d[~hit][some] / n[~hit][some])
            hidden[missed], gone[missed] = self.hidden[k][at[~hit]], self.distinct[k][at[~hit]]
            rest = np.ones(len(keys), bool)
            rest[found] = False
            todo = todo[rest[todo]]
        out[todo] -= np.log10(256 - gone[todo])
        return out

    def score(self, part: Texts, block: int, n_blocks: int) -> np.ndarray:
        """log10 probability of each text, of the symbols that this block of the trie codes."""
        key, text = _symbols(part)
        out = np.zeros(len(part.starts))
        if n_blocks > 1:
            mine = (key >> np.uint64(32)) % np.uint64(n_blocks) == block
            key, text = key[mine], text[mine]
        for a in range(0, len(key), 1 << _POSITION_BITS):
            some = key[a : a + (1 << _POSITION_BITS)]
            order = np.sort(some << np.uint64(_POSITION_BITS) | np.arange(len(some), dtype=np.uint64))
            ordered = order >> np.uint64(_POSITION_BITS)
            new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            cost = self.code(ordered[new])[np.cumsum(new) - 1]
            place = (order & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64) + a
            out += np.bincount(text[place], weights=cost, minlength=len(out))
        return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = df.select("key", "n").toArrow()
    return found["key"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(float)


def tries(counts: DataFrame, limit: int = MODEL_ENTRIES) -> Iterator[tuple[Trie, int, int]]:
    """The trie in blocks of about ``limit`` entries each, one after another."""
    entries = counts.where("kind = 0")
    size = entries.count()
    n = max(1, -(-size // limit))
    pair = F.shiftright("key", 40).bitwiseOR(F.lit(0)) * 256 + F.col("key").bitwiseAND(255)
    low = _arrays(entries.groupBy(pair.alias("key")).agg(F.sum("n").alias("n")))  # at most 256 x 256 rows
    for k in range(n):
        block = entries if n == 1 else entries.where(F.shiftright("key", 32) % n == k)
        yield Trie(*_arrays(block), *low), k, n


def score(docs: DataFrame, training: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          limit: int = MODEL_ENTRIES, frequent: int = FREQUENT) -> DataFrame:
    """Score every text of ``docs`` by a model of ``training``.

    Returns the id, n_tokens, n_known, train_tokens, base_score and score of each row.
    """
    spark = docs.sparkSession
    counts = stored(gather(training.select(F.col(text_column).alias("text"))), "counts")
    tokens = counts.where("kind = 1")
    size, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most 64 rows: how many tokens have a count of so many bits; the frequent ones fit the bound
    bits = {r.b: r.n for r in tokens.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count("*").alias("n")).collect()}
    least = max(bits, default=0) + 1
    while least > 1 and sum(n for b, n in bits.items() if b >= least - 1) <= frequent:
        least -= 1
    often = F.col("n") >= F.lit(1 << (least - 1) if least else 0)
    keys, n = _arrays(tokens.where(often))
    order = np.argsort(keys.view(np.int64))
    known = spark.sparkContext.broadcast((keys.view(np.int64)[order], n[order]))

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    passes = []
    for trie, block, n_blocks in tries(counts, limit):
        model = spark.sparkContext.broadcast(trie)
        passes.append(source.mapInArrow(_scan(model, block, n_blocks, known), f"id {kind}, place long, {_SCANNED}"))
    scanned = stored(passes[0], "scores")
    if len(passes) > 1:
        # the same rows in every pass, told apart by id and text; equal ones have equal scores
        same = ["id", "digest"]
        parts = scanned.select(*same, "score")
        for one in passes[1:]:
            parts = parts.union(one.select(*same, "score"))
        whole = parts.groupBy(*same).agg((F.sum("score") / F.count("*") * len(passes)).alias("whole"))
        scanned = scanned.alias("s").join(whole.alias("w"), F.col("s.id").eqNullSafe(F.col("w.id")) & (F.col("s.digest") == F.col("w.digest")))
        scanned = stored(scanned.select("s.id", "place", "n_tokens", "often_known", "often_score", "rare", F.col("whole").alias("score")), "scores")

    rare = scanned.select("place", F.explode("rare").alias("r")).select("place", "r.key", "r.times")
    joined = rare.join(tokens.where(~often).select("key", "n"), "key", "left")
    by_row = joined.groupBy("place").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_score"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    scale = float(np.log10(total + 0.5 * (size + 1)))
    return scanned.join(by_row, "place", "left").select(
        F.col("id").alias(id_column),
        "n_tokens",
        (F.col("often_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("often_score") + F.coalesce("rare_score", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        "score",
    )


_SCANNED = "digest long, n_tokens long, often_known long, often_score double, rare array<struct<key: long, times: long>>, score double"
_RARE = pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())]))


def _scan(model, block: int, n_blocks: int, known):
    """Per row: its place (unique), hash, tokens, what the frequent ones add, the other tokens, and its score."""

    def columns(part: Texts) -> list[np.ndarray | pa.Array]:
        keys, counts = known.value
        token, text = _tokens(part)
        rows = len(part.starts)
        token, text = np.append(token, np.full(rows, END_TOKEN)), np.append(text, np.arange(rows))
        at, found = _find(keys, token)
        log = np.where(found, np.log10(counts[at] + 0.5) if len(keys) else 0.0, 0.0)
        rare = np.array([text[~found], token[~found]])
        pairs, times = np.unique(rare, axis=1, return_counts=True) if rare.size else (rare, np.zeros(0, np.int64))
        edges = np.concatenate(([0], np.cumsum(np.bincount(pairs[0], minlength=rows)))).astype(np.int32)
        low = LOWER[part.data]
        return [
            span_keys(low, part.starts, part.ends).view(np.int64),
            np.bincount(text, minlength=rows),
            np.bincount(text[found], minlength=rows),
            np.bincount(text, weights=log, minlength=rows),
            pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(pairs[1]), pa.array(times)], ["key", "times"])),
            model.value.score(part, block, n_blocks),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in blocks(batch.column(1), pad=ORDER, filler=END):
                rows = len(part.starts)
                made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns(part)]
                ids = batch.column(0).slice(part.first, rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.arange(place, place + rows)), *made],
                    names=["id", "place", "digest", "n_tokens", "often_known", "often_score", "rare", "score"],
                )
                place += rows

    return run


def held_out(docs: DataFrame, id_column: str = "doc_id", folds: int = 5, fold: int = 1):
    """Whether a row is held out: CRC-32 of its id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_held_out(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **limits) -> DataFrame:
    """Learn from the rows not held out, score all."""
    out = score(docs, docs.where(~held_out(docs, id_column)), id_column, text_column, **limits)
    return out.withColumn("held_out", held_out(out, id_column)).select(
        id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


__all__ = ["ORDER", "Trie", "gather", "held_out", "score", "score_held_out", "tries"]
