"""Exact token counts of a byte-level BPE: rank-synchronous merging of ragged arrays.

A text falls into units, each a run of white space with the run of other characters after it; no
pre-token crosses a unit's start. Only units a worker has not met are split into pre-tokens and
merged: all new pre-tokens lie in one ragged array, and each round merges the lowest-ranked pair of
every sequence at once, until no sequence has a pair left. Counts are looked up by 64-bit hash.

Edge cases: null counts as the empty text (0 bytes, 0 tokens). The vocabulary's special strings
inside a text are one token each, as the library does by default. Texts with those or with white
space outside ASCII are split as a whole. Repeated rows are counted one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.text import Known, Texts, blank, blocks, span_keys, spread

LIMIT = 1024
#: How the vocabulary's library cuts a text before merging (fixed by the vocabulary).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = regex.compile(r"[^\S\x09-\x0D\x20]")


def _byte_letters() -> dict[str, int]:
    """The vocabulary writes byte b as one printable character: itself if printable, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Counts what a vocabulary makes of texts; keeps the counts of the units it has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.symbol = np.zeros(256, np.int64)
        for letter, b in _byte_letters().items():
            self.symbol[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pairs, self.ranks = keys[order], order.astype(np.int64)
        self.products = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.known, self.counts = Known(), np.zeros(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], len(self.pairs))

    def merged(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive of each byte sequence; the sequences lie one after another in ``data``."""
        none = len(self.pairs)
        out = lengths.copy()
        symbols, row = self.symbol[data], np.repeat(np.arange(len(lengths)), lengths)
        rank = self._pair_ranks(symbols, row)
        while len(symbols):
            lowest = np.full(len(lengths), none, np.int64)
            np.minimum.at(lowest, row, rank)
            live = (lowest < none)[row]
            if not live.all():  # finished sequences leave
                symbols, row, rank = symbols[live], row[live], rank[live]
                if not len(symbols):
                    break
            chosen = rank == lowest[row]
            # of overlapping equal pairs (aaa) every other one, from the left
            begin = chosen & ~np.concatenate(([False], chosen[:-1]))
            place = np.arange(len(chosen))
            run = place - np.maximum.accumulate(np.where(begin, place, 0))
            chosen &= run % 2 == 0
            at = np.flatnonzero(chosen)
            symbols[at] = self.products[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            np.subtract.at(out, row[at], 1)
            at -= np.arange(len(at))  # places after the merged partners are gone
            symbols, row, rank = symbols[keep], row[keep], rank[keep]
            for x in (at, at[at > 0] - 1):
                rank[x] = none
                pair = x[x + 1 < len(symbols)]
                pair = pair[row[pair] == row[pair + 1]]
                rank[pair] = self._rank(symbols[pair], symbols[pair + 1])
        return out

    def _pair_ranks(self, symbols: np.ndarray, row: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbols), len(self.pairs), np.int64)
        if len(symbols) > 1:
            rank[:-1] = np.where(row[:-1] == row[1:], self._rank(symbols[:-1], symbols[1:]), len(self.pairs))
        return rank

    def _count_units(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit: pre-tokens of all units, distinct ones merged together."""
        found: dict[str, int] = {}
        index, per_unit = [], []
        for unit in units:
            parts = PRE_TOKEN.findall(unit)
            per_unit.append(len(parts))
            index.extend(found.setdefault(p, len(found)) for p in parts)
        raw = [p.encode() for p in found]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        tokens = self.merged(np.frombuffer(b"".join(raw), np.uint8), lengths)
        row, _ = spread(np.array(per_unit, np.int64))
        return np.bincount(row, weights=tokens[np.array(index, np.int64)], minlength=len(units)).astype(np.int64)

    def _whole(self, text: str) -> int:
        parts = self.special.split(text)
        return len(parts) - 1 + int(self._count_units([p for p in parts if p]).sum())

    def _odd(self, part: Texts) -> np.ndarray:
        """Texts with a special string or white space outside ASCII."""
        odd = np.zeros(len(part.starts), bool)
        whole = part.data.tobytes()
        lead = _WIDE_LEAD[part.data]
        wide = np.add.reduceat(np.concatenate((lead, [False])).astype(np.int64), np.minimum(part.starts, len(lead))) > 0
        special = self.special.search(whole.decode()) is not None
        for i in np.flatnonzero((part.ends > part.starts) & (wide | special)):
            text = whole[part.starts[i] : part.ends[i]].decode()
            odd[i] = bool(_WIDE.search(text) or (special and self.special.search(text)))
        return odd

    def count(self, part: Texts) -> np.ndarray:
        """Tokens of each text of a block."""
        out = np.zeros(len(part.starts), np.int64)
        if not len(part.data):
            return out
        space = blank(part.data)
        begin = space & ~np.concatenate(([False], space[:-1]))
        begin[part.starts[part.starts < part.ends]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(part.data))
        key = span_keys(part.data, starts, ends)
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        slot, known = self.known.find(unique)
        if not known.all():
            if self.known.full(int((~known).sum())):
                self.known.clear()
                self.counts = np.zeros(0, np.int64)
                known[:] = False
            new = np.flatnonzero(~known)
            fresh = self._count_units([part.data[starts[i] : ends[i]].tobytes().decode() for i in first[new]])
            slot[new] = self.known.add(unique[new])
            self.counts = np.concatenate((self.counts, fresh))
        text = np.searchsorted(part.ends, starts, side="right")
        out = np.bincount(text, weights=self.counts[slot][inverse], minlength=len(out)).astype(np.int64)
        for i in np.flatnonzero(self._odd(part)):
            out[i] = self._whole(part.text(i).decode())
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One per Python worker, kept between its tasks."""
    return Merger(path)


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: id, UTF-8 bytes, tokens under the vocabulary file at ``path``, and whether they exceed ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(path)
        for batch in batches:
            size, tokens = [], []
            for part in blocks(batch.column(1)):
                size.append(part.ends - part.starts)
                tokens.append(counter.count(part))
            size, tokens = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (size, tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_column)

