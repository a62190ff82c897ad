"""A trie of conversation prefixes over rebuilt conversations, from fingerprints that compose.

A sequence of turns has the product (hash, power) of its turns' (t, B) under (h, p)(k, q) = (h*q + k, p*q) modulo a
prime of 127 bits, t being 128 bits of the SHA-256 of a turn's role and text. One pass in order gives every
turn the product of its conversation's turns up to it, for the first few, and from its own suffix's start, for the others. A
rebuilt conversation is the head of one and the suffix of another: its prefixes are head products, or the head's
product times a suffix product. No rebuilt text is ever made; a row refers to the turn it ends with.

Equal (depth, hash) are a node. The turn of its least member is stored with it, and all members' turns and parents
are held against it: with one turn and one parent in each node, by depth, equal nodes are equal sequences. A clash fails
the job, naming the remedy (another base). Subtree sums go up by pointer doubling: a round joins and adds twice as far,
only nodes deep enough take part, and a node with many children is summed on the map side first.

Rows of one turn are ordered by their content; null turns come first; a null role or text is empty. Rows of a null
id are no conversation. Repeated rows are turns of their own. Without conversations there is no root. A conversation's
rows pass one by one, in the task that its id is dealt to; very long texts are hashed where they are read. The ids
that end at one node are joined to text in salted ranges before one task hashes them in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.llm.store import stored

PRIME = (1 << 127) - 1
#: The base of the hash: any number below the prime, not known to who writes the texts.
BASE = 0x5851F42D4C957F2D14057B7EF767814F

FAMILY, HEADS = 5, 9  # fixed values: every fifth conversation lends its head; heads have less than nine turns
CHUNK = 10_000  # ids joined to one piece of text


def compose(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """The product of two neighbouring sequences."""
    return (left[0] * right[1] + right[0]) % PRIME, left[1] * right[1] % PRIME


UNIT = (0, 1)


def _bytes(number: int) -> bytes:
    return number.to_bytes(16, "big")


def head_length(id_column: Column) -> Column:
    """How many turns of its family's first conversation a conversation is rebuilt with, at most."""
    return (F.crc32(id_column.cast("string")) % HEADS).cast("int")


PRODUCTS = "id long, at long, head binary, own binary, own_power binary, own_before binary, power_before binary, turn_key binary, n_bytes long"


def products(turns: DataFrame, base: int = BASE) -> DataFrame:
    """Per turn its place in the conversation, and the products of the head and of the own suffix that it ends.

    ``head`` is null beyond the eighth turn and in conversations that lend none, ``own`` where the suffix has not begun.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    small = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("id"), "turn", head_length(F.col("conv_id")).alias("head_length"),
        content.alias("turn_key"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    ordered = small.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "turn_key")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at, head, own = None, 0, UNIT, UNIT
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("id", "head_length", "turn_key"))
            for key, length, content in zip(*columns, strict=True):
                if key != current:
                    current, at, head, own = key, 0, UNIT, UNIT
                at += 1
                turn = (int.from_bytes(content[:16], "big") % PRIME, base)
                lent = at < HEADS and key % FAMILY == 0
                if lent:
                    head = compose(head, turn)
                before, mine = own, at > length
                if mine:
                    own = compose(own, turn)
                suffix = map(_bytes, (*own, *before)) if mine else [None] * 4
                rows.append((at, _bytes(head[0]) if lent else None, *suffix))
            found = list(zip(*rows, strict=True)) or [()] * 6
            made = [pa.array(c, k) for c, k in zip(found, (pa.int64(), *[pa.binary()] * 5), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *made, batch.column("turn_key"), batch.column("n_bytes")], names=_names(PRODUCTS)
            )

    return ordered.mapInArrow(multiply, PRODUCTS)


PREFIXES = "conv_id long, depth long, hi long, lo long, up_hi long, up_lo long, turn_hi long, turn_lo long, n_bytes long, last boolean"


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compose head and suffix products. In rows of the head ``own`` is null, and ``head_before`` is the parent's."""
    number = lambda x: int.from_bytes(x or b"", "big")
    for batch in batches:
        hashes, parents = [], []
        columns = (batch.column(c).to_pylist() for c in ("head", "head_before", "own", "own_power", "own_before", "power_before"))
        for head, head_before, own, power, before, power_before in zip(*columns, strict=True):
            if own is None:
                hashes.append(head)
                parents.append(head_before or _bytes(0))
            else:
                start = (number(head), 1)
                hashes.append(_bytes(compose(start, (number(own), number(power)))[0]))
                parents.append(_bytes(compose(start, (number(before), number(power_before)))[0]))
        keys = [k[:16] for k in batch.column("turn_key").to_pylist()]
        halves = []
        for values in (hashes, parents, keys):
            pairs = np.frombuffer(b"".join(values), ">i8").astype(np.int64).reshape(-1, 2)
            halves += [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
        columns = [batch.column("conv_id"), batch.column("depth"), *halves, batch.column("n_bytes"), batch.column("last")]
        yield pa.RecordBatch.from_arrays(columns, names=_names(PREFIXES))


def rebuilt(turns: DataFrame, base: int = BASE) -> tuple[DataFrame, DataFrame]:
    """A row for every turn of every rebuilt conversation, and (conv_id, depth) of all, those without a turn included.

    The rows hold depth, the hashes of the prefix (hi, lo) and of its parent (up_hi, up_lo), the turn's digest, its
    bytes, and whether it is the last.
    """
    made = stored(products(turns, base), "products")
    head = F.struct("at", "head", "turn_key", "n_bytes")
    heads = made.where("head IS NOT NULL").groupBy(F.col("id").alias("family")).agg(F.array_sort(F.collect_list(head)).alias("heads"))  # eight at most
    whole = made.groupBy(F.col("id").alias("conv_id")).agg(F.max("at").alias("own_turns"))
    whole = whole.select("*", head_length(F.col("conv_id")).alias("length"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"))
    lent = whole.join(heads, "family", "left").withColumn("heads", F.slice("heads", 1, F.col("length")))
    lent = lent.withColumn("n_heads", F.coalesce(F.array_size("heads"), F.lit(0)).cast("long"))
    lent = lent.withColumn("whole", F.col("n_heads") + F.greatest(F.col("own_turns") - F.col("length"), F.lit(0)))
    lent = stored(lent.select("conv_id", "length", "heads", "n_heads", "whole"), "heads")

    none = F.lit(None).cast("binary")
    exploded = lent.select("conv_id", "whole", "heads", F.posexplode("heads").alias("k", "turn"))
    before = F.when(F.col("k") > 0, F.get("heads", F.col("k") - 1)["head"])
    first = exploded.select(
        "conv_id", (F.col("k") + 1).cast("long").alias("depth"), "whole", "turn.head", before.alias("head_before"),
        *(none.alias(c) for c in ("own", "own_power", "own_before", "power_before")), "turn.turn_key", "turn.n_bytes",
    )
    start = lent.select("conv_id", "length", "n_heads", "whole", F.try_element_at("heads", F.lit(-1))["head"].alias("start"))
    suffix = made.where("own IS NOT NULL").drop("head")
    rest = suffix.join(start, F.col("id") == F.col("conv_id")).select(
        "conv_id", (F.col("n_heads") + F.col("at") - F.col("length")).alias("depth"), "whole", F.col("start").alias("head"), none.alias("head_before"),
        "own", "own_power", "own_before", "power_before", "turn_key", "n_bytes",
    )
    rows = first.union(rest).withColumn("last", F.col("depth") == F.col("whole")).drop("whole")
    return rows.mapInArrow(_prefix_rows, PREFIXES), lent.select("conv_id", F.col("whole").alias("depth"))


NODE = ["depth", "hi", "lo"]
#: What all members of a node must share: the turn of the least one that the node refers to, and the parent.
SHARED = ["turn_hi", "turn_lo", "up_hi", "up_lo"]


def nodes(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The trie: per node its least member, depth, hash, members, bytes of its last turn, and its parent's least member."""
    grouped = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        *(f(c).alias(f"{name}_{c}") for c in SHARED for name, f in (("least", F.min), ("most", F.max))),
    )
    alike = reduce(Column.__and__, (F.col(f"least_{c}") == F.col(f"most_{c}") for c in SHARED))
    complaint = F.raise_error(F.lit("two sequences of turns have one hash: take another base")).cast("long")
    held = grouped.select(
        "conv_id", *NODE, F.when(alike, F.col("n_convs")).otherwise(complaint).alias("n_convs"), "n_bytes",
        F.col("least_up_hi").alias("up_hi"), F.col("least_up_lo").alias("up_lo"),
    )
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select("conv_id", *(zero.alias(c) for c in NODE), "n_convs", *(zero.alias(c) for c in ("n_bytes", "up_hi", "up_lo")))
    every = stored(held.union(root), "nodes")
    above = every.select(
        F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo")
    )
    return every.join(above, ["depth", "up_hi", "up_lo"], "left").drop("up_hi", "up_lo")


def subtree_sums(own: DataFrame, columns: list[str]) -> DataFrame:
    """(conv_id, depth, and the sums of ``columns`` over all nodes below) of nodes that have any below.

    ``own`` has a row for every node, known by conv_id and depth, with parent_conv_id.
    """
    active = stored(own.where("parent_conv_id IS NOT NULL").select("conv_id", "depth", F.col("parent_conv_id").alias("up"), *columns), "climb")
    sums, reach = [], 1
    while not active.isEmpty():  # all have an ancestor ``reach`` above, ``up`` is its least member
        risen = active.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(*(F.sum(c).alias(c) for c in columns))
        risen = stored(risen, "risen")
        sums.append(risen)
        gained = risen.toDF("conv_id", "depth", *(f"_{c}" for c in columns))
        further = active.select(F.col("conv_id").alias("up"), (F.col("depth") + reach).alias("depth"), F.col("up").alias("_up"))
        far = active.join(further, ["up", "depth"]).join(gained, ["conv_id", "depth"], "left")
        added = (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in columns)
        active = stored(far.select("conv_id", "depth", "_up", *added).toDF("conv_id", "depth", "up", *columns), "climb")
        reach *= 2
    if not sums:
        return own.select("conv_id", "depth", *columns).limit(0)
    return reduce(DataFrame.union, sums).groupBy("conv_id", "depth").agg(*(F.sum(c).alias(c) for c in columns))


ENDS = "depth long, hi long, lo long, first long, ids string"
NOBODY = hashlib.sha256().hexdigest()


def ends_hashes(last: DataFrame) -> DataFrame:
    """(depth, hi, lo, ends_sha256) of nodes at which conversations end; ``last`` has node and conv_id of each."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids = None, []

        def chunk() -> tuple:
            return (*current, ids[0], ",".join(map(str, ids)))

        for batch in batches:
            done = []
            for *node, conv_id in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
                if ids and (node != current or len(ids) == CHUNK):
                    done.append(chunk())
                    ids = []
                current = node
                ids.append(conv_id)
            yield _batch(done, ENDS)
        if ids:
            yield _batch([chunk()], ENDS)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == current:
                    sha.update(b",")
                else:
                    if current:
                        done.append((*current, sha.hexdigest()))
                    current, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            yield _batch(done, HASHED)
        if current:
            yield _batch([(*current, sha.hexdigest())], HASHED)

    chunks = last.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(join, ENDS)
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, HASHED)


HASHED = "depth long, hi long, lo long, ends_sha256 string"
_KINDS = {"long": pa.int64(), "string": pa.string()}


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [_KINDS[part.split()[1]] for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_names(schema))


def prefix_trie(turns: DataFrame, base: int = BASE) -> DataFrame:
    """Per node of the trie of rebuilt conversations: members, children, leaves, saved bytes and who ends there.

    ``turns``: conv_id, turn, role, text.
    """
    rows, ends = rebuilt(turns, base)
    rows = stored(rows, "prefixes")
    linked = nodes(rows, ends)
    children = linked.where("parent_conv_id IS NOT NULL").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    counted = linked.join(children.agg(F.count(F.lit(1)).alias("n_children")), ["conv_id", "depth"], "left").select(
        "conv_id", *NODE, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    counted = stored(counted, "trie")
    summed = ["n_leaves", "saved_tokens"]
    below = subtree_sums(counted, summed).toDF("conv_id", "depth", *(f"_{c}" for c in summed))
    last = rows.where("last").select(*NODE, "conv_id").union(ends.where("depth = 0").select("depth", F.lit(0), F.lit(0), "conv_id"))
    hashes = ends_hashes(last)
    out = counted.join(below, ["conv_id", "depth"], "left").join(hashes, NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        *((F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in summed),
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )
