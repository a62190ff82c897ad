"""Chat formatting of reply trees.

Messages name their parents. Pointer doubling (a self-join a round, twice as far each time) gives every message
the score and the length of its path from the root in as many rounds as the depth has binary digits; only ids and
scores travel. The leaves of a tree are ranked by the score of their branch, and the rounds' stored pointers, again
one self-join a round, list the messages on each chosen path. Then the texts are joined in, once, and a path becomes
one string with the places of its loss text.

The template writes ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a newline. Inside texts and
roles every ``<|``, with any backslashes between the two, gets one more backslash, so no control string is left in
them; in roles backslashes and newlines are escaped before. Reading takes the same steps back.

A null score is 0, a null role or text is empty, a parent that is not there is none. Rows that repeat a node stand in
the path side by side. Messages without a node id, and those below a circle of parents, have no way from a root
and are left out. A null tree id is one tree. Of equal branches the one with the lesser leaf comes first.
Empty tables give no rows; other columns are ignored. A formatted conversation is one value, so it and no more
is held at once, however long; a tree with many messages is spread over tasks by node.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm.store import stored
from snaplake.operators.latest import top_n_per_group

OPENED, CLOSED = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"

_RAW, _ESCAPED = r"<(\\*)\|", r"<\\(\\*)\|"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """On one line, too."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped(text: str) -> str:
    return re.sub(_ESCAPED, r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for part in formatted.split(CLOSED)[:-1]:
        role, _, text = part.removeprefix(OPENED).partition("\n")
        turns.append((unescaped_role(role), unescaped(text)))
    return turns


def read_loss(formatted: str, loss: list[dict]) -> list[str]:
    """The texts under the mask."""
    return [unescaped(formatted[s["start"] : s["start"] + s["length"]]) for s in loss]


def _at(left: DataFrame, key: str, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join the rows of ``right`` whose node is ``key`` in the same tree; a null tree is a tree."""
    right = right.withColumnsRenamed({"tree": "_tree", "node": "_node"})
    same = left["tree"].eqNullSafe(right["_tree"]) & (left[key] == right["_node"])
    return left.join(right, same, how)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def branches(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, score, leaf) of every message under a root, and round by round (tree, node, up), 2^round messages up.

    ``score`` sums the messages from the root on; ``leaf`` says that nobody replied.
    """
    ids = links.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min("parent").alias("up"), F.max("score").alias("score"))
    ids = stored(ids, "messages")
    linked = _at(ids, "up", ids.select("tree", "node"), "left").select("tree", "node", F.col("_node").alias("up"), "score")
    linked = stored(linked, "branches")
    active, done = linked.where("up IS NOT NULL"), [linked.where("up IS NULL")]
    jumps, reach, most = [], 1, linked.count()
    while reach <= most and not active.isEmpty():  # who goes further than all messages goes in a circle
        jumps.append(active.select("tree", "node", "up"))
        above = _union([active, *done]).withColumnsRenamed({"up": "_up", "score": "_score"})
        further = _at(active, "up", above).select("tree", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"))
        further = stored(further, "branches")
        active, reach = further.where("up IS NOT NULL"), 2 * reach
        done.append(further.where("up IS NULL"))
    replied = linked.where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    reached = _at(_union(done), "node", replied, "left")
    return reached.select("tree", "node", "score", F.col("_node").isNull().alias("leaf")), jumps


def paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``leaves`` has (tree, leaf, ...); a row for every message on the way up from each, ``above`` counts from the leaf."""
    parts = [stored(leaves.select("*", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above")), "paths")]
    for k, jump in enumerate(jumps):
        known = _union(parts)
        found = _at(known, "node", jump)
        found = found.select(*leaves.columns, F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        parts.append(stored(found, "paths"))
    return _union(parts)


def format_trees(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """The best ``per_tree`` branches of each tree as conversations; ``messages``: tree, node, parent, role, text, score."""
    return format_branches(messages.select("tree", "node", "parent", "score"), messages, per_tree)


def format_branches(links: DataFrame, texts: DataFrame, per_tree: int = 1) -> DataFrame:
    """The same with the links (tree, node, parent, score) apart from the texts (tree, node, role, text).

    Returns tree, leaf, rank (from 1), score, n_turns, formatted, and loss: start and length, in code points, of
    each text of the assistant in it.
    """
    scored = links.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    reached, jumps = branches(scored)
    order = [F.col("score").desc(), F.col("leaf")]
    leaves = reached.where("leaf").select("tree", F.col("node").alias("leaf"), "score")
    chosen = paths(top_n_per_group(leaves, ["tree"], order, per_tree), jumps)
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    spoken = texts.select(
        "tree", "node",
        F.concat(F.lit(OPENED), escaped_role(role), F.lit("\n")).alias("head"),
        escaped(text).alias("body"),
        (role == LEARNED).alias("learned"),
    )
    pieces = _at(chosen, "node", spoken).select(*chosen.columns, "head", "body", "learned")
    turn = Window.partitionBy("tree", "leaf").orderBy(F.col("above").desc(), "head", "body")
    size = F.length("head") + F.length("body") + len(CLOSED)
    start = F.coalesce(F.sum(size).over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    span = F.struct(start.alias("start"), F.length("body").cast("long").alias("length"))
    placed = pieces.select(
        "tree", "leaf", "rank", "score",
        F.struct(F.row_number().over(turn).alias("at"), F.concat("head", "body", F.lit(CLOSED)).alias("piece")).alias("piece"),
        F.when(F.col("learned"), span).alias("span"),
    )
    made = placed.groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"),
        F.first("score").alias("score"),
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list("piece")).alias("pieces"),
        F.array_sort(F.collect_list("span")).alias("loss"),
    )
    formatted = F.concat_ws("", F.col("pieces.piece"))
    return made.select("tree", "leaf", "rank", "score", "n_turns", formatted.alias("formatted"), "loss")


def as_chains(conversations: DataFrame, id_column: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Links and texts of conversations in which each turn (null first) replies to the one before it.

    A node is a digest of its row: rows of one turn are ordered by it, equal rows are one node, and the texts stay
    where they are while the ids are put in order.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.concat(F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lit(":"), F.length(role).cast("string"), F.lit(":"), role, text)
    texts = conversations.select(
        F.col(id_column).alias("tree"), F.substring(F.sha2(said, 256), 1, 32).alias("node"), "turn", role.alias("role"), text.alias("text")
    )
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "node")
    links = texts.select("tree", "node", "turn").distinct().select("tree", "node", F.lag("node").over(order).alias("parent"), F.lit(0.0).alias("score"))
    return links, texts


def read_back(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation what a reader finds in it: digests and sizes of its turns and of its loss text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns, learned = read_turns(text), "".join(read_loss(text, loss))
                sha = hashlib.sha256()
                for role, said in turns:
                    sha.update(f"{role}\n{said}\n".encode())
                rows.append((len(turns), sha.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            found = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
            names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), *columns], names=names)

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "formatted", "loss").mapInArrow(
        read, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
