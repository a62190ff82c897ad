"""Conversation structure repair with a suffix-shared automaton.

A conversation's signature has one letter a turn, for its role and its fault. Signatures that end alike share
the nodes of their common end: a node is a distinct end of a signature. Cost-to-go and the best edit are worked
out once for every node and grammar state, from the last turn backwards; signatures come sorted from their
ends, so a task keeps only the nodes of the path at hand, and neighbours share them. Tasks are ranges of
(signature, id): a signature that a third of all conversations have is many ranges, and nodes are built again
only where a range begins. No conversation's texts are held: they pass one by one while edits are applied.

What the grammar takes: nothing, or an optional system turn and then user and assistant in turn, assistant last.
In any state a user or an assistant turn is possible, never both, so the letters of an audit say everything.

Nulls: a null role or text is one space, a null turn comes first, rows of a null id are one conversation.
Rows of one turn are ordered by their content; repeated rows are duplicates. An empty table gives no rows.
Very long conversations cost one letter a turn in memory, very long texts one text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm.store import stored

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3

#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state after the user or assistant turn that each state allows, and the role of that turn.
NEXT = (USER, USER, ASSISTANT, USER)
MADE = ("user", "user", "assistant", "user")
#: States in which a turn whose role begins so may stay, and the state after it.
STAY = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = ("su", "ua", "au")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
GONE = "x"  # a turn that must be deleted; other letters are s, u, a, o, capital if the text is truncated

_SPACE = " \t\n\x0b\x0c\r"
NO_TEXT = hashlib.sha256().hexdigest()


def _rows(turns: DataFrame, id_column: str) -> DataFrame:
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return turns.select(
        F.col(id_column).cast("long").alias("id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(content, 256)).alias("content"),
    )


def signatures(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Per conversation its signature and the counts of its faults; no text is shuffled."""
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    small = _rows(turns, id_column).select(
        "id",
        "turn",
        "content",
        F.substring("role", 1, 1).alias("initial"),
        (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("open"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("content")]
    own, same = Window.partitionBy("id").orderBy(*order), Window.partitionBy("id", "content").orderBy(*order)
    seen = F.row_number().over(same) > 1
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("open"), "truncated")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    pair = F.concat(F.lag("initial").over(own), "initial")
    told = (
        small.repartition("id")
        .withColumn("again", seen)
        .withColumn("fault", fault)
        .select(
            "id", "turn", "fault", letter.alias("letter"), F.row_number().over(own).alias("at"),
            (~pair.isin(*LEGAL)).alias("illegal"),
            (F.col("turn").isNotNull() & ~F.lag("turn").over(own).eqNullSafe(F.col("turn"))).alias("new_turn"),
        )
    )

    def count(which: Column) -> Column:
        return F.count_if(which)

    spanned = F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn"))
    letters = F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"])
    return told.groupBy("id").agg(
        F.coalesce(spanned, F.lit(0)).alias("gaps"),
        *(count(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
        F.concat_ws("", letters).alias("signature"),
    )


class Node:
    """Of an end of signatures: per grammar state the least cost from there on, and the first edit of the best audit.

    Equal costs take the lesser letter. Edits from one state differ in their letters, so the first letters decide
    between whole audits, and the rest of the audit is that of the state the edit leads to.
    """

    __slots__ = ("costs", "edits")

    def __init__(self, plain: list[tuple[int, str]]):
        inserted = [(COST[INSERT] + plain[NEXT[q]][0], INSERT) for q in (USER, ASSISTANT)]
        best = [None, None, min(plain[USER], inserted[0]), min(plain[ASSISTANT], inserted[1])]
        for q in (START, SYSTEM):
            best[q] = min(plain[q], (COST[INSERT] + best[USER][0], INSERT))
        self.costs, self.edits = zip(*best, strict=True)


NEVER = 1 << 60
END = Node([(0, ""), (NEVER, ""), (NEVER, ""), (0, "")])


def before(letter: str, after: Node) -> Node:
    """The node of an end with one more letter in front."""
    plain = []
    kind, extra = letter.lower(), TRUNCATED * letter.isupper()
    for q in STATES:
        options = [(COST[DELETE] + after.costs[q], DELETE)]
        if letter != GONE:
            options.append((COST[REROLE] + extra + after.costs[NEXT[q]], REROLE))
            stays = STAY.get(kind, {}).get(q)
            if stays is not None:
                options.append((extra + after.costs[stays], KEEP))
        plain.append(min(options))
    return Node(plain)


def audit_of(reverse: str, path: list[Node]) -> str:
    """Read off the edits, from the first turn on; ``path[k]`` is the node of the last k letters."""
    edits, q, left = [], START, len(reverse)
    while edit := path[left].edits[q]:
        edits.append(edit)
        if edit == INSERT:
            q = NEXT[q]
            continue
        left -= 1
        if edit != DELETE:
            q = NEXT[q] if edit == REROLE else STAY[reverse[left].lower()][q]
    return "".join(edits)


def assess(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Per conversation with rows: gaps, counts of faults and illegal neighbours, cost and audit of the cheapest repair."""
    signed = signatures(turns, id_column).withColumn("signature", F.reverse("signature"))
    ends = signed.repartitionByRange("signature", "id").sortWithinPartitions("signature", "id")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, path, cost, audit = "", [END], 0, ""
        for batch in batches:
            costs, found = [], []
            for reverse in batch.column("signature").to_pylist():
                if reverse != last:
                    apart = (k for k, (a, b) in enumerate(zip(last, reverse, strict=False)) if a != b)
                    shared = next(apart, min(len(last), len(reverse)))
                    del path[shared + 1 :]
                    for letter in reverse[shared:]:
                        path.append(before(letter, path[-1]))
                    last, cost, audit = reverse, path[-1].costs[START], audit_of(reverse, path)
                costs.append(cost)
                found.append(audit)
            batch = batch.drop_columns(["signature"])
            yield batch.append_column("cost", pa.array(costs, pa.int64())).append_column("audit", pa.array(found, pa.string()))

    counts = ", ".join(f"{name} long" for name in COUNTS)
    return ends.mapInArrow(solve, f"id long, {counts}, cost long, audit string").withColumnRenamed("id", id_column)


REPAIRED = "id long, place long, edit string, role string, text string"


def repaired(turns: DataFrame, assessed: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """The turns of every conversation after its cheapest repair: place from 0, edit (K, R or I), role and text.

    A conversation's rows come in order and in one partition, behind its audit; one row is held at a time.
    """
    rows = _rows(turns, id_column).select("id", F.lit(True).alias("is_turn"), "turn", "content", "role", "text")
    plan = assessed.select(F.col(id_column).cast("long").alias("id"), F.lit(False).alias("is_turn"), F.col("audit").alias("text"))
    stream = rows.unionByName(plan, allowMissingColumns=True)
    ordered = stream.repartition("id").sortWithinPartitions("id", "is_turn", F.col("turn").asc_nulls_first(), "content")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, current = "", 0, START, 0, None
        out: list[tuple] = []

        def put(letter: str, role: str, text: str, to: int) -> None:
            nonlocal state, place
            out.append((current, place, letter, role, text))
            state, place = to, place + 1

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == INSERT:
                put(INSERT, MADE[state], "", NEXT[state])
                at += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "place", "edit", "role", "text"]
            )
            out.clear()
            return made

        for batch in batches:
            wanted = batch.select(["id", "is_turn", "role", "text"])
            for key, is_turn, role, text in zip(*(c.to_pylist() for c in wanted.columns), strict=True):
                if not is_turn:
                    inserts()  # those behind the last turn of the conversation before
                    audit, at, state, place, current = text, 0, START, 0, key
                    continue
                inserts()
                letter, at = audit[at], at + 1
                if letter == KEEP:
                    put(KEEP, role, text, STAY[role[0]][state])
                elif letter == REROLE:
                    put(REROLE, MADE[state], text, NEXT[state])
            yield flushed()
        inserts()
        yield flushed()

    return ordered.mapInArrow(edit, REPAIRED)


def digests(repaired_turns: DataFrame) -> DataFrame:
    """(id, repaired_sha256) over ``role:text`` lines, straight behind ``repaired``, whose partitions hold turns in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha = None, None
        done: list[tuple] = []

        def made() -> pa.RecordBatch:
            ids, shas = [x[0] for x in done], [x[1] for x in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], names=["id", "repaired_sha256"])

        for batch in batches:
            for key, place, role, text in zip(*(c.to_pylist() for c in batch.select(["id", "place", "role", "text"]).columns), strict=True):
                if place == 0:
                    if sha:
                        done.append((current, sha.hexdigest()))
                    current, sha = key, hashlib.sha256()
                sha.update((("\n" if place else "") + role + ":" + text).encode())
            yield made()
        if sha:
            done.append((current, sha.hexdigest()))
        yield made()

    return repaired_turns.mapInArrow(digest, "id long, repaired_sha256 string")


def damaged(conversations: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Faults planted by crc32 of ``id:turn``: of 20 remainders five drop, empty, unstop, repeat a row or call it user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(id_column).cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    kind = F.col("damage")
    return (
        conversations.select(F.col(id_column), "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("damage"))
        .where(kind != 0)
        .select(
            id_column,
            "turn",
            F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def repair_report(turns: DataFrame, ids: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """One row for every id of ``ids``: what ``assess`` says, and the digest of the repaired conversation."""
    told = stored(assess(turns, id_column), "assessed")
    hashes = digests(repaired(turns, told, id_column))
    every = ids.select(F.col(id_column).cast("long").alias("id")).distinct()
    told = told.withColumnRenamed(id_column, "_told")
    hashes = hashes.withColumnRenamed("id", "_hashed")
    out = every.join(told, F.col("id").eqNullSafe(F.col("_told")), "left")
    out = out.join(hashes, F.col("id").eqNullSafe(F.col("_hashed")), "left")
    return out.select(
        F.col("id").alias(id_column),
        *(F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in (*COUNTS, "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NO_TEXT)).alias("repaired_sha256"),
    )
