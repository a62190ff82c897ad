"""Repairs against a search over all edits, on rows damaged anew in plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from snaplake.llm import repair, workload

GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def content(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def cheapest(rows):
    """Least cost, then the least audit, by a shortest-path search over (rows used, what was made)."""
    # initials made so far matter only by their last one: states '', s, u, a
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    queue, seen = [(0, "", 0, "", ())], set()
    best = None
    while queue:
        cost, audit, at, state, made = heappop(queue)
        if best and cost > best[0]:
            break
        if at == len(rows) and state in ("", "a"):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, made)
            continue
        if (cost, audit) in seen:
            continue
        seen.add((cost, audit))
        for role in ("user", "assistant"):
            if role[0] in after[state]:
                heappush(queue, (cost + 3, audit + "I", at, role[0], (*made, f"{role}:")))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heappush(queue, (cost + 4, audit + "D", at + 1, state, made))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 if fault == "truncated" else 0
        if role[:1] in after[state] and role[:1]:
            heappush(queue, (cost + more, audit + "K", at + 1, role[0], (*made, f"{role}:{text}")))
        for new in ("user", "assistant"):
            if new[0] in after[state]:
                heappush(queue, (cost + more + 3, audit + "R", at + 1, new[0], (*made, f"{new}:{text}")))
    return best


def brute(rows):
    """The contract's columns by id, of rows that are damaged already."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, content(*r[2:])))
        seen, judged = set(), []
        for _, _, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        cost, audit, made = cheapest(judged)
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def conversations():
    rnd = random.Random(3)
    roles = ["user", "assistant", "system", "User", "tool", "", "sudo", None, "user", "assistant", "assistant"]
    texts = ["Yes.", "No!", "Why", " ", "", None, "Ends. \n", "open…", "a b?", "same."]
    rows = []
    for conv in range(300):
        for turn in range(rnd.randint(1, 7)):
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 2, None]), rnd.choice(roles), rnd.choice(texts)))
    rows += [(None, 1, "user", "no id."), (None, None, None, None), (500, 0, "user", "Long. " * 40000), (500, 1, "assistant", "x" * 99 + "?")]
    rows += [(600, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1500)]
    return rows + [(conv + 1000, t, r, x) for conv, t, r, x in rows[:40] if conv is not None]


def report(workers, rows, ids=None):
    made = workers.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r[0]: tuple(r)[1:] for r in repair.repair_report(made, ids or made).collect()}


def test_every_repair_is_the_cheapest(workers, conversations):
    few = [r for r in conversations if r[0] != 600]
    assert report(workers, few) == {
        c: v for c, v in brute([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in few]).items()
    }


def test_damage_and_conversations_without_rows(workers, conversations):
    given = workers.createDataFrame(conversations, "conv_id long, turn long, role string, text string")
    hurt = [tuple(r) for r in repair.damaged(given).collect()]
    assert sorted(hurt, key=repr) == sorted(damage(conversations), key=repr)
    few = [r for r in conversations if r[0] != 600]
    expected = dict.fromkeys({r[0] for r in few}, (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))
    lost = {r[0] for r in few} - {r[0] for r in damage(few)}
    assert lost
    expected |= brute(damage(few))
    got = report(workers, damage(few), workers.createDataFrame([(r[0],) for r in few], "conv_id long"))
    assert got == expected


def test_a_long_conversation(workers, conversations):
    rows = damage([r for r in conversations if r[0] == 600])
    (got,) = report(workers, rows).values()
    assert len(got[6]) >= len(rows) and got[6].replace("I", "") and got[5] > 0
    kept = [r for r, edit in zip(sorted(rows, key=lambda r: (r[1], content(*r[2:]))), got[6].replace("I", ""), strict=True) if edit != "D"]
    assert GRAMMAR.fullmatch("ua" * (len(kept) // 2))


def test_repaired_turns_follow_the_grammar(workers, conversations):
    made = workers.createDataFrame(conversations, "conv_id long, turn long, role string, text string")
    told = repair.assess(made).cache()
    rows = repair.repaired(made, told).collect()
    by_id = {}
    for r in sorted(rows, key=lambda r: r.place):
        by_id.setdefault(r.id, []).append(r)
    audits = {r.conv_id: r.audit for r in told.collect()}
    for conv, turns in by_id.items():
        assert GRAMMAR.fullmatch("".join(t.role[0] for t in turns))
        assert "".join(t.edit for t in turns) == audits[conv].replace("D", "")
        assert [t.place for t in turns] == list(range(len(turns)))
    assert set(audits) - set(by_id) == {c for c, a in audits.items() if not a.replace("D", "")}


def test_empty_table_and_other_columns(workers):
    assert report(workers, []) == {}
    wide = workers.createDataFrame([(1, 0, "user", "Hi.", 3, "s", "x")], "conv_id long, turn long, role string, text string, id long, signature string, audit string")
    assert [tuple(r)[:8] for r in repair.repair_report(wide, wide).collect()] == [(1, 0, 0, 0, 0, 0, 3, "KI")]


def test_query(workers):
    from .conftest import SF

    rows = [tuple(r) for r in workers.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in workload.QUERIES["op11_repair_conversations"](workers, SF).collect()}
    expected = dict.fromkeys({r[0] for r in rows}, (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))
    assert got == expected | brute(damage(rows))
