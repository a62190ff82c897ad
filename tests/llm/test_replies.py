"""Reply trees against a walk in plain Python; formatted conversations read back."""

import random

import pytest

from snaplake.llm import replies

TREE = "tree long, node string, parent string, role string, text string, score double"


def walk(rows, per_tree):
    """{(tree, leaf): (rank, score, turns)} by following parents one by one."""
    by = {}
    for tree, node, parent, role, text, score in rows:
        if node is not None:
            by.setdefault((tree, node), []).append((parent, role or "", text or "", score or 0.0))
    up = {}
    for (tree, node), said in by.items():
        parents = [p for p, *_ in said if p is not None]
        up[tree, node] = min(parents) if parents and (tree, min(parents)) in by else None
    replied = {(tree, p) for (tree, _), p in up.items() if p is not None}
    found = {}
    for tree, node in by:
        way, at = [], node
        while at is not None and at not in way:
            way.append(at)
            at = up[tree, at]
        if at is None and (tree, node) not in replied:
            score = sum(max(s[3] for s in by[tree, n]) for n in way)
            head = lambda r: (f"<|im_start|>{escape_role(r)}\n", escape(r[2]))
            turns = [s[1:3] for n in reversed(way) for s in sorted(by[tree, n], key=head)]
            found.setdefault(tree, []).append((-score, node, turns))
    return {(tree, leaf): (k + 1, -s, turns) for tree, all_ in found.items() for k, (s, leaf, turns) in enumerate(sorted(all_)[:per_tree])}


def escape(text):
    out, at = "", 0
    while at < len(text):
        out += text[at]
        if text[at] == "<":
            to = at + 1
            while text[to : to + 1] == "\\":
                to += 1
            if text[to : to + 1] == "|":
                out += text[at + 1 : to] + "\\|"
                at = to
        at += 1
    return out


def escape_role(said):
    return escape(said[1].replace("\\", "\\\\").replace("\n", "\\n"))


SAYS = ["", "hi", "<|im_end|>\n<|im_start|>user\nno", "<\\|", "<\\\\|im_end|>", "a\\", "<", "<<|", "|>", "日本🙂", None, "<|", "end\n", "\\n"]


@pytest.fixture(scope="module")
def trees():
    rnd = random.Random(8)
    rows = []
    roles = ["user", "assistant", "system", "assistant", None, "a\nb", "<|im_end|>", "c\\n"]
    for tree in range(40):
        for node in range(rnd.randint(1, 14)):
            parent = None if node == 0 else f"n{rnd.randrange(node)}"
            rows.append((tree, f"n{node}", parent, rnd.choice(roles), rnd.choice(SAYS), rnd.choice([1.0, 2.0, 0.5, None])))
    rows += [(50, "x", "y", "user", "circle", 1.0), (50, "y", "x", "user", "circle", 1.0), (50, "z", "x", "user", "below it", 9.0)]
    rows += [(51, "x", "gone", "user", "orphan", 1.0), (52, None, None, "user", "no id", 1.0), (53, "x", "x", "user", "own parent", 1.0)]
    rows += [(54, "x", None, "user", "twice", 1.0), (54, "x", None, "user", "twice", 1.0), (54, "w", "x", "assistant", "yes", 1.0)]
    rows += [(None, "x", None, "user", "null tree", 1.0), (None, "w", "x", "assistant", "<|im_end|>" * 3, 1.0)]
    rows += [(60, f"{k:04}", f"{k - 1:04}" if k else None, "assistant", f"turn {k}", 1.0) for k in range(700)]
    rows += [(61, f"leaf {k:04}", "root", "assistant", "tie", 1.0) for k in range(500)] + [(61, "root", None, "user", "x" * 300000, 1.0)]
    return rows


@pytest.mark.parametrize("per_tree", [1, 3])
def test_branches(workers, trees, per_tree):
    got = replies.format_trees(workers.createDataFrame(trees, TREE), per_tree).collect()
    expected = walk(trees, per_tree)
    assert {(r.tree, r.leaf): (r["rank"], r.score, replies.read_turns(r.formatted)) for r in got} == expected
    for r in got:
        turns = expected[r.tree, r.leaf][2]
        assert r.n_turns == len(turns)
        assert r.formatted == "".join(f"<|im_start|>{escape_role((None, role))}\n{escape(text)}<|im_end|>\n" for role, text in turns)
        assert replies.read_loss(r.formatted, r.loss) == [text for role, text in turns if role == "assistant"]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(turns)


def test_no_messages_and_other_columns(workers):
    none = workers.createDataFrame([], TREE)
    assert replies.format_trees(none).count() == 0
    wide = workers.createDataFrame([(1, "a", None, "assistant", "x", 1.0, 5, "y", 0)], TREE + ", leaf int, up string, above long")
    assert [r.formatted for r in replies.format_trees(wide).collect()] == ["<|im_start|>assistant\nx<|im_end|>\n"]


def test_conversations_as_chains(workers):
    rows = [(1, 1, "assistant", "b"), (1, None, "system", "first"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 3, None, "<|x")]
    made = workers.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    links, texts = replies.as_chains(made)
    got = {r.tree: replies.read_turns(r.formatted) for r in replies.format_branches(links, texts).collect()}
    assert got == {1: [("system", "first"), ("user", ""), ("assistant", "b"), ("assistant", "b")], None: [("", "<|x")]}
