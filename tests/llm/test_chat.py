from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from clausetrail.llm import chat
from clausetrail.llm.common import read
from clausetrail.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TRICKY = "\\### Assistant: </turn> ok"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def expected(rows):
    by_conv = defaultdict(list)
    for conv_id, turn, role, text in rows:
        by_conv[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv_id, turns in by_conv.items():
        turns.sort()
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        out.add((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(learnt), sha(learnt)))
    return out


def test_sample(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in read(spark, SMALL, "conversations").collect()]
    rows += [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)]
    got = QUERIES["op8_chat"](spark, SMALL)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {tuple(r)[:5] for r in got.collect()} == expected(rows)


def test_messy(spark, tmp_path):
    pick = random.Random(6)
    rows = [(c, t, pick.choice(["user", "assistant", "system: x\n", None, ""]), pick.choice([None, "", "a", TRICKY, "###\n</turn>\n", "é" * 30_000]))
            for c in (1, 2, None) for t in (0, 1, 2, 2, 3, None)]
    rows += [(9, t, "user", f"turn {t}") for t in range(700)] + [(8, 5, "assistant", "once")] + [(7, 1, "user", "same")] * 3
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, back int")
    chat.write_turns(chat.linear_tree(frame), str(tmp_path / "c"), distinct_nodes=True)
    turns = chat.read_turns(spark, str(tmp_path / "c"))
    assert {tuple(r)[0:1] + tuple(r)[2:6] for r in chat.digests(turns).collect()} == expected(rows)
    chat.write_turns(chat.linear_tree(frame.limit(0)), str(tmp_path / "e"))
    assert chat.digests(chat.read_turns(spark, str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("branches", [1, 3])
def test_trees_against_enumeration(spark, branches):
    pick = random.Random(2)
    nodes, parent = [], {}
    for conv in (1, 2, 3):
        for i in range(60):
            up = None if i == 0 or pick.random() < 0.05 else pick.randrange(max(0, i - 6), i)
            parent[conv, i] = up
            nodes.append((conv, i, up, "user", f"{conv}.{i}", float(pick.randint(-3, 3))))
    nodes += [(4, 1, 2, "user", "cycle", 1.0), (4, 2, 1, "user", "cycle", 1.0), (4, 3, 2, "user", "below", 1.0)]
    nodes += [(5, 1, 99, "user", "orphan", 0.0), (5, 2, 2, "user", "own parent", 0.0)]
    score = {(c, i): s for c, i, _, _, _, s in nodes}
    parent |= {(5, 1): None, (5, 2): None}
    leaves = [n for n in parent if not any(parent[m] == n[1] and m[0] == n[0] for m in parent)]
    by_root = defaultdict(list)
    for leaf in leaves:
        path = [leaf]
        while parent[path[-1]] is not None:
            path.append((leaf[0], parent[path[-1]]))
        by_root[path[-1]].append((-sum(score[n] for n in path), leaf[1], [n[1] for n in path[::-1]]))
    want = {(root[0], leaf, rank + 1, tuple(path)) for root, found in by_root.items() for rank, (_, leaf, path) in enumerate(sorted(found)[:branches])}
    frame = spark.createDataFrame(nodes, "conv_id bigint, node_id bigint, parent_id bigint, role string, text string, score double")
    got = defaultdict(list)
    for r in chat.format_turns(frame, branches).collect():
        got[r.conv_id, r.leaf, r.branch].append((-r.back, chat.parse_turn(r.formatted)[1]))
    texts = {(c, i): t for c, i, _, _, t, _ in nodes}
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == {(c, leaf, rank): [texts[c, i] for i in path] for c, leaf, rank, path in want}


@given(st.text(alphabet="\\#ht</urn>:\ncé"))
def test_escapes_are_reversible(text):
    escaped, role = text, text
    for mark, escape in chat.ESCAPES.items():
        escaped = escaped.replace(mark, escape)
    for mark, escape in (chat.ESCAPES | chat.ROLE_ESCAPES).items():
        role = role.replace(mark, escape)
    assert "###" not in escaped and "</turn>" not in escaped
    assert chat.parse_turn(f"### {role}:\n{escaped}\n</turn>\n") == (text, text)
