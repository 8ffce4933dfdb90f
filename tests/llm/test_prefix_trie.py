"""The trie of conversations against a brute-force version over plain tuples."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from studyframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth string, n string, keys string, t string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, family=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said = f"{len(role or '')}:{role or ''}{text or ''}"
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5(said.encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = tuple(own.get(c - c % family, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[:d - 1]].add(s[:d])
    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * words
        ends = ",".join(str(c) for c in sorted(members[node]) if built[c] == node)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df).select(*COLUMNS).collect()), key=repr)


def test_awkward_conversations(spark):
    rnd = random.Random(4)
    says = ["yes", "no", "a b  c", "", None, "long " * 40_000, "é\x0bß", "tab\tand\nline"]
    rows = [(c, t if t else None, rnd.choice(["user", "assistant", None, "x:"]), rnd.choice(says)) for c in range(70) for t in range(rnd.randint(1, 5))]
    rows += rows[:9] + [(None, 0, "user", "nobody's"), (None, None, None, None)]
    # without a first conversation, some of these have no turn at all
    rows += [(c, 0, "user", "alone") for c in range(101, 118)] + [(-7, 0, "user", "below"), (-20, 0, "user", "base"), (2**60, 3, "user", "far")]
    assert any(len(r) and r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in brute(rows))
    assert trie(spark, rows) == brute(rows)


def test_hot_conversation_and_long_shared_prefix(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1900) for t in range(3)]
    rows += [(c, t, "user" if t % 2 else "assistant", "turn of both" if t < 12 else f"{c} goes on {t}") for c in (40, 60) for t in range(40)]
    rows += [(80, t, "user", "one alone") for t in range(300)]
    got = trie(spark, rows)
    assert got == brute(rows)
    assert max(r[1] for r in got) == 300


def test_ids_of_a_hot_end_cross_pieces_and_tasks(spark):
    ends = spark.range(-500, 3000).selectExpr("cast(if(id % 3 = 0, id % 7, 100) as string) as name", "id as conv_id")
    got = prefix_trie.ends_digest(ends.selectExpr("cast(name as binary) as key", "conv_id"), piece=50).collect()
    want = defaultdict(list)
    for r in ends.collect():
        want[r.name.encode()].append(r.conv_id)
    assert {bytes(r.key): r.ends_sha256 for r in got} == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
    assert len(got) == len(want)


def test_many_children_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIGHT_CHILDREN", 3)
    rnd = random.Random(9)
    rows = [(20 * c, t, "user", f"{rnd.randint(0, 9)}") for c in range(200) for t in range(3)]
    assert trie(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "a")]) == []


@pytest.mark.parametrize("depth", [1, 2])
def test_only_turnless_and_single(spark, depth):
    rows = [(c, t, "user", "a") for c in range(1, 9) for t in range(depth)]
    assert trie(spark, rows) == brute(rows)
