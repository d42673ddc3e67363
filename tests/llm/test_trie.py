"""The prefix trie against one that is built node by node."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, digest string, depth int, place double"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1.5) for r in rows], SCHEMA)


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(turns)] for c, turns in own.items()}
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        found[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return found


def plain(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(c)
    rows = []
    for node, own in members.items():
        under = [n for n in members if n[: len(node)] == node]
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = sorted(c for c in own if len(conversations[c]) == len(node))
        rows.append(
            (
                min(own),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(own),
                sum(len(n) == len(node) + 1 for n in under),
                sum(all(m[: len(n)] != n or m == n for m in members) for n in under),
                sum((len(members[n]) - 1) * words(n) for n in under),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(rows, key=repr)


def conversations(seed, count):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(300, count, replace=False).tolist():
        if rng.random() < 0.3:  # one conversation that many repeat
            rows += [(c, t, "user", f"the same {t}") for t in range(4)]
        else:
            rows += [(c, t, rng.choice(["user", "assistant"]), "word " * int(rng.integers(0, 3))) for t in range(rng.integers(1, 7))]
            rows.append((c, 9, "user", f"only {c}\nhere" if rng.random() < 0.5 else "end"))
    rng.shuffle(rows)
    return [(int(c), int(t), str(r), str(x)) for c, t, r, x in rows]


@pytest.mark.parametrize(("seed", "cells"), [(1, None), (2, 64), (3, 256)])
def test_trie_matches_plain(shipped, rows, seed, cells):
    given = conversations(seed, 120)
    turns = trie.rebuilt(frame(shipped, given).repartition(5))
    assert rows(trie.prefix_trie(turns, cells), *COLUMNS) == plain(rebuilt(given))


def test_odd_conversations(shipped, rows):
    given = [
        (20, None, "user", "first"), (20, 5, None, "second"), (20, 6, "user", None), (21, 0, "user", ""),
        (22, 0, "a", "x"), (22, 1, "", "long " * 50_000), (22, 2, None, "long " * 50_000), (None, 0, "user", "lost"),
        (22, 3, "b", "y"), (47, 0, "user", "no first conversation"), (60, 0, "1:a", "b"), (61, 0, "x", "x"),
        (80, 0, None, None), (82, 0, "u", "only"), (82, 1, "u", "own"), (82, 2, "u", "turns"), (82, 4, "u", "here"),
    ]
    assert any(not turns for turns in rebuilt(given).values())
    assert rows(trie.prefix_trie(trie.rebuilt(frame(shipped, given))), *COLUMNS) == plain(rebuilt(given))
    assert trie.prefix_trie(trie.rebuilt(frame(shipped, []))).count() == 0
    assert trie.prefix_trie(trie.rebuilt(frame(shipped, given[7:8]))).count() == 0


def test_many_conversations_end_at_one_node(shipped):
    given = [(c * 20, 0, "user", "same") for c in range(30_000)]
    (root, node) = sorted(trie.prefix_trie(trie.rebuilt(frame(shipped, given))).collect(), key=lambda r: r["depth"])
    assert (root["n_convs"], node["n_convs"], node["saved_tokens"]) == (30_000, 30_000, 29_999)
    ids = ",".join(str(c * 20) for c in range(30_000))
    assert node["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest()


def test_screening_finds_tails(shipped):
    given = [(c, t, "user", "shared" if t < 2 else f"{c} {t}") for c in range(400) for t in range(6)]
    links = trie.prefixes(trie.turn_rows(frame(shipped, given)).withColumnRenamed("turn", "place"))
    sketch = trie.sketch(links.where("depth > 0").select("digest"), 1 << 14)
    digests = links.where("depth > 0").select("depth", "digest").collect()
    single = sketch.single(np.frombuffer(b"".join(bytes(r["digest"]) for r in digests), np.uint64).reshape(-1, 2))
    assert not any(s for s, r in zip(single, digests) if r["depth"] <= 2)
    assert np.mean([s for s, r in zip(single, digests) if r["depth"] > 2]) > 0.99
