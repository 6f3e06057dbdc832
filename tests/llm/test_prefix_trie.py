from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from lodestone.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string, base string, what int, n int, ends string, cell int"


def brute(rows, family=5):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(held)] for c, held in own.items()}
    members, ends = {}, {}
    for c in own:
        rest = abs(c) % family * (1 if c >= 0 else -1)
        take = zlib.crc32(str(c).encode()) % prefix_trie.HEADS
        whole = tuple(own.get(c - rest, [])[:take] + own[c][take:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children.get(node, [])]
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    out = [
        (min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children.get(node, [])), *sums[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, held in members.items()
    ]
    return sorted(out, key=repr)


def got(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "p", "b", 2, 3, "e", 4) for r in rows], SCHEMA)
    found = prefix_trie.trie(table, **more)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def talk(rng, convs, words, longest):
    return [(c, t, rng.choice(["user", "assistant"]) if t else "user", f"w{rng.randrange(words)}") for c in convs for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize(("words", "longest", "held", "stretch"), [(2, 12, 20_000, 4096), (3, 20, 5, 3), (1, 6, 1, 1), (50, 9, 20_000, 2)])
def test_matches_brute_force(spark, monkeypatch, words, longest, held, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rng = random.Random(words * longest)
    rows = talk(rng, rng.sample(range(400), 150), words, longest)
    rng.shuffle(rows)
    assert got(spark, rows, held=held) == brute(rows)


def test_nulls_repeats_ties_and_odd_turns(spark):
    rows = [
        (0, 1, "user", "a"), (0, 1, "user", "a"), (0, None, "user", None), (0, 2, None, "b"), (0, 2, "user", "b"), (1, 0, "user", ""), (1, 0, None, None), (1, 7, "user", "a"), (2, None, None, None),
        (None, 0, "user", "a"), (None, None, None, None), (-3, 0, "user", "x"), (-5, 0, "user", "x"), (-7, 3, "user", "日本"), (7, 0, "user", "日本語 ß 🙂"), (9, 0, "1:", "2:a"), (5, 0, "user", "z" * 400_000), (8, 0, "user", "z" * 400_000),
    ]
    assert got(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


def test_copies_and_long_conversations(spark):
    """A conversation that a third of all ids repeat, each prefix of a long one, and one of many more turns than the others."""
    same = [(1000 + c, t, "user", f"s{t}") for c in range(400) for t in range(4)]
    stairs = [(3000 + 5 * c, t, "user", f"t{t}") for c in range(60) for t in range(c + 1)]
    long = [(7000, t, "user", f"u{t % 3}") for t in range(3000)]
    rows = same + stairs + long
    random.Random(3).shuffle(rows)
    assert got(spark, rows, held=700) == brute(rows)


def test_list_of_many_ends_is_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 7)
    ids = random.Random(4).sample(range(-500, 5000), 3000)
    ends = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 9), (4, 2, 11), (4, 2, 2)], "conv_id long, depth long, end long")
    found = {(r.conv_id, r.depth): r.ends_sha256 for r in prefix_trie.id_digests(ends).collect()}
    sha = {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in {(1, 2): ids, (1, 3): [9], (4, 2): [11, 2]}.items()}
    assert found == sha


def test_family_nodes_are_combined_before_the_merge(spark):
    """Five conversations of one family share what their base gives them as one row each."""
    rows = [(c, t, "user", f"t{t}") for c in range(5) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = prefix_trie.family_nodes(table).collect()
    assert sorted((r.depth, r.n, r["first"]) for r in nodes) == [(d, 5, 0) for d in range(7)]
