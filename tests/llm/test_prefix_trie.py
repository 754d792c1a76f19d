"""The trie against a plain dictionary of prefixes, contraction against recursion."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from standcarbon.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows: list[tuple]) -> Counter:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(path[:-1] for path in nodes if path)
    leaves, saved = Counter(), Counter()
    for path, members in nodes.items():
        size = len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(members) - 1) * size
            leaves[path[:d]] += not children[path]
    return Counter(
        (
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        )
        for path, members in nodes.items()
    )


def conversations() -> list[tuple]:
    rng = random.Random(2)
    rows = []
    for c in range(160):
        n = rng.choice([1, 2, 3, 5, 9, 14])
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b é", ""])) for t in range(n)]
    rows += [(200 + i, t, "user", "same") for i in range(60) for t in range(12)]
    rows += [(300, t, "user", f"long {t}") for t in range(120)]  # a chain, and the base of 301
    rows += [(301, None, None, None), (301, None, "x", "y"), (301, 4, "x", "y"), (301, 4, "a", None)]
    rows += [(301, 4, "a", None), (None, 1, "user", "no id"), (10**12, 1, None, None)]
    return rows


def test_equals_plain_version(spark):
    rows = conversations()
    rng = random.Random(8)
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("conv", "node", "part", "at", "depth", "h1", "d"):
        given = given.selectExpr("*", f"'{name}' as `{name}`")
    found = prefix_trie.conversation_trie(given)
    assert Counter(tuple(r) for r in found.collect()) == plain(rows)


def test_long_conversation_over_several_parts(spark, monkeypatch):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(260)] + [(6, t, "user", f"t{t % 7}") for t in range(260)]
    given = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert prefix_trie._turns(given, "conv_id", "turn", "role", "text").select("part").distinct().count() > 1
        monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 30)
        found = prefix_trie.conversation_trie(given)
        assert Counter(tuple(r) for r in found.collect()) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("shape", ["random", "chain", "star", "caterpillar"])
def test_contraction_equals_recursion(spark, shape):
    rng = random.Random(4)
    n = 300
    parent = {
        "random": lambda i: rng.randrange(i),
        "chain": lambda i: i - 1,
        "star": lambda i: 0,
        "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2),
    }[shape]
    tree = [(0, None, 7)] + [(i, parent(i), rng.randrange(50)) for i in range(1, n)]
    kids = defaultdict(list)
    for i, p, _ in tree:
        kids[p].append(i)

    @cache
    def totals(i: int) -> tuple[int, int]:
        parts = [totals(k) for k in kids[i]]
        return tree[i][2] + sum(p[0] for p in parts), sum(p[1] for p in parts) or 1

    import sys

    sys.setrecursionlimit(5000)
    given = spark.createDataFrame(tree, "node long, parent long, w long")
    found = prefix_trie.subtree_sums(given, ["w"]).collect()
    assert {r.node: (r.w, r.n_leaves) for r in found} == {i: totals(i) for i in range(n)}
    assert len(found) == n
