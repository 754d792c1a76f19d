from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from standcarbon.llm import mixing as M

from .corpus import CLASHING, PLAIN, awkward_rows, table


def played(shares: dict) -> list:
    """Earliest deadline first among released blocks, slot by slot."""
    m, given, picks = sum(shares.values()), Counter(), []
    for slot in range(m):
        ready = [
            (-(-(given[s] + 1) * m // a), s)
            for s, a in shares.items()
            if given[s] < a and given[s] * m // a <= slot
        ]
        _, s = min(ready)
        given[s] += 1
        picks.append(s)
    return picks


@pytest.mark.parametrize(
    "shares", [{"a": 1}, {"a": 1, "b": 1}, {"a": 50, "b": 1, "c": 49}, {f"s{i:02}": i + 1 for i in range(15)}]
)
def test_schedule_stays_within_one_block(spark, shares):
    df = spark.createDataFrame([*shares.items()], "source string, share int")
    got = sorted((r.slot, r.source) for r in M.schedule(df).collect())
    assert [s for _, s in got] == played(shares)
    m, given = sum(shares.values()), Counter()
    for slot, source in got:
        given[source] += 1
        for s, a in shares.items():
            assert abs(given[s] - Fraction(a * (slot + 1), m)) < 1


def test_shares_are_whole_and_sum_up(spark):
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.2999), ("c", 1e-9), (None, 0.0001)], "source string, weight double")
    got = {r.source: r.share for r in M.whole_shares(weights, 1000).collect()}
    assert sum(got.values()) == 1000 and min(got.values()) == 1 and got["a"] == 698
    many = spark.createDataFrame([(str(i), 1.0) for i in range(30)], "source string, weight double")
    assert {r.share for r in M.whole_shares(many, 10).collect()} == {1}


def test_mixture_shows_all_and_keeps_shares(spark):
    rows = [(i, "x" * 99, "en", "big" if i % 3 else "small", 1) for i in range(3000)]
    docs = table(spark, rows)
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    got = M.mix_plan(docs, weights, block_bytes=1000, max_epochs=5, period=10).collect()
    shown = Counter(r.doc_id for r in got)
    assert set(shown) == set(range(3000)) and {shown[i] for i in range(3000) if i % 3} == {1}
    assert sum(shown[i] for i in range(0, 3000, 3)) == 2000
    blocks = {(r.slot, r.source) for r in got}
    assert len(blocks) == len({s for s, _ in blocks}) == 400
    given: dict = defaultdict(int)
    for slot, source in sorted(blocks):
        given[source] += 1
        assert abs(given["big"] - (slot + 1) / 2) < 1
    once = M.mix_plan(docs, weights, block_bytes=1000, max_epochs=1, period=10)
    assert Counter(r.doc_id for r in once.collect()) == Counter(range(3000))


def test_documents_come_out_in_order(spark, tmp_path):
    rows = [(i, "x" * 99, "en", f"s{i % 4}", i) for i in range(400)]
    docs = table(spark, rows, clashing=True)
    mixed = M.mix_documents(docs, block_bytes=1000, max_epochs=1)
    assert mixed.columns == [*PLAIN, *CLASHING]
    plan = {r.doc_id: (r.slot, r.offset) for r in M.mix_plan(docs, block_bytes=1000, max_epochs=1).collect()}
    order = [plan[r.doc_id] for r in mixed.collect()]
    assert order == sorted(order) and len(order) == 400


def test_awkward_tables(spark):
    rows = awkward_rows()
    got = M.mix_plan(table(spark, rows, clashing=True), max_epochs=1).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.source for r in got} == {"s0", "s1", "s2", None}
    odd = spark.createDataFrame(
        [("s0", float("nan")), ("s1", -1.0), ("zz", 4.0), (None, 1.0), ("s2", None), (None, 2.0)],
        "source string, weight double",
    )
    assert len(M.mix_plan(table(spark, rows), odd, max_epochs=1).collect()) == len(rows)
    assert M.mix_plan(table(spark, [])).count() == 0
    assert M.mix_documents(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    "weights",
    [
        [0.0301] + [1.0] * 499,
        [0.203] + [0.797 / 19] * 19,
        [float(i + 1) for i in range(1500)],
        [0.7, 0.2999, 1e-6, 0.0001],
    ],
)
def test_exact_slots_stay_within_one_block_of_the_targets(weights):
    total, n = sum(map(Fraction, weights)), 6000
    target = [Fraction(w) / total for w in weights]
    shares = M.exact_shares(weights)
    given: Counter = Counter()
    for slot, (at, i, k) in enumerate(M.exact_slots(shares, [n] * len(weights))):
        assert at == slot and k == given[i]
        # Only the block that is given, and those that are due, can be further off than before.
        given[i] += 1
        assert abs(given[i] - target[i] * (slot + 1)) < 1
        if slot % 97 == 0:
            assert all(abs(given[j] - w * (slot + 1)) < 1 for j, w in enumerate(target))
        if slot == n - 1:
            break
    assert slot == n - 1


def test_mixture_follows_targets(spark):
    """Unequal given weights, more sources than a period has slots."""
    n = 1200
    rows = [(i, "x" * 99, "en", f"s{i % n:04}", 1) for i in range(2 * n)]
    weights = spark.createDataFrame(
        [(f"s{i:04}", 3.0 if i % 2 else 1.0) for i in range(n)], "source string, weight double"
    )
    got = M.mix_plan(table(spark, rows), weights, block_bytes=100, max_epochs=3).collect()
    blocks = Counter(r.source for r in got)
    assert {blocks[f"s{i:04}"] for i in range(n)} == {2, 6}
    assert sorted(r.slot for r in got) == list(range(4 * n))


def test_short_sources_repeat_as_often_as_targets_ask(spark):
    rows = [(i, "x" * 99, "en", "big" if i else "small", 1) for i in range(1001)]
    docs = table(spark, rows)
    got = Counter(r.source for r in M.mix_plan(docs, block_bytes=100).collect())
    assert got["big"] == 1000 and got["small"] == 7  # 1000 ** 0.3 = 7.9: its blocks until the end
    report = {r.source: r for r in M.mix_report(docs, block_bytes=100).collect()}
    assert report["small"].epochs == 7 and report["big"].epochs == 1
    for r in report.values():
        assert abs(r.achieved - r.target) * sum(got.values()) < 1
    capped = M.mix_report(docs, block_bytes=100, max_epochs=2).collect()
    assert {r.source: r.epochs for r in capped} == {"big": 1, "small": 2}


def test_many_unequal_sources_follow_their_targets(spark):
    """The unrounded targets, played by fractions over 1,500 sources of very unequal size."""
    sizes = {f"s{i:04}": 90 + 3 * i for i in range(1500)} | {"large": 400_000}
    rows = [(n, "x" * (size - 1), "en", s, 1) for n, (s, size) in enumerate(sizes.items())]
    got = M.mix_plan(table(spark, rows), block_bytes=100).select("source", "slot", "epoch", "block").collect()
    shares = M.exact_shares([r.weight for r in sorted(M.target_weights(spark.createDataFrame([*sizes.items()], "source string, bytes long")).collect())])
    names = sorted(sizes)
    blocks = {s: -(-sizes[s] // 100) for s in names}
    total = max(-(-blocks[s] * M.UNIT // a) for s, a in zip(names, shares, strict=True))
    at = defaultdict(list)
    for r in got:
        at[r.source].append((r.slot, r.block + r.epoch * blocks[r.source]))
    for s, a in zip(names, shares, strict=True):
        share = Fraction(a, M.UNIT)
        first = [slot for slot, k in sorted(at[s])]
        if s != "large":  # one row: only its first block is a row's start
            for k_slot, k in at[s]:
                assert k // share <= k_slot < (k + 1) / share + 1
        assert 0 <= min(first) and max(first) < total


def test_weights_that_explode_the_mixture_are_refused(spark):
    rows = [(i, "x" * 99, "en", "big" if i else "small", 1) for i in range(400)]
    weights = spark.createDataFrame([("small", 0.9999), ("big", 0.0001)], "source string, weight double")
    with pytest.raises(ValueError, match="blocks to show"):
        M.mix_plan(table(spark, rows), weights, block_bytes=100)
