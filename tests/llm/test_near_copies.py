"""Near copies against all pairs of shingle sets, on the shared tables and on crowded groups."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from standcarbon.llm import near_copies

from .corpus import awkward_rows, brute_components, prose, table


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a: frozenset, b: frozenset) -> bool:
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def found_groups(spark, rows: list[tuple], **options) -> dict:
    texts = table(spark, rows).select(F.col("doc_id").alias("_row"), F.col("text").alias("_text"))
    return {r._row: r.root for r in near_copies.groups(texts, **options).collect()}


def edited(rng: random.Random, text: str, words: int) -> str:
    parts = text.split(" ")
    for i in rng.sample(range(len(parts)), words):
        parts[i] = "changed" + str(rng.randrange(10**6))
    return " ".join(parts)


def test_recall_on_shared_documents(spark):
    folder = Path("/root/testdata/sf0.01/documents.parquet")
    if not folder.exists():
        pytest.skip("shared tables are absent")
    docs = [(r.doc_id, r.text, None, None, None) for r in spark.read.parquet(str(folder)).select("doc_id", "text").collect()]
    sets = {r[0]: shingles(r[1]) for r in docs}
    roots = found_groups(spark, docs)
    ids = sorted(sets)
    pairs = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if sets[a] != sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and similar(sets[a], sets[b])
    ]
    linked = sum(roots[a] == roots[b] for a, b in pairs)
    assert pairs and linked >= 0.9 * len(pairs), (linked, len(pairs))
    # Nothing else is linked: every group is connected by similar pairs.
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            assert sets[a] != sets[b] or roots[a] == roots[b]
    known = brute_components(ids, lambda a, b: similar(sets[a], sets[b]))
    assert all(known[a] == known[b] for i, a in enumerate(ids) for b in ids[i + 1 :] if roots[a] == roots[b])


@pytest.mark.parametrize("pairwise", [near_copies.PAIRWISE, 2])
def test_crowded_group(spark, pairwise):
    rng = random.Random(4)
    base, other = prose(rng, 120), prose(rng, 120)
    rows = [(i, edited(rng, base, 1), None, None, None) for i in range(150)]
    rows += [(1000 + i, prose(rng, 115 + i % 10), None, None, None) for i in range(60)]
    rows += [(2000, other, None, None, None), (2001, edited(rng, other, 2), None, None, None), (2002, edited(rng, other, 40), None, None, None)]
    roots = found_groups(spark, rows, pairwise=pairwise)
    assert len({roots[i] for i in range(150)}) == 1
    assert roots[2000] == roots[2001] != roots[2002]
    assert len(set(roots.values())) == 1 + 60 + 2


def test_rows_that_stay(spark):
    rng = random.Random(7)
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "a", None, None),
        (1, "one two three four five six seven", "b", None, None),
        (2, "x y z", "c", None, None), (3, "X Y\nz", "d", None, None), (None, "x y z", "e", None, None),
        (None, "only here once or so", "f", None, None), (None, "only here once or so", "g", None, None),
        (4, None, "h", None, None), (5, "", "i", None, None), (6, prose(rng, 20_000), "j", None, None),
    ]
    kept = near_copies.keep_representatives(table(spark, rows, clashing=True))
    langs = sorted(r.lang for r in kept.collect())
    assert langs in (list("abcfhj"), list("abcghj"))
    assert kept.columns == table(spark, rows, clashing=True).columns


@pytest.mark.parametrize("rows", [[], awkward_rows(300)])
def test_awkward_tables(spark, rows):
    kept = near_copies.keep_representatives(table(spark, rows)).collect()
    sets = {shingles(r.text) for r in kept}
    assert len(sets) == len(kept) and (rows == [] or len(kept) > 5)


def test_crowded_postings_lose_no_link(spark):
    """Every pair of a crowded posting counts, also one that shares no picked node."""
    rng = random.Random(12)
    base = prose(rng, 150)
    # Only texts with one edit are similar to those with two, and they are seldom picked.
    rows = [(i, edited(rng, base, 1 if i % 12 == 0 else 2 + i % 2), None, None, None) for i in range(120)]
    whole = found_groups(spark, rows, pairwise=10**6)
    cut = found_groups(spark, rows, pairwise=2)
    same = lambda roots: {(a, b) for a in roots for b in roots if roots[a] == roots[b]}
    assert 1 < len(set(whole.values())) < len(rows)
    assert same(whole) <= same(cut)
    sets = {r[0]: shingles(r[1]) for r in rows}
    known = brute_components(sorted(sets), lambda a, b: similar(sets[a], sets[b]))
    assert all(known[a] == known[b] for a, b in same(cut))
