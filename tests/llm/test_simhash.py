import random
import re
from collections import Counter

import pytest
import xxhash

from standcarbon.llm import near_copies
from standcarbon.llm import simhash as H
from standcarbon.llm.graphs import stars
from standcarbon.llm.texts import shingle_blocks

from .corpus import CLASHING, PLAIN, awkward_rows, brute_components, prose, table

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def test_fingerprint_by_hand():
    for _, text, *_ in awkward_rows(500):
        assert H.fingerprint((text or "").encode()) == plain_print(text)


def test_blocks_do_not_cut_shingles():
    words = b" ".join(b"w%d" % i for i in range(400_000))
    assert sum(map(len, shingle_blocks(words, 3))) == 399_998


def test_references_tell_blocks_apart():
    """Equal coordinates of a block mean equal bits of the block."""
    rows = [r & 0xFFFF for r in H.references()]
    rng = random.Random(1)
    for _ in range(500):
        x, y = rng.getrandbits(16), rng.getrandbits(16)
        same = all((x ^ r).bit_count() == (y ^ r).bit_count() for r in rows)
        assert same == (x == y)


@pytest.mark.parametrize("pairwise", [48, 1])
def test_components_against_all_pairs(spark, pairwise):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = []
    for i in range(300):
        value = rng.choice(centres) if rng.random() < 0.9 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            value ^= 1 << rng.randrange(64)
        prints.append((i, value))
    df = spark.createDataFrame([(i, H._signed(v)) for i, v in prints], "doc_id long, print long")
    got = {r.doc_id: r.component_id for r in H.components(df, pairwise=pairwise).collect()}
    at = dict(prints)
    assert got == brute_components([*at], lambda a, b: (at[a] ^ at[b]).bit_count() <= 2)


def test_a_long_chain_is_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.b for r in stars(df).collect()} == {0}


def test_awkward_tables(spark):
    rows = awkward_rows()
    got = H.near_duplicates(table(spark, rows, clashing=True)).collect()
    want = Counter((i, f"{plain_print(t):016x}") for i, t, *_ in rows if len(t or "") < 1e5)
    have = Counter((r.doc_id, r.fingerprint) for r in got)
    assert not want - have and len(got) == len(rows)
    same = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert set(same.values()) == {0}  # texts without words link to each other
    assert H.near_duplicates(table(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(2)
    text = prose(rng, 60)
    rows = [(i, text, "en", "s", 1) for i in (5, 3, 9, 3)] + [(4, prose(rng, 60), "en", "s", 1)]
    kept = near_copies.keep_representatives(table(spark, rows, clashing=True))
    assert kept.columns == [*PLAIN, *CLASHING]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]
    kept = near_copies.keep_representatives(table(spark, awkward_rows(300))).collect()
    assert {r.doc_id for r in kept} >= {0, 3, 4, 7, 8}
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    assert near_copies.keep_representatives(table(spark, [])).count() == 0
