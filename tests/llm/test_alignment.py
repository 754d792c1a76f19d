"""Token alignment against a plain version that compares all token ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from standcarbon.llm import alignment

from .corpus import awkward_rows, table

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def plain(rows: list[tuple]) -> Counter:
    """From the libraries' own ids and byte offsets, text by text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    points = alignment._byte_characters()

    def bytes_a(i: int) -> bytes:
        return bytes(points.index(c) for c in first.id_to_token(i))

    def bytes_b(i: int) -> bytes:
        piece = second.id_to_piece(i)
        if piece.startswith("<0x"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    made = []
    for number, text, *_ in rows:
        groups, links = [], []
        if text:
            a = [(i, bytes_a(i)) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes_b(i)) for i in second.encode(text)]
            spaced = (" " + text).encode()
            if b"".join(x for _, x in a) == spaced == b"".join(x for _, x in b):
                ends = []
                for side in (a, b):
                    at, found = 0, {}
                    for i, x in side:
                        at += len(x)
                        found[at] = i
                    ends.append(found)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                low = 0
                for cut in cuts:
                    groups.append([[str(i) for e, i in s.items() if low < e <= cut] for s in ends])
                    links.append((ends[0][cut], ends[1][cut]))
                    low = cut
        made.append((number, groups, links))
    counts = Counter(link for *_, links in made for link in links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    result = Counter()
    for number, groups, links in made:
        shown = ";".join("|".join(",".join(ids) for ids in group) for group in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        sizes = [sum(len(group[i]) for group in groups) for i in (0, 1)]
        best = sum(counts[link] == top[link[1]] for link in links)
        total = sum(counts[link] for link in links)
        result[(number, *sizes, len(groups), len(links), best, total, digest)] += 1
    return result


def rows() -> list[tuple]:
    rng = random.Random(5)
    texts = [
        "Hello, world! It's 2024.", "<|endoftext|> and <s> stay text </s><unk>", "a▁b", " lead",
        "tail \n", "tab\tand  two", "𝒳 né 日本語テスト 🙂", "\u0000x", "naïve café", "x" * 3000,
        "".join(rng.choices("ab \n\té日🙂1.,", k=4000)),
    ]
    return awkward_rows(2_000) + [(100 + i, t, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 20])
def test_equals_plain_version(spark, hot_pairs):
    given = [r for r in rows() if r[1] is None or len(r[1]) < 30_000]
    docs = table(spark, given, clashing=True)
    found = alignment.token_alignment(docs, A, B, hot_pairs=hot_pairs)
    assert Counter(tuple(r) for r in found.collect()) == plain(given)


def test_empty_table(spark):
    assert alignment.token_alignment(table(spark, []), A, B).count() == 0


@pytest.mark.parametrize("share", [1.0, 0.5, 0.05, 0.001, 0.0])
def test_cuts_are_all_found(share):
    rng = np.random.default_rng(3)
    values = np.arange(1, 5001)
    both = values[rng.random(5000) < share]
    sides = [np.union1d(both, values[(rng.random(5000) < 0.5) & (values % 2 == i)]) for i in (0, 1)]
    a, b = (np.append(np.union1d(s, both), 6000) for s in sides)
    at_a, at_b = alignment.shared_cuts(a, b)
    assert a[at_a].tolist() == b[at_b].tolist() == np.intersect1d(a, b).tolist()


def test_long_stretch_without_a_cut():
    a, b = np.append(np.arange(0, 400_000, 2), 10**6), np.append(np.arange(1, 400_001, 2), 10**6)
    at_a, at_b = alignment.shared_cuts(a, b)
    assert a[at_a].tolist() == [10**6] == b[at_b].tolist()


def test_bisections_follow_each_other(monkeypatch):
    """Intervals of one depth are in ascending order, so each bisection begins near the last."""
    rng = np.random.default_rng(3)
    a, b = (np.append(np.flatnonzero(rng.random(9000) < 0.4), 9000) for _ in "ab")
    lows, nearest = [], alignment._nearest
    monkeypatch.setattr(alignment, "_nearest", lambda *x: lows.append(x[2]) or nearest(*x))
    at_a, at_b = alignment.shared_cuts(a, b)
    assert a[at_a].tolist() == b[at_b].tolist() == np.intersect1d(a, b).tolist()
    assert len(lows) > 5 and all((np.diff(low) > 0).all() for low in lows)


def test_bytes_of_a_batch_at_once():
    table = alignment.FlatTable([b"", b" a", b" ", b"b", b"ab", b" \n"])
    ids = [np.array(i) for i in ([1, 3], [2, 4], [5], [2])]
    texts = [b"ab", b"ab", b"\n", b""]
    assert table.gives(texts, ids) and table.gives([], [])
    assert not table.gives([b"ab", b"ab", b"\n", b"a"], ids)
    assert not table.gives([b"ab", b"ab", b"b", b""], ids)
    assert not table.gives([b"aba", b"b", b"\n", b""], ids)
