import random

import numpy as np

from standcarbon.llm import weak_labels as W

from .corpus import awkward_rows, prose, table


def test_estimates_follow_the_true_classes():
    """Votes drawn from known rates: the posterior finds the bad documents again."""
    rng = np.random.default_rng(1)
    n, names = 20_000, list(W.LABELLERS)
    kind = rng.choice(len(W.CLASSES), n, p=[0.84, 0.04, 0.04, 0.04, 0.04])
    cast = np.full((n, len(names)), W.GOOD)
    for i, name in enumerate(names):
        own = kind == W.CLASSES.index(W.FAULTS[name])
        cast[own & (rng.random(n) < 0.9), i] = W.BAD
        cast[rng.random(n) < 0.1, i] = W.ABSTAIN
        cast[(kind == 0) & (rng.random(n) < 0.005), i] = W.BAD
    numbers = (cast * 3 ** np.arange(len(names))[::-1]).sum(axis=1)
    patterns, at, counts = np.unique(numbers, return_inverse=True, return_counts=True)
    model = W.estimate(patterns, counts.astype(float))
    good = model.posterior(patterns)[at] > 0.5
    assert (good == (kind == 0)).mean() > 0.95
    assert min(model.accuracies().values()) > 0.8


def test_pattern_digits():
    text = prose(random.Random(1), 80).encode()
    votes = dict(zip(W.LABELLERS, W.votes_of(np.array([W.pattern(text)]))[0], strict=True))
    assert votes["symbols"] == votes["length"] == W.GOOD
    votes = dict(zip(W.LABELLERS, W.votes_of(np.array([W.pattern(b"### ### $$")]))[0], strict=True))
    assert votes["symbols"] == votes["length"] == W.BAD


def test_held_out_quality(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        text = prose(rng, 60)
        if i % 6 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 6 == 1:
            text = " ".join(w for w in text.split()[:12] for _ in range(6))
        rows.append((i, text, "en", "s", 1))
    got = {r.doc_id: r for r in W.classify(table(spark, rows)).collect()}
    right = sum(got[i].keep == (i % 6 > 1) for i in got)
    assert right > 0.95 * len(rows)
    assert all(got[i].keep for i in got if i % 6 > 1)


def test_awkward_tables(spark):
    rows = awkward_rows()
    got = W.classify(table(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert W.classify(table(spark, [])).count() == 0
