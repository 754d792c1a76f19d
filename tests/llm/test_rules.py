import random
import re
from collections import Counter

import numpy as np

from standcarbon.llm import rules as R

from .corpus import CLASHING, PLAIN, awkward_rows, table

LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {
        i + j
        for i in range(len(words) - 4)
        if windows[tuple(words[i : i + 5])] > 1
        for j in range(5)
    }
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
    )


def test_counts_by_hand():
    rng = random.Random(3)
    texts = [t for _, t, *_ in awkward_rows(2000)]
    for _ in range(200):
        texts.append(" ".join(rng.choices(["a", "b", "c\n", "é#", "|", "\n\n"], k=rng.randint(0, 60))))
    for text in texts:
        assert R.measure((text or "").encode())[:5] == plain_counts(text)


def test_equal_hashes_do_not_count_as_equal_windows():
    ids = np.arange(50)
    assert R.repeated_words(ids) == 0
    assert R.repeated_words(np.concatenate([ids[:5], ids[:5]])) == 10
    assert R.repeated_words(np.zeros(7, dtype=np.int64)) == 7


def test_learned_rules_find_a_planted_one():
    rng = np.random.default_rng(1)
    table_ = {name: rng.random(3000) for name in R.FEATURES}
    bad = (table_["digits"] > 0.7) & (table_["words"] <= 0.5)
    found = R.learn(table_, bad)
    rejected = np.zeros(3000, dtype=bool)
    for rule in found.rules:
        rejected |= R._covered(rule, table_, np.ones(3000, dtype=bool))
    assert (rejected & ~bad).sum() <= 0.02 * rejected.sum() and (rejected & bad).sum() > 0.9 * bad.sum()


def test_nothing_labelled_keeps_what_passes(spark):
    docs = table(spark, awkward_rows(300))
    empty = spark.createDataFrame([], LABELS)
    rows = R.quality_verdicts(docs, empty).collect()
    assert len(rows) == docs.count()
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert {r.doc_id for r in rows if r.n_words == 0} >= {0, 1, 2}


def test_awkward_tables(spark):
    rows = awkward_rows()
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 0, 0), (8, None, 0), (999, 0, 0)], LABELS)
    got = R.quality_verdicts(table(spark, rows, clashing=True), labels).collect()
    want = Counter((i, *plain_counts(t)) for i, t, *_ in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    kept = R.keep_good(table(spark, rows, clashing=True), labels)
    assert kept.columns == [*PLAIN, *CLASHING]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert R.keep_good(table(spark, []), labels).count() == 0


def test_chain_equals_numpy(spark):
    """The emitted conditional expressions decide as the learned conditions do."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = [f"w{rng.randrange(500)}" + ("###" if bad and rng.random() < 0.7 else "") for _ in range(40)]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not bad), 0))
    docs, marks = table(spark, rows), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r.kept for r in R.quality_verdicts(docs, marks).collect()}
    assert sum(got[i] == (i % 3 != 0) for i in got) >= 297
