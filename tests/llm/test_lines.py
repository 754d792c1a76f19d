import random
from collections import Counter, defaultdict

import pytest

from standcarbon.llm import lines as L

from .corpus import CLASHING, PLAIN, awkward_rows, brute_components, table


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def plain_removed(docs: dict[int, str]) -> dict[int, list[int]]:
    lines = [(i, p, x.strip(" \t\r\x0b\x0c")) for i in sorted(docs) for p, x in enumerate(docs[i].split("\n"))]
    long = sorted({x for _, _, x in lines if len(x) >= L.MIN_CHARS})
    group = brute_components(long, one_edit)
    seen, removed = set(), defaultdict(list)
    for i, p, x in lines:
        if len(x) >= L.MIN_CHARS:
            if group[x] in seen:
                removed[i].append(p)
            seen.add(group[x])
    return removed


@pytest.mark.parametrize("pairwise", [64, 2])
def test_against_all_pairs(spark, pairwise, monkeypatch):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcd ", k=rng.randint(15, 30))) for _ in range(40)]

    def changed(x: str) -> str:
        for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
            i, kind = rng.randrange(len(x) + 1), rng.choice("sid")
            middle = "" if kind == "d" else rng.choice("abcdé")
            x = x[:i] + middle + x[i + (kind != "i") :]
        return x

    docs = {i: "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 9))) for i in range(150)}
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    rows, repeated = L.repeated_lines(df, pairwise=pairwise)
    ids = {r.row: r.doc_id for r in rows.collect()}
    got = defaultdict(list)
    for r in sorted(repeated.collect()):
        got[ids[r.row]].append(r.pos)
    want = plain_removed(docs)
    assert {i: sorted(p) for i, p in got.items()} == want and sum(map(len, want.values())) > 100


def test_bitmap_loses_nothing(spark):
    from pyspark.sql import functions as F

    hashed = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    wanted = hashed.filter("id % 50 = 7").select("h")
    near = L._maybe(hashed, wanted)
    assert near.join(wanted, "h", "left_semi").count() == 400 and near.count() < 500


def test_awkward_tables(spark):
    rows = awkward_rows()
    got = L.line_report(table(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_lines == by_id[1].n_lines == 1 and by_id[5].n_lines == 3
    assert all(by_id[i].n_removed == 0 for i in range(6))
    copies = Counter(r.n_removed for r in got if r.doc_id == 6)
    assert copies[1] >= 2  # repeated rows: the line stays in one place only
    assert by_id[16].n_lines == 2 and by_id[16].n_removed == 2
    assert L.line_report(table(spark, [])).count() == 0


def test_short_lines_are_compared_exactly(spark):
    rows = [(1, "yes\n\nno\n yes", "en", "s", 1), (2, "\nno\t\nYes\nyes!", "en", "s", 1), (3, "no", "en", "s", 1)]
    got = {r.doc_id: r.removed for r in L.line_report(table(spark, rows)).collect()}
    assert got == {1: [3], 2: [1], 3: [0]}


def test_lines_are_taken_out(spark):
    long = "a line of more than twenty characters"
    texts = [f"yes\n{long}\n\n yes", f"{long}!\n\t new \n\nno", None, "yes", "\n\n", "né 日本\nno"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = L.without_repeated_lines(table(spark, rows, clashing=True))
    assert got.columns == [*PLAIN, *CLASHING]
    assert {r.doc_id: r.text for r in got.collect()} == {
        0: f"yes\n{long}\n", 1: "\t new \n\nno", 2: None, 3: "", 4: "\n\n", 5: "né 日本",
    }
    assert L.without_repeated_lines(table(spark, [])).count() == 0
