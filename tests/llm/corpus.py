"""Small awkward tables for the corpus operators."""

import random

from pyspark.sql import DataFrame, SparkSession

# Names that operators use inside; as columns of the input they must change nothing.
CLASHING = (
    "row", "id", "h", "print", "n_words", "slot", "key", "part", "group", "size", "block", "_id",
    "_text", "_c0", "_row", "_s", "epoch", "bytes", "order", "run", "label", "component_id",
)
PLAIN = ("doc_id", "text", "lang", "source", "n_chars")


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(words))


def awkward_rows(long_words: int = 60_000) -> list[tuple]:
    rng = random.Random(11)
    base = [prose(rng, 40) for _ in range(6)]
    texts = [
        None, "", " \t\n ", "one", "one two", "\n\n", *base, base[0], base[0] + " more",
        base[1].replace(" ", "  "), base[2].upper(), base[3] + "\n" + base[4], "né à " * 30,
        "日本語 🙂 x y", prose(rng, long_words), "x" * 50_000,
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (6, base[5], None, None, None), (None, base[0], None, None, None)]
    rows += [(None, None, None, None, None)]
    return rows


def table(spark: SparkSession, rows: list[tuple], clashing: bool = False) -> DataFrame:
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    if clashing:
        for name in CLASHING:
            docs = docs.selectExpr("*", f"'{name}' as `{name}`")
    return docs


def brute_components(keys: list, linked) -> dict:
    """Smallest reachable key of each key, over all pairs."""
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}
