"""Near copies by word shingles: SimHash candidates, pivot distances, exact check of survivors.

Texts with the same set of five-word shingles are one node. A node has two fingerprints: of its
distinct words, which moves by few bits when some words change, and of its three-word runs, which
tells unrelated texts apart. Two texts within RADIUS bits on the first agree on two of its eight
blocks at least, so nodes are posted under all pairs of blocks and no such pair is missed. Of the
nodes that meet, pairs are discarded by their sizes (a similarity bounds their ratio), by the
largest difference of their distances to reference fingerprints, and by their bits; the survivors'
shingles are compared.

Under a crowded posting pairs would grow with its square. Its nodes are first posted under minima
of hashed shingles, which similar sets share with the probability of their similarity, and each is
compared with three nodes of such a posting, picked by aggregation. That links large groups. What
it leaves apart is then compared in the crowded postings themselves: every pair of nodes that are
not in one component yet, so no link is lost and the work inside a linked group is not its square.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standcarbon.llm.graphs import stars
from standcarbon.llm.simhash import references
from standcarbon.llm.texts import per_text
from standcarbon.operators.skew import many_to_many
from standcarbon.session import discard, staged

WIDTH, SIMILARITY = 5, 0.8
# Bits of the print of words, and of that of three-word runs, that similar texts differ in at most.
# Of the pairs of unlike texts with SIMILARITY in the shared tables at 0.1, 0.98 are within both.
RADIUS, WIDE_RADIUS = 6, 16
BLOCKS, BLOCK_BITS = 8, 8
PAIRWISE = 64
MINIMA = 8
_LINES = 1 << 16
_ODD = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of running products."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; of the whole sequence if there are fewer."""
    width = min(width, len(words))
    if not width:
        return words
    acc = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        acc = acc * np.uint64(_ODD) + words[j : len(words) - width + 1 + j]
    return _mixed(acc)


def print_of(hashes: np.ndarray) -> int:
    """SimHash of 64 bits, signed."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _LINES):
        part = hashes[i : i + _LINES].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes()
    return int.from_bytes(packed, "little", signed=True)


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    return np.array(list(map(known.__getitem__, words)), dtype=np.uint64)


def _measure(texts: list[bytes]) -> dict:
    rows = []
    for text in texts:
        words = word_hashes(text)
        found = np.unique(shingle_hashes(words, WIDTH))
        node = xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), 42)
        salts = np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(_ODD)
        low = [int(_mixed(found ^ s).min()) if len(found) else 0 for s in salts]
        rows.append(
            (node, len(found), print_of(_mixed(np.unique(words))), print_of(shingle_hashes(words, 3)), low)
        )
    signed = lambda values: pa.array(np.array(values, dtype=np.uint64).view(np.int64))
    minima = signed([x for r in rows for x in r[4]])
    return {
        "node": signed([r[0] for r in rows]),
        "n": pa.array([r[1] for r in rows], pa.int64()),
        "narrow": pa.array([r[2] for r in rows], pa.int64()),
        "wide": pa.array([r[3] for r in rows], pa.int64()),
        "minima": pa.ListArray.from_arrays(pa.array(range(0, MINIMA * len(rows) + 1, MINIMA), pa.int32()), minima),
    }


_SCHEMA = "node long, n long, narrow long, wide long, minima array<long>"


def _shingles(texts: list[bytes]) -> dict:
    found = [np.unique(shingle_hashes(word_hashes(t), WIDTH)) for t in texts]
    return {"shingles": pa.array([(f >> np.uint64(32)).astype(np.uint32).view(np.int32) for f in found], pa.list_(pa.int32()))}


def _distances(print_: Column) -> Column:
    """Hamming distances to eight reference fingerprints, packed in a long."""
    packed = F.lit(0).cast("long")
    for i, reference in enumerate(references()[1:9]):
        signed = reference - (1 << 64) if reference >> 63 else reference
        distance = F.bit_count(print_.bitwiseXOR(F.lit(signed))).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(distance, 8 * i))
    return packed


def _apart(x: Column, y: Column) -> Column:
    at = lambda s, i: F.shiftrightunsigned(s, 8 * i).bitwiseAND(F.lit(255))
    return F.greatest(*[F.abs(at(x, i) - at(y, i)) for i in range(8)])


def _may_link(x: Column, y: Column, radius: int) -> Column:
    sizes = F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * SIMILARITY - 1e-9
    bits = F.bit_count(x["narrow"].bitwiseXOR(y["narrow"])) <= radius
    wide = F.bit_count(x["wide"].bitwiseXOR(y["wide"])) <= WIDE_RADIUS
    return sizes & (_apart(x["pivots"], y["pivots"]) <= radius) & bits & wide


def _candidates(nodes: DataFrame, pairwise: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of nodes to compare, each once; and the crowded postings, of which these are
    only some."""
    narrow = F.col("narrow")
    mask = F.lit((1 << BLOCK_BITS) - 1)
    blocks = [F.shiftrightunsigned(narrow, i * BLOCK_BITS).bitwiseAND(mask) for i in range(BLOCKS)]
    # Sets under four shingles are similar only if they are equal.
    sized = nodes.filter("n > 3").withColumn("pivots", _distances(narrow))
    keys = [
        F.shiftleft(blocks[i], 16).bitwiseOR(F.shiftleft(blocks[j], 8)).bitwiseOR(F.lit(p).cast("long"))
        for p, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    posted = sized.withColumn("key", F.explode(F.array(*[k.cast("int") for k in keys]))).select("key", *_FIELDS)
    posted = staged(posted)
    crowd = posted.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    together = posted.join(crowd, "key")
    member = F.struct(*order_columns())
    groups = together.filter(F.col("met") <= pairwise).groupBy("key").agg(F.collect_list(member).alias("g"))
    each = groups.select("g", F.explode("g").alias("x"))

    def partner(y: Column) -> Column:
        return (y["node"] > F.col("x.node")) & _may_link(F.col("x"), y, RADIUS)

    pairs = each.select(F.col("x.node").alias("a"), F.explode(F.filter("g", partner)).alias("y"))
    pairs = pairs.select("a", F.col("y.node").alias("b"))
    hot_posted = staged(together.filter(F.col("met") > pairwise).select("key", *_FIELDS))
    hot = hot_posted.select("node").distinct()
    crowded = sized.join(hot, "node").select("node", "n", "narrow", "wide", "pivots", F.posexplode("minima").alias("j", "low"))
    crowded = staged(crowded)
    order = F.struct("n", "wide", "node", "narrow", "pivots")
    picked = crowded.groupBy("j", "low").agg(
        F.min(order).alias("p0"), F.max(order).alias("p1"),
        F.min(F.struct(F.xxhash64("wide", "j").alias("at"), *order_columns())).alias("p2"),
    )
    chosen = picked.select("j", "low", F.explode(F.array(*[F.struct(*[F.col(f"p{i}.{c}").alias(c) for c in _FIELDS]) for i in range(3)])).alias("y"))
    met = crowded.select("j", "low", F.struct(*order_columns()).alias("x")).join(chosen, ["j", "low"])
    # A shared minimum is enough here: the single-word radius does not count.
    starred = met.filter(_may_link(F.col("x"), F.col("y"), 64)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return _pairs_once(pairs.unionByName(starred)), hot_posted


def _pairs_once(pairs: DataFrame) -> DataFrame:
    both = pairs.filter("a <> b")
    return staged(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _rest(posted: DataFrame, star: DataFrame) -> DataFrame:
    """(a, b): pairs of `posted`, each once, that are in different components of `star` and may link.

    One side leaves out the largest component of each posting, as two nodes of it are no pair.
    """
    known = posted.join(star, posted["node"] == star["a"], "left")
    known = staged(known.select("key", *_FIELDS, F.coalesce("b", "node").alias("root")))
    sizes = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.count(F.lit(1)).alias("parts"))
    mixed = staged(known.join(parts.filter("parts > 1"), "key").drop("parts"))
    x = mixed.filter("root <> top").select("key", F.struct("root", *order_columns()).alias("x"), F.col("node").alias("a"))
    y = mixed.select("key", F.struct("root", "top", *order_columns()).alias("y"), F.col("node").alias("b"))
    left, right = F.col("x"), F.col("y")
    once = (right["root"] == right["top"]) | (F.col("a") < F.col("b"))
    met = many_to_many(x, y, ["key"], ["a"], ["b"])
    return _pairs_once(met.filter((left["root"] != right["root"]) & once & _may_link(left, right, RADIUS)).select("a", "b"))


_FIELDS = ("node", "n", "narrow", "wide", "pivots")


def order_columns() -> list[Column]:
    return [F.col(c) for c in _FIELDS]


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sets of shingles have SIMILARITY; `rows` has the texts."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # One text for each node that is in a pair.
    wanted = nodes.join(ends, "node").select("node", F.col("row").alias("_row"))
    texts = rows.select("_row", "_text").join(wanted, "_row").select("node", "_text")
    sets = staged(per_text(texts, ["node"], "_text", "shingles array<int>", _shingles))
    named = [sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}")) for n in "ab"]
    both = pairs.join(named[0], "a").join(named[1], "b")
    common = F.size(F.array_intersect("sa", "sb"))
    # Sizes are of the arrays, in which equal half hashes of a text are still two.
    either = F.size(F.array_union("sa", "sb"))
    return staged(both.filter(common >= either * SIMILARITY - 1e-9).select("a", "b"))


def groups(rows: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """(_row, root) of staged rows(_row, _text): rows with one root are near copies."""
    found = staged(per_text(rows, ["_row"], "_text", _SCHEMA, _measure))
    nodes = staged(
        found.groupBy("node").agg(
            F.min("_row").alias("row"), *[F.min(c).alias(c) for c in ("n", "narrow", "wide", "minima")]
        )
    )
    candidates, crowded = _candidates(nodes, pairwise)
    links = stars(_verified(candidates, rows, nodes))
    rest = _rest(crowded, links)
    if not rest.isEmpty():
        links = stars(links.unionByName(_verified(rest, rows, nodes)))
    star = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    joined = found.select("_row", "node").join(star, "node", "left")
    return joined.select("_row", F.coalesce("root", "node").alias("root"))


def keep_representatives(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pairwise: int = PAIRWISE
) -> DataFrame:
    """The row with the smallest id of each group of near copies, all columns.

    Words are lower-cased (A-Z) and taken in runs of five, fewer words as they are; texts are near
    copies if 0.8 of their distinct runs are common, or if others link them so. Null and empty
    texts are alike. Ids need not be unique: rows are told apart by themselves, and two unlike
    texts under one id both stay. A row without id stays only where its group has no id. An empty
    table gives an empty result; columns may have any names.
    """
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner, strict=True)]
    id_, whole = (inner[docs.columns.index(c)] for c in (doc_id, text))
    rows = staged(docs.select(*kept, F.monotonically_increasing_id().alias("_row")), "zstd")
    known = staged(groups(rows.select("_row", F.col(whole).alias("_text")), pairwise))
    ids = known.join(rows.select("_row", F.col(id_).alias("id")), "_row")
    first = ids.groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "_row")).alias("f"))
    stays = first.select(F.col("f._row").alias("_row"))
    goes = staged(known.join(stays, "_row", "left_anti").select("_row"))
    return rows.join(goes, "_row", "left_anti").select(*inner).toDF(*docs.columns)
