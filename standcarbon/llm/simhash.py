"""SimHash near-duplicates, searched through a table of distances to reference fingerprints.

A fingerprint's Hamming distances to fixed references are its coordinates. The triangle inequality
bounds how far the coordinates of two fingerprints within `RADIUS` bits can be apart, so a pair
with a larger coordinate difference is discarded without comparing it; survivors are verified.

The references are the rows of a Walsh matrix, laid over four blocks of 16 bits, and the same rows
with one block inverted. The difference of two such distances depends on one block only, so a
pair within two bits, which touches at most two blocks, has *equal* coordinates on two blocks at
least. That turns the search into an equi-join: each fingerprint is posted under the coordinates
of the six pairs of blocks, and no pair is lost.
"""

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standcarbon.llm.graphs import stars
from standcarbon.llm.texts import per_text, shingle_blocks
from standcarbon.session import discard, staged

RADIUS = 2
BLOCKS, BLOCK_BITS = 4, 16
# Postings under one key that are compared pair by pair; a fuller key takes the way of `_balls`.
PAIRWISE = 48


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits, unsigned; a bit is set if it is in more than half of the shingles' hashes."""
    votes, total = np.zeros(64, dtype=np.int64), 0
    hashed = xxhash.xxh64_intdigest
    for shingles in shingle_blocks(text.lower(), width):
        hashes = np.array([hashed(s, 42) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(shingles)
    return int.from_bytes(np.packbits(votes * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text"):
    """(doc_id, print) for every row; `print` is the fingerprint as a signed long."""

    def kernel(texts: list[bytes]) -> dict:
        found = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
        return {"print": pa.array(found.view(np.int64))}

    return per_text(docs, [doc_id], text, "print long", kernel)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def references() -> list[int]:
    """Walsh rows over all blocks: bit b of row r is the parity of r & b."""
    rows = []
    for r in range(BLOCK_BITS):
        block = sum(((r & b).bit_count() & 1) << b for b in range(BLOCK_BITS))
        rows.append(sum(block << (BLOCK_BITS * j) for j in range(BLOCKS)))
    return rows


def _distance(print_: Column, reference: int) -> Column:
    return F.bit_count(print_.bitwiseXOR(F.lit(_signed(reference))))


def pivot_table(nodes: DataFrame) -> DataFrame:
    """nodes(print) with `screen`, eight distances packed in a long, and `blocks`, an array with
    the key of each block: all its coordinates, one per reference."""
    print_ = F.col("print")
    mask = (1 << BLOCK_BITS) - 1
    whole = [f"_d{r}" for r in range(BLOCK_BITS)]
    table = nodes.withColumns(
        {name: _distance(print_, p) for name, p in zip(whole, references(), strict=True)}
    )

    def block(j: int) -> Column:
        other = [_distance(print_, p ^ (mask << (BLOCK_BITS * j))) for p in references()]
        return F.xxhash64(*[F.col(w) - o for w, o in zip(whole, other, strict=True)])

    screen = reduce(
        lambda x, y: x.bitwiseOR(y),
        [F.shiftleft(F.col(w).cast("long"), 8 * i) for i, w in enumerate(whole[1:9])],
    )
    return table.select(
        "print", screen.alias("screen"), F.array(*[block(j) for j in range(BLOCKS)]).alias("blocks")
    )


def _apart(x: Column, y: Column) -> Column:
    """Largest coordinate difference of two packed screens."""
    at = lambda s, i: F.shiftrightunsigned(s, 8 * i).bitwiseAND(F.lit(255))
    return F.greatest(*[F.abs(at(x, i) - at(y, i)) for i in range(8)])


def _pairs(cold: DataFrame) -> DataFrame:
    """Verified pairs under keys with few postings."""
    grouped = cold.groupBy("pair", "key").agg(F.collect_list(F.struct("print", "screen")).alias("g"))
    each = grouped.select("g", F.explode("g").alias("x"))

    def near(y: Column) -> Column:
        x = F.col("x")
        close = F.bit_count(x["print"].bitwiseXOR(y["print"])) <= RADIUS
        return (y["print"] > x["print"]) & (_apart(x["screen"], y["screen"]) <= RADIUS) & close

    found = each.select(F.col("x.print").alias("a"), F.explode(F.filter("g", near)).alias("y"))
    return found.select("a", F.col("y.print").alias("b"))


def _balls(hot: DataFrame) -> DataFrame:
    """Links under keys with many postings, without pairs.

    Two prints are within two bits exactly if some value is within one bit of both. Each print is
    therefore posted under itself and its one-bit neighbours on the blocks that the key leaves
    free. At most 65 prints can meet under one value, all linked to each other, so each is linked
    to the smallest.
    """
    free = {
        p: [b for j in range(BLOCKS) if j not in pair for b in range(16 * j, 16 * j + 16)]
        for p, pair in enumerate(combinations(range(BLOCKS), 2))
    }
    flips = F.create_map(
        *[
            x
            for p, bits in free.items()
            for x in (F.lit(p), F.array(*[F.lit(_signed(m)) for m in [0, *(1 << b for b in bits)]]))
        ]
    )
    posted = hot.select("print", F.explode(flips[F.col("pair")]).alias("m")).select(
        "print", F.col("print").bitwiseXOR(F.col("m")).alias("near")
    )
    met = posted.groupBy("near").agg(F.collect_set("print").alias("g")).filter("size(g) > 1")
    low = met.select(F.array_min("g").alias("b"), F.explode("g").alias("a"))
    return low.select("a", "b").filter("a <> b").distinct()


def links(nodes: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Pairs (a, b) of distinct prints that link all prints within two bits of each other.

    Every linked pair is in the result, or, under a crowded key, connected through a print that
    is near both.
    """
    table = pivot_table(nodes)
    pairs = [
        F.struct(
            F.lit(p).alias("pair"), F.xxhash64(*[F.col("blocks")[j] for j in pair]).alias("key")
        )
        for p, pair in enumerate(combinations(range(BLOCKS), 2))
    ]
    posted = table.select("print", "screen", F.explode(F.array(*pairs)).alias("p"))
    posted = staged(posted.select("print", "screen", "p.pair", "p.key"))
    crowd = posted.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = staged(posted.join(crowd, ["pair", "key"]))
    discard(posted)
    found = _pairs(crowded.filter(F.col("n") <= pairwise))
    return found.unionByName(_balls(crowded.filter(F.col("n") > pairwise)))


def components(prints: DataFrame, doc_id: str = "doc_id", pairwise: int = PAIRWISE) -> DataFrame:
    """prints(doc_id, print) with `component_id`, the smallest id that links reach from the row.

    Equal prints are one node, whatever number of rows has them. A null id reaches and is
    reached like any other but is never a component's id while another id is there.
    """
    prints = staged(prints.select(doc_id, "print"))
    nodes = staged(prints.groupBy("print").agg(F.min(doc_id).alias("low")))
    star = stars(links(nodes.select("print"), pairwise))
    rooted = nodes.join(star.select(F.col("a").alias("print"), F.col("b").alias("root")), "print", "left")
    rooted = staged(rooted.select("print", "low", F.coalesce("root", "print").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(ids, "root").select("print", "component_id")
    return prints.join(known, "print").select(doc_id, "print", "component_id")


def hexadecimal(print_: Column) -> Column:
    return F.lpad(F.lower(F.hex(print_)), 16, "0")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of `docs`.

    Words are lower-cased (A-Z) and taken in runs of three. Null and empty texts have fingerprint
    zero and link like any other; repeated rows stay; an empty table gives an empty result; other
    columns are not looked at.
    """
    found = components(fingerprints(docs, 3, doc_id, text), doc_id)
    return found.select(doc_id, hexadecimal(F.col("print")).alias("fingerprint"), "component_id")

