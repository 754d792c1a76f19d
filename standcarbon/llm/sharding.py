"""Sharding by vector bin packing over bytes, tokens and rows.

Groups of equal texts are the things to place. Only a bounded number of pieces is placed one by one:
groups that hold a large part of a shard, split where they hold more than that, and bundles of the
many small groups by a hash of their text. Each piece goes to the shard where the dot product of
its sizes with the residual capacity is highest, among the shards that still have room for its bytes.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standcarbon.session import staged

# A group over 1 / 8 of a shard's bytes, tokens or rows is placed by itself, in pieces of that size.
LARGE_PART = 8
SPACES = " \t\n\x0b\f\r"
# White space and the word after it, without a way back.
SPACED_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
# Bundles of small groups per shard.
BUNDLES_PER_SHARD = 256
ROWS_PER_RUN = 20_000


def text_facts(text: Column) -> dict[str, Column]:
    """Size, checksum, group and number of words of a text; null counts as empty.

    Words are counted as one character each: regexp_count would hold every word of a text at once.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    marks = F.translate(F.regexp_replace(whole, SPACED_WORD, "x"), SPACES, "")
    return {
        "size": F.octet_length(whole).cast("long") + 1,
        "text_crc32": F.crc32(whole),
        "group": F.xxhash64(whole),
        "tokens": F.length(marks).cast("long"),
    }


@dataclass(frozen=True)
class Piece:
    key: int
    part: int
    sizes: tuple[int, int, int]  # bytes, tokens, rows


def pack(pieces: list[Piece], shards: int) -> list[int]:
    """Shard of each piece, largest first; ties go to the lower key and the lower shard."""
    totals = [max(1, sum(p.sizes[d] for p in pieces)) for d in range(3)]
    share = [tuple(p.sizes[d] / totals[d] for d in range(3)) for p in pieces]
    left = [[1 / shards] * 3 for _ in range(shards)]
    order = sorted(
        range(len(pieces)), key=lambda i: (-max(share[i]), pieces[i].key, pieces[i].part)
    )
    placed = [0] * len(pieces)
    for i in order:
        want = share[i]
        room = [s for s in range(shards) if left[s][0] >= want[0]]
        if room:
            at = max(room, key=lambda s: (sum(w * x for w, x in zip(want, left[s], strict=True)), -s))
        else:
            at = max(range(shards), key=lambda s: (left[s][0], -s))
        placed[i] = at
        left[at] = [x - w for w, x in zip(want, left[at], strict=True)]
    return placed


def _numbered(facts: DataFrame) -> DataFrame:
    """`slot`: gapless from 0 within each shard, in the order of (file, name, at), in runs of
    consecutive rows small enough for one task each."""
    dealt = facts.withColumn("run", F.floor(F.col("at") / ROWS_PER_RUN))
    run = ["file", "name", "run"]
    counts = dealt.groupBy("shard", *run).agg(F.count(F.lit(1)).alias("n"))
    # One row per shard and run.
    earlier = Window.partitionBy("shard").orderBy(*run).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    starts = counts.select("shard", *run, start.alias("start"))
    inside = Window.partitionBy("shard", *run).orderBy("at")
    numbered = dealt.withColumn("_n", F.row_number().over(inside))
    slot = (F.col("start") + F.col("_n") - 1).cast("long")
    return numbered.join(starts, ["shard", *run]).withColumn("slot", slot)


def _places(docs: DataFrame, ordered: bool) -> tuple[DataFrame, dict[str, Column]]:
    """`docs` and where each row stands: number and name of its file, and its number there.

    Files of an ordered table are read in the order of their part numbers, whatever splits Spark
    makes of them; a table that is not just files is written first, as only files keep an order.
    """
    if not ordered:
        row = F.monotonically_increasing_id()
        index = row.bitwiseAND(F.lit((1 << 33) - 1))
        return docs, {"file": F.shiftright(row, 33), "name": F.lit(""), "at": index}
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = staged(docs)
    name = F.col("_metadata.file_name")
    part = F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.lit(-1))
    return docs, {"file": part, "name": name, "at": F.col("_metadata.row_index")}


def place(
    docs: DataFrame,
    shards: int = 16,
    doc_id: str = "doc_id",
    text: str = "text",
    ordered: bool = False,
):
    """One row per row of `docs`: id, size, text_crc32, group, shard and slot.

    With `ordered`, the slots of each shard follow the order of the rows in the files of `docs`.

    Sizes of shards are near equal in bytes; tokens and rows are balanced as far as that allows.
    Equal texts share a shard unless they hold more than 1 / 8 of one in bytes, tokens or rows,
    then pieces of them do.
    Null and empty texts have size 1; repeated rows each get a slot; an empty table gives an empty
    result; other columns are not looked at.
    """
    docs, places = _places(docs, ordered)
    facts = docs.select(
        F.col(doc_id).alias("id"),
        *[c.alias(n) for n, c in text_facts(F.col(text)).items()],
        F.monotonically_increasing_id().alias("row"),
        *[c.alias(n) for n, c in places.items()],
    )
    facts = staged(facts)  # fixes `row`
    sums = {"bytes": F.sum("size"), "tokens": F.sum("tokens"), "rows": F.count(F.lit(1))}
    sums = [c.alias(n) for n, c in sums.items()]
    totals = facts.agg(*sums).first()
    # At most three times shards x LARGE_PART groups can be larger than a limit.
    parts = F.greatest(
        *[F.ceil(F.col(n) / max(1, (totals[n] or 0) // (shards * LARGE_PART))) for n in totals.asDict()]
    )
    large = facts.groupBy("group").agg(*sums).select("group", parts.cast("long").alias("parts"))
    large = staged(large.filter("parts > 1"))
    split = facts.join(F.broadcast(large), "group", "left")
    own = F.col("parts").isNotNull()
    bundle = F.pmod("group", F.lit(shards * BUNDLES_PER_SHARD))
    keyed = split.withColumns(
        {
            "key": F.when(own, F.col("group")).otherwise(bundle),
            "part": F.when(own, F.pmod(F.xxhash64("row"), "parts")).otherwise(F.lit(-1)),
        }
    ).drop("parts")
    sums = keyed.groupBy("key", "part").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")
    )
    # Bounded: bundles, and pieces of the large groups, at most six times LARGE_PART a shard.
    pieces = [Piece(r["key"], r["part"], (r["bytes"], r["tokens"], r["n"])) for r in sums.collect()]
    pieces.sort(key=lambda p: (p.key, p.part))
    where = list(zip(pieces, pack(pieces, shards), strict=True))
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(p.key, p.part, s) for p, s in where], "key long, part long, shard int"
    )
    placed = keyed.join(F.broadcast(plan), ["key", "part"]).drop("key", "part", "tokens")
    numbered = _numbered(staged(placed))
    return numbered.select(
        F.col("id").alias(doc_id), "size", "text_crc32", "group", "shard", "slot"
    )


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    doc_id: str = "doc_id",
    text: str = "text",
    ordered: bool = False,
):
    """The contract's table: place() with its law."""
    return place(docs, shards, doc_id, text, ordered).select(
        doc_id,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "group",
    )
