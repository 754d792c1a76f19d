"""Prefix trie of conversations; subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. A node's key is its depth and the exclusive-or of
hashes of its turns, each hashed with its place: a running fold that can be cut anywhere, so
neither numbering nor keys need a conversation, or a node's members, in one task.

Contraction alternates two steps until no node is left. Rake: every leaf is taken off and its total
added to its parent. Compress: every unary chain is jumped along by pointer doubling, its nodes
remember which node their total hangs on and by how much it is larger, and the node below the chain
moves up to the chain's parent. After a compress every inner node has two children at least, so the
number of rounds is logarithmic in the nodes, and so is that of the joins in a round. Going back
over the rounds, contracted nodes take their totals from the nodes they hang on.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standcarbon.session import discard, staged

# Conversations stand in families of this many ids; a family shares the turns of its first id.
FAMILY = 5
# Fewer than this many first turns are shared.
SHARED = 9
# Bytes of ids that are joined before they go to the one task that hashes a node's list.
PIECE_BYTES = 1 << 16
_SORT_CHARS = 32


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, part, at, h1, h2, bytes): a row for each turn with an id, numbered in order.

    `part` is the task that had the row and `at` ascends with (conv, turn, role, text), over all
    parts: rows are dealt out by ranges, so a long conversation lies in several parts.
    """
    given = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    )
    order = [F.col("conv"), F.asc_nulls_first("turn")]
    starts = [F.substring(c, 1, _SORT_CHARS) for c in ("role", "text")]
    dealt = given.repartitionByRange(*order, *starts)
    sorted_ = dealt.sortWithinPartitions(*order, "role", "text")
    return staged(
        sorted_.select(
            "conv",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
            F.xxhash64("role", "text").alias("h1"),
            F.xxhash64(F.lit("second"), "text", "role").alias("h2"),
            F.octet_length("text").cast("long").alias("bytes"),
        )
    )


def _running(rows: DataFrame, part: str, order: str, values: dict[str, Column], how) -> DataFrame:
    """`rows` with running folds over each conversation, from its first row to each.

    Folded within (conv, part), then over the parts of a conversation, one row each.
    """
    inside = Window.partitionBy("conv", part).orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    fold, join = how
    folded = rows.withColumns({f"_{n}": fold(v).over(inside) for n, v in values.items()})
    sums = rows.groupBy("conv", part).agg(*[fold(v).alias(f"_s{n}") for n, v in values.items()])
    starts = sums.select(
        "conv", part, *[F.coalesce(fold(F.col(f"_s{n}")).over(before), F.lit(0)).alias(f"_b{n}") for n in values]
    )
    joined = folded.join(starts, ["conv", part])
    made = joined.withColumns({n: join(F.col(f"_{n}"), F.col(f"_b{n}")) for n in values})
    return made.drop(*[f"_{x}{n}" for n in values for x in ("", "b")])


_SUM = (F.sum, lambda a, b: a + b)
_XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): conversations(conv, n) with the number of rebuilt turns, and
    rows(conv, part, d, h1, h2, bytes) of them, `d` from 1.

    Conversation c begins with the first h turns of the first id of its family, c - c % FAMILY,
    h = crc32(decimal c) % SHARED, and goes on with its own turns after its first h.
    """
    numbered = staged(_running(turns, "part", "at", {"i": F.lit(1).cast("long")}, _SUM))
    sizes = numbered.groupBy("conv").agg(F.max("i").alias("own"))
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).alias("h")
    base = (F.col("conv") - F.col("conv") % FAMILY).alias("base")
    sizes = sizes.select("conv", "own", shared, base)
    had = sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    known = sizes.join(had, "base", "left")
    lead = F.least("h", F.coalesce("base_own", F.lit(0)))
    known = staged(known.select("conv", "h", "base", "own", lead.alias("lead")))
    conversations = known.select("conv", (F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    # At most SHARED - 1 turns of an id, for at most FAMILY conversations.
    firsts = numbered.filter((F.col("i") < SHARED) & (F.col("conv") % FAMILY == 0))
    led = known.select("conv", "base", "lead").join(
        firsts.withColumnRenamed("conv", "base"), "base"
    ).filter(F.col("i") <= F.col("lead"))
    led = led.select("conv", F.lit(-1).alias("part"), F.col("i").alias("d"), "h1", "h2", "bytes")
    kept = numbered.join(known.select("conv", "h", "lead"), "conv").filter(F.col("i") > F.col("h"))
    place = (F.col("i") - F.col("h") + F.col("lead")).alias("d")
    kept = kept.select("conv", "part", place, "h1", "h2", "bytes")
    return conversations, led.unionByName(kept)


def trie(conversations: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): nodes(node, parent, conv_id, depth, parent_conv_id, n_convs, bytes), and
    ends(node, conv) with the node at which each conversation ends."""
    placed = {
        "k1": F.xxhash64("d", "h1"), "k2": F.xxhash64(F.lit("second"), "d", "h2"),
    }
    keyed = rows.withColumns({f"own_{n}": v for n, v in placed.items()})
    keys = _running(keyed, "part", "d", {n: F.col(f"own_{n}") for n in placed}, _XOR)
    above = {f"up_{n}": F.col(n).bitwiseXOR(F.col(f"own_{n}")) for n in placed}
    path = staged(keys.withColumns(above).select("conv", "d", "k1", "k2", "up_k1", "up_k2", "bytes"))
    grouped = path.groupBy("d", "k1", "k2").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in ("up_k1", "up_k2", "bytes")],
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = conversations.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = root.filter("n_convs > 0").select(
        zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs",
        none.alias("up_k1"), none.alias("up_k2"), zero.alias("bytes"),
    )
    made = grouped.unionByName(root).withColumn("node", F.monotonically_increasing_id())
    made = staged(made)
    parents = made.select(
        (F.col("d") + 1).alias("d"), F.col("k1").alias("up_k1"), F.col("k2").alias("up_k2"),
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    joined = made.join(parents, ["d", "up_k1", "up_k2"], "left")
    nodes = staged(
        joined.select("node", "parent", "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "bytes")
    )
    last = path.join(conversations.withColumnRenamed("n", "d"), ["conv", "d"]).select("conv", "d", "k1", "k2")
    turnless = conversations.filter("n = 0").select("conv", zero.alias("d"), zero.alias("k1"), zero.alias("k2"))
    ends = last.unionByName(turnless).join(made.select("node", "d", "k1", "k2"), ["d", "k1", "k2"])
    return nodes, ends.select("node", "conv")


def _chains(tree: DataFrame, kids: DataFrame, sums: list[str]) -> DataFrame:
    """(node, parent, end, sums): the nodes with one child, the first node below with another
    number of children, and the sums over the chain from the node down to before that."""
    unary = tree.join(kids.filter("n_kids = 1"), "node").select("node", "parent", F.col("only").alias("end"), *sums)
    chains = staged(unary)
    while True:
        jumps = chains.select(F.col("node").alias("end"), F.col("end").alias("_end"), *[F.col(s).alias(f"_{s}") for s in sums])
        if chains.join(jumps.select("end"), "end", "left_semi").isEmpty():
            return chains
        jumped = chains.join(jumps, "end", "left").select(
            "node", "parent", F.coalesce("_end", "end").alias("end"),
            *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums],
        )
        further = staged(jumped)
        discard(chains)
        chains = further


def subtree_sums(tree: DataFrame, sums: list[str]) -> DataFrame:
    """(node, sums): for every node, each of `sums` over its subtree, and n_leaves of it.

    tree(node, parent, sums) is a forest; `parent` is null at its roots.
    """
    sums = [*sums, "n_leaves"]
    alive = staged(tree.select("node", "parent", *sums[:-1], F.lit(0).cast("long").alias("n_leaves")))
    done, hanging, first = [], [], True
    while not alive.isEmpty():
        kids = alive.filter("parent is not null").groupBy(F.col("parent").alias("node"))
        kids = kids.agg(F.count(F.lit(1)).alias("n_kids"))
        counted = staged(alive.join(kids, "node", "left"))
        discard(alive)
        # Rake. Only what is a leaf of the whole tree counts as one.
        leaves = counted.filter("n_kids is null").drop("n_kids")
        if first:
            leaves, first = leaves.withColumn("n_leaves", F.lit(1).cast("long")), False
        leaves = staged(leaves)
        done.append(leaves.select("node", *sums))
        raked = leaves.filter("parent is not null").groupBy(F.col("parent").alias("node"))
        raked = raked.agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        inner = counted.filter("n_kids is not null").join(raked, "node", "left")
        inner = staged(
            inner.select("node", "parent", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums])
        )
        discard(counted)
        # Compress.
        kids = inner.filter("parent is not null").groupBy(F.col("parent").alias("node"))
        kids = staged(kids.agg(F.count(F.lit(1)).alias("n_kids"), F.min("node").alias("only")))
        chains = _chains(inner, kids, sums)
        hanging.append(chains.select("node", "end", *sums))
        in_chain = chains.select("node")
        heads = chains.join(in_chain.withColumnRenamed("node", "parent"), "parent", "left_anti")
        heads = staged(heads)
        moved = heads.select(F.col("end").alias("node"), F.lit(True).alias("_moved"), F.col("parent").alias("_up"))
        gained = heads.filter("parent is not null").groupBy(F.col("parent").alias("node"))
        gained = gained.agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        rest = inner.join(in_chain, "node", "left_anti").join(moved, "node", "left").join(gained, "node", "left")
        up = F.when(F.col("_moved"), F.col("_up")).otherwise(F.col("parent")).alias("parent")
        alive = staged(
            rest.select("node", up, *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums])
        )
    if not done:
        return tree.select("node", *sums[:-1], F.lit(0).cast("long").alias("n_leaves"))
    totals = done[0]
    for more in done[1:]:
        totals = totals.unionByName(more)
    # Re-expand, the last contraction first.
    for chain in reversed(hanging):
        ends = totals.select(F.col("node").alias("end"), *[F.col(s).alias(f"_{s}") for s in sums])
        opened = chain.join(ends, "end").select("node", *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in sums])
        totals = totals.unionByName(staged(opened))
    return totals


def _hashed(column: str, separator: str):
    """For mapInArrow over rows (node, …) that come sorted: (node, digest) of the texts of each
    node, joined. Holds one hash, whatever the length of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = digest = None
        for batch in batches:
            nodes, digests = [], []
            for key, text in zip(batch["node"].to_pylist(), batch[column].to_pylist(), strict=True):
                if key != node:
                    if digest is not None:
                        nodes.append(node)
                        digests.append(digest.hexdigest())
                    node, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update((separator + text).encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    return run


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv) rows to rows (node, first, ids) of up to PIECE_BYTES of joined ids."""
    names = ["node", "first", "ids"]
    node, ids, size = None, [], 0

    def piece() -> pa.RecordBatch:
        columns = [pa.array([node]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        out = []
        for key, conv in zip(batch["node"].to_pylist(), batch["conv"].to_pylist(), strict=True):
            if ids and (key != node or size >= PIECE_BYTES):
                out.append(piece())
                ids, size = [], 0
            node = key
            ids.append(conv)
            size += 12
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if ids:
        yield piece()


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids that end at each node, ascending, comma-joined.

    A crowded node's ids are dealt to tasks by range and joined there; only joined pieces go to
    the task that hashes the node's list, which is one by the nature of the hash.
    """
    dealt = staged(ends).repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    pieces = dealt.mapInArrow(_joined_ids, "node long, first long, ids string")
    sorted_ = pieces.repartition("node").sortWithinPartitions("node", "first")
    return sorted_.mapInArrow(_hashed("ids", ","), "node long, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Null roles and texts are empty. Turns with equal numbers, and those without number, which
    come first, stand in order of role and text; repeated rows are turns of their own. Rows without
    conv_id belong to no conversation. Of a negative id c the family's first id is c - c % FAMILY
    with the sign of c. An empty table has no node, not even a root; other columns are not looked
    at.
    """
    turns = _turns(conversations, conv_id, turn, role, text)
    convs, rows = rebuilt(turns)
    nodes, ends = trie(convs, rows)
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    totals = subtree_sums(nodes.select("node", "parent", saved), ["saved_tokens"])
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    joined = nodes.join(totals, "node").join(children, "node", "left").join(end_digests(ends), "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
