"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

A source with weight w is due one block every 1 / w slots: its block k, from 0, is released at slot
floor(k / w) and due before slot ceil((k + 1) / w). Each slot goes to the released block with the
earliest deadline. With weights that sum to one, the schedule keeps every source within one block
of its share at every slot.

By default the windows are those of the target weights themselves, and the driver plays one entry
for each block of the mixture (64 KB of text). With a `period`, weights are rounded to multiples
a / M instead; the schedule then repeats after M slots, so it is computed once for M slots, in one
row whose size does not depend on the data, and used for all blocks by arithmetic. Every source has
one slot of a period at least, so the mixture then follows the rounded weights, not the targets.
"""

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standcarbon.session import scratch_path, staged

# Slots of one period, where weights are rounded to multiples of 1 / PERIOD.
PERIOD = 1000
# Where targets are given, what each source without one gets of their sum.
LEAST = 0.001
# Exact weights are multiples of 1 / UNIT: over all blocks that is far from one block.
UNIT = 1 << 60
# Slots in one batch from the driver; a plan of more than BROADCAST_SLOTS is not broadcast.
PLAN_BATCH, BROADCAST_SLOTS = 1 << 18, 1 << 20
# A mixture of more blocks than so many times those of the input is refused.
MOST_REPEATS = 200
# Bytes of text in a block.
BLOCK_BYTES = 64 << 10
# Target weights without other instruction: bytes to this power.
TEMPERATURE = 0.7
ROWS_PER_RUN = 4_000


def target_weights(bytes_by_source: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, weight) from (source, bytes): small sources get more than their share."""
    return bytes_by_source.select("source", F.pow("bytes", F.lit(temperature)).alias("weight"))


def whole_shares(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, share): whole numbers, at least one each, that sum to `period`.

    Each source gets its quota rounded down, and the rest goes to the largest remainders, ties
    to the first name. With more sources than slots the period is their number, and all are equal.
    """
    every = Window.partitionBy()  # one row per source
    n, total = F.count(F.lit(1)).over(every), F.sum("weight").over(every)
    slots = F.greatest(n, F.lit(period))
    # Every source has one slot; the others are shared out.
    quota = F.col("weight") / total * (slots - n)
    cut = weights.filter("weight > 0").select(
        "source", F.floor(quota).alias("low"), (quota - F.floor(quota)).alias("rest"), slots.alias("slots")
    )
    order = F.row_number().over(Window.orderBy(F.desc("rest"), F.asc_nulls_first("source")))
    left = F.col("slots") - F.count(F.lit(1)).over(every) - F.sum("low").over(every)
    share = 1 + F.col("low") + F.when(order <= left, 1).otherwise(0)
    return cut.select("source", share.cast("int").alias("share"))


def schedule(shares: DataFrame) -> DataFrame:
    """(source, k, slot): the slot of block k of each source within one period.

    A fold over the slots. Its state is the number of blocks given to each source; ties between
    deadlines go to the source that comes first by name.
    """
    sources = F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("order"), "source", "share")))
    one = shares.agg(sources.alias("s"), F.sum("share").cast("int").alias("m"))
    m = F.col("m")

    def pick(slot: Column, given: Column) -> Column:
        """Number of the source whose released block is due first."""
        due = F.transform(
            "s",
            lambda s, i: F.when(
                (given[i] < s["share"]) & (given[i] * m < (slot + 1) * s["share"]),
                F.struct(F.ceil((given[i] + 1) * m / s["share"]).alias("due"), i.alias("i")),
            ),
        )
        return F.array_min(due)["i"]

    start = F.struct(
        F.transform("s", lambda _: F.lit(0)).alias("given"), F.array().cast("array<int>").alias("picks")
    )

    def step(state: Column, slot: Column) -> Column:
        # A let-binding: the pick is computed once for both uses.
        return F.transform(
            F.array(pick(slot, state["given"])),
            lambda p: F.struct(
                F.transform(state["given"], lambda g, i: F.when(i == p, g + 1).otherwise(g)).alias("given"),
                F.concat(state["picks"], F.array(p)).alias("picks"),
            ),
        )[0]

    slots = F.sequence(F.lit(0), m - 1)
    picks = F.when(m > 0, F.aggregate(slots, start, step)["picks"])
    made = one.select("s", F.posexplode(picks).alias("slot", "i"))
    named = made.select("slot", F.col("s")[F.col("i")]["source"].alias("source"))
    k = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return named.select("source", k.alias("k"), "slot")


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """rows(row, id, source, bytes, ...) with `block`, that in which the row starts within its
    source, and its `offset` there.

    Rows of a source stand in order of a digest of their id. The running sum is made in two
    steps, over runs of digests and over the totals of the runs; no source is in one task.
    """
    runs = max(64, -(-rows.count() // ROWS_PER_RUN))
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    lead = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long")
    run = F.floor(lead * F.lit(runs) / F.lit(1 << 32)).cast("int")
    dealt = rows.withColumns({"order": digest, "run": run})
    sums = dealt.groupBy("source", "run").agg(F.sum("bytes").alias("sum"))
    # One row per source and run.
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "run", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "run").orderBy("order", "id", "row")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("within", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    # The same keys as the window's: the rows, with their texts, are not shuffled again.
    joined = within.join(starts, ["source", "run"]).drop("run", "order")
    at = F.col("start") + F.col("within")
    placed = {
        "block": F.floor(at / block_bytes).cast("long"),
        "offset": F.pmod(at, F.lit(block_bytes)).cast("long"),
    }
    return joined.withColumns(placed).drop("start", "within")


_NAMED, _UNNAMED = "=", "#"


def _key(source: Column) -> Column:
    """A key that is never NULL, in the order of the names, NULL first."""
    return F.coalesce(F.concat(F.lit(_NAMED), source.cast("string")), F.lit(_UNNAMED))


def _weights(sizes: DataFrame, weights: DataFrame | None, least: Column | None = None) -> DataFrame:
    """A positive weight for every source of `sizes`; `least` for those without."""
    if weights is None:
        return target_weights(sizes)
    given = weights.select(
        _key(F.col("source")).alias("source"), F.col("weight").cast("double").alias("w")
    )
    usable = ~F.isnan("w") & (F.col("w") > 0) & (F.col("w") < float("inf"))
    given = given.filter(usable).groupBy("source").agg(F.sum("w").alias("w"))
    found = sizes.join(given, "source", "left")
    if least is None:
        least = F.sum("w").over(Window.partitionBy()) * LEAST  # one row per source
    return found.select("source", F.coalesce("w", least, F.lit(1.0)).alias("weight"))


def exact_shares(weights: list[float]) -> list[int]:
    """Whole numbers in proportion to the weights that sum to UNIT. Every one is positive."""
    top = max(weights, default=1.0)
    parts = [max(1, int(w / top * UNIT)) for w in weights]
    total = sum(parts)
    shares = [max(1, p * UNIT // total) for p in parts]
    if shares:
        shares[parts.index(max(parts))] += UNIT - sum(shares)
    return shares


def exact_given(shares: list[int], blocks: list[int], max_epochs: int | None = None) -> list[int]:
    """Blocks that each source shows until the last source has been shown whole."""
    end = max((-(-b * UNIT // a) for a, b in zip(shares, blocks, strict=True)), default=0)
    due = [end * a // UNIT for a in shares]
    return due if max_epochs is None else [min(d, max_epochs * b) for d, b in zip(due, blocks, strict=True)]


def exact_slots(shares: list[int], given: list[int]):
    """(slot, source, k) of the first `given` blocks of each source, sources as numbers.

    Ties between deadlines go to the lower number. Slots of sources that are through stay empty.
    """
    ready: list[tuple[int, int, int]] = []
    waiting = [(0, i, 0) for i, n in enumerate(given) if n]
    slot = 0
    while ready or waiting:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i, k = heappop(waiting)
            heappush(ready, (-(-(k + 1) * UNIT // shares[i]), i, k))
        _, i, k = heappop(ready)
        yield slot, i, k
        slot += 1
        if k + 1 < given[i]:
            heappush(waiting, ((k + 1) * UNIT // shares[i], i, k + 1))


_NUMBER_BITS = 40
_PLAN = "_at long, slot long"


def _exact_plan(spark, shares: list[int], given: list[int]) -> DataFrame:
    """(_at, slot): `_at` is the number of the source and, below it, that of its block."""
    path = scratch_path(spark, "plan")
    rows: list[tuple[int, int]] = []

    def append() -> None:
        spark.createDataFrame(rows, _PLAN).write.mode("append").parquet(path)
        rows.clear()

    for slot, i, k in exact_slots(shares, given):
        rows.append(((i << _NUMBER_BITS) + k, slot))
        if len(rows) == PLAN_BATCH:
            append()
    append()
    plan = spark.read.schema(_PLAN).parquet(path)
    return F.broadcast(plan) if sum(given) <= BROADCAST_SLOTS else plan


def _targets(sizes: DataFrame, weights: DataFrame | None, block_bytes: int) -> list:
    """(source, bytes, blocks, weight), one row per source in the order of the keys."""
    blocks = (F.floor((F.col("bytes") - 1) / block_bytes) + 1).alias("blocks")
    known = sizes.join(_weights(sizes, weights), "source")
    return sorted(known.select("source", "bytes", blocks, "weight").collect())


def _exact(
    rows: DataFrame, weights: DataFrame | None, block_bytes: int, max_epochs: int | None
) -> DataFrame:
    spark = rows.sparkSession
    sizes = staged(rows.groupBy("source").agg(F.sum("bytes").alias("bytes")))
    about = _targets(sizes, weights, block_bytes)
    shares = exact_shares([r.weight for r in about])
    given = exact_given(shares, [r.blocks for r in about], max_epochs)
    there = sum(r.blocks for r in about)
    if sum(given) > MOST_REPEATS * there:
        raise ValueError(
            f"these weights need {sum(given)} blocks to show {there} whole: raise the weight of the "
            "largest source, drop a source, or set max_epochs"
        )
    plan = _exact_plan(spark, shares, given)
    known = spark.createDataFrame(
        [(r.source, i, r.blocks, g) for i, (r, g) in enumerate(zip(about, given, strict=True))],
        "source string, _i long, _blocks long, _given long",
    )
    shown = _blocks(rows, block_bytes).join(F.broadcast(known), "source")
    last = F.floor((F.col("_given") - 1 - F.col("block")) / F.col("_blocks")).cast("int")
    shown = shown.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    number = F.col("block") + F.col("epoch") * F.col("_blocks")
    at = F.shiftleft("_i", _NUMBER_BITS) + number
    timed = shown.withColumn("_at", at).join(plan, "_at")
    return timed.drop("_at", "_i", "_blocks", "_given")


def mixture(
    rows: DataFrame,
    weights: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
    max_epochs: int | None = None,
    period: int | None = None,
) -> DataFrame:
    """rows(row, id, source, bytes, ...), once for each time they are shown, with `epoch`, `block`,
    `offset` and `slot`. Reading order is (slot, offset).

    `rows` must be staged, as it is read several times, and `source` a key. The mixture ends when
    every source has been shown whole; a source that runs out before is shown again, as often as
    its weight asks or `max_epochs` times at most. Until a source is through with its epochs, each
    has its share of any run of slots up to less than one block: the share that its weight gives,
    or, with a `period`, its weight rounded as in `whole_shares`.
    """
    if period is None:
        return _exact(rows, weights, block_bytes, max_epochs)
    sizes = rows.groupBy("source").agg(F.sum("bytes").alias("bytes"))
    shares = staged(whole_shares(_weights(sizes, weights, F.lit(1e-12)), period))
    plan = staged(schedule(shares))
    every = Window.partitionBy()  # one row per source
    blocks = F.floor((F.col("bytes") - 1) / block_bytes) + 1
    about = sizes.join(shares, "source").withColumns(
        {"blocks": blocks, "m": F.sum("share").over(every)}
    )
    # The slot before which the last source has had its last block.
    end = F.max(F.ceil(F.col("blocks") * F.col("m") / F.col("share"))).over(every)
    due = F.floor(end * F.col("share") / F.col("m"))
    given = due if max_epochs is None else F.least(due, F.lit(max_epochs) * F.col("blocks"))
    given = given.alias("given")
    about = about.select("source", "blocks", "share", "m", given)
    placed = _blocks(rows, block_bytes)
    known = placed.join(F.broadcast(staged(about)), "source")
    last = F.floor((F.col("given") - 1 - F.col("block")) / F.col("blocks")).cast("int")
    shown = known.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    number = F.col("block") + F.col("epoch") * F.col("blocks")
    shown = shown.withColumns(
        {"_k": F.pmod(number, "share").cast("int"), "_turn": F.floor(number / F.col("share"))}
    )
    # The plan has at most `period` rows, or one per source if there are more sources.
    plan = plan.select("source", F.col("k").alias("_k"), F.col("slot").alias("_slot"))
    slot = (F.col("_turn") * F.col("m") + F.col("_slot")).cast("long")
    timed = shown.join(F.broadcast(plan), ["source", "_k"]).withColumn("slot", slot)
    return timed.drop("_k", "_turn", "_slot", "blocks", "share", "m", "given")


def mix_report(
    docs: DataFrame,
    weights: DataFrame | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    max_epochs: int | None = None,
) -> DataFrame:
    """source, bytes, target, achieved, epochs: target weight and share of the mixture's blocks of
    each source, and how often it is shown, of the mixture without `period`."""
    measured = _measured(docs, doc_id, source, text)
    rows = docs.select(*[measured[n].alias(n) for n in ("source", "bytes")])
    sizes = staged(rows.groupBy("source").agg(F.sum("bytes").alias("bytes")))
    about = _targets(sizes, weights, block_bytes)
    shares = exact_shares([r.weight for r in about])
    given = exact_given(shares, [r.blocks for r in about], max_epochs)
    made = [
        (r.source[1:] if r.source.startswith(_NAMED) else None, r.bytes, a / UNIT, g / sum(given), g / r.blocks)
        for r, a, g in zip(about, shares, given, strict=True)
    ]
    schema = f"`{source}` string, bytes long, target double, achieved double, epochs double"
    return docs.sparkSession.createDataFrame(made, schema)


def _measured(docs: DataFrame, doc_id: str, source: str, text: str) -> dict[str, Column]:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return {
        "row": F.monotonically_increasing_id(),
        "id": F.col(doc_id),
        "source": _key(F.col(source)),
        "bytes": F.octet_length(whole).cast("long") + 1,
    }


def mix_plan(
    docs: DataFrame,
    weights: DataFrame | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    **options,
) -> DataFrame:
    """doc_id, source, bytes, epoch, block, offset, slot of the mixture of all rows of `docs`.

    `weights` (source, weight) gives targets; sources without a positive one get a
    thousandth of their sum. Rows without source are a source; null texts have size one; repeated rows each have a place; an
    empty table gives an empty mixture; other columns are not looked at.
    """
    measured = _measured(docs, doc_id, source, text)
    rows = staged(docs.select(*[c.alias(n) for n, c in measured.items()]))
    mixed = mixture(rows, weights, **options)
    name = F.when(F.col("source").startswith(_NAMED), F.substr("source", F.lit(2)))
    return mixed.select(
        F.col("id").alias(doc_id), name.alias(source),
        "bytes", "epoch", "block", "offset", "slot",
    )


def mix_documents(
    docs: DataFrame,
    weights: DataFrame | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    **options,
) -> DataFrame:
    """The rows of `docs`, all columns, as the mixture shows them, in its order: the files that
    this is written to are consecutive parts of the mixture."""
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner, strict=True)]
    measured = _measured(docs, doc_id, source, text)
    # Whole texts: worth a better codec, as they are shuffled twice besides.
    rows = staged(docs.select(*kept, *[c.alias(n) for n, c in measured.items()]), "zstd")
    mixed = mixture(rows, weights, **options)
    ordered = mixed.repartitionByRange("slot", "offset", "row").sortWithinPartitions("slot", "offset", "row")
    return ordered.select(*inner).toDF(*docs.columns)
