"""Helpers for the kernels that read whole texts inside Arrow batches.

Words are `[^\\x20\\x09-\\x0D]+`. On UTF-8 bytes that is exactly `bytes.split()`, and
`bytes.lower()` lower-cases A-Z only.
"""

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standcarbon.session import staged

BLOCK_BYTES = 1 << 20
# Kernels get the texts of a batch in pieces of about this size, so a worker's memory depends
# neither on the number nor on the length of the rows in a batch, but for a single longer text.
PIECE_BYTES = 2 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def byte_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in consecutive parts of about `size` bytes, cut at white space."""
    start = 0
    while start < len(data):
        cut = _SPACE.search(data, start + size)
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def word_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, at most about `size` bytes of them at a time."""
    for block in byte_blocks(data, size):
        if words := block.split():
            yield words


def shingle_blocks(data: bytes, width: int) -> Iterator[list[bytes]]:
    """Runs of `width` words, space-joined; a text with fewer words is one run, without words none."""
    carry: list[bytes] = []
    found = False
    for words in word_blocks(data):
        carry += words
        if len(carry) < width:
            continue
        found = True
        yield [b" ".join(run) for run in zip(*(carry[i:] for i in range(width)), strict=False)]
        carry = carry[len(carry) - width + 1 :]
    if not found and carry:
        yield [b" ".join(carry)]


def per_text(
    df: DataFrame,
    keys: Iterable[str],
    text: str,
    schema: str,
    kernel: Callable[[list[bytes]], dict[str, list]],
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """`keys` and the columns of `schema` that `kernel` gives for each batch of texts.

    A null text counts as empty. Narrow: no shuffle, one Arrow batch in memory at a time.
    """
    keys = list(keys)
    given = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for piece in pieces(batch, len(keys)):
                texts = piece.column(len(keys)).cast(pa.binary()).to_pylist()
                texts = [t or b"" for t in texts]
                made = kernel(texts, state) if setup else kernel(texts)
                values = (pa.array(v) if isinstance(v, list) else v for v in made.values())
                columns = [*piece.columns[: len(keys)], *values]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *made])

    chosen = df.select(*keys, F.col(text).cast("string").alias("_whole_text"))
    return chosen.mapInArrow(run, ", ".join([*given, schema]))


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, cut where the texts of `column` pass PIECE_BYTES."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= PIECE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows or not batch.num_rows:
        yield batch.slice(start)


def offsets(sizes: Iterable[int]) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces of these sizes."""
    ends = [0]
    for size in sizes:
        ends.append(ends[-1] + size)
    return list(pairwise(ends))


def scattered(df: DataFrame, rows: int) -> DataFrame:
    """A sample of about `rows` to twice `rows` rows, whatever ids or texts repeat.

    Rows of a Parquet table are drawn by part and place in its file, so neither the splits of a
    scan nor a lost executor change the sample. Any other table is written to the shared folder
    first, so that it has such places.
    """
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = staged(df)
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"^part-(\d+)", 1)
    place = F.xxhash64(F.when(part == "", name).otherwise(part), "_metadata.row_index")
    every = max(1, df.count() // rows)
    return df.filter(F.pmod(place, F.lit(every)) == 0)


def unused(name: str, df: DataFrame) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
