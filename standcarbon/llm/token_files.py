"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A file is a Parquet table of blocks. A block holds the frames of consecutive documents, their ids
and an offset index, so one short document is read by decompressing its frame alone; the
dictionary is stored beside the blocks and every block names it by its hash. Spark's writer
commits the files, on whatever store the path is.
"""

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standcarbon.llm.texts import offsets, per_text, scattered
from standcarbon.session import discard, scratch_path, staged

# The dictionary is fitted on about this many documents; all are compressed with it.
SAMPLE_DOCS = 1_000
SAMPLE_BYTES = 32 << 10  # of each one's ids
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 256 << 10
LEVEL = 1
# Words whose ids a worker remembers.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 100
# White space other than single blanks and line ends between words, by its first byte, which few
# texts have at all: texts with such space go to the library as they are.
OTHER_SPACE = {
    b"\t": [b""], b"\r": [b""], b"\x0b": [b""], b"\x0c": [b""], b"\xc2": [b"\xc2\x85", b"\xc2\xa0"],
    b"\xe1": [b"\xe1\x9a\x80"], b"\xe2": [b"\xe2\x80", b"\xe2\x81\x9f"], b"\xe3": [b"\xe3\x80\x80"],
}
# Units in one text for the library.
RUN = 100


class ByteEncoder:
    """Ids of texts by the tokenizers library, as little-endian arrays of `width` bytes an id.

    A byte-level tokenizer splits before a blank and around line ends, so a text is the sequence
    of its words, each with the blank or line end before it. The distinct units of a batch are
    found by Arrow, looked up once each, and their ids dealt out to the texts by arithmetic. The
    library encodes each unit once, many in one call, and is asked again only for texts with other
    white space or special strings.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core; the library would start a thread for each core of the machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        top = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        self.sizes = np.zeros(top, dtype=np.int64)
        for token, number in vocabulary.items():
            self.sizes[number] = len(token)  # one character stands for one byte
        with open(path, encoding="utf-8") as file:
            self.marks = [t["content"].encode() for t in json.load(file)["added_tokens"]]
        line_end = self.library.encode("\n", add_special_tokens=False).ids
        self.line_end = len(line_end)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def directly(self, text: bytes) -> bytes:
        ids = self.library.encode(text.decode(), add_special_tokens=False).ids
        return np.array(ids, dtype=self.kind).tobytes()

    def plain(self, text: bytes) -> bool:
        if not text or text[:1] in b" \n" or text[-1:] in b" \n":
            return False
        if b"  " in text.replace(b"\n", b" ") or any(m in text for m in self.marks):
            return False
        return not any(a in text and any(s in text for s in rest) for a, rest in OTHER_SPACE.items())

    def learn(self, units: list[bytes]) -> list[bytes]:
        """Ids of units, by the library."""
        if not units:
            return []
        texts = [b"".join(units[i : i + RUN]).decode() for i in range(0, len(units), RUN)]
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(encoding.ids, dtype=np.int64) for encoding in found])
        ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum([len(u) for u in units])
        at = np.searchsorted(ends, wanted)
        if not (ends[np.minimum(at, len(ends) - 1)] == wanted).all():
            raise ValueError("this tokenizer joins words; it isn't a byte-level one")
        raw = ids.astype(self.kind).tobytes()
        cuts = ((at + 1) * self.kind.itemsize).tolist()
        return [raw[start:end] for start, end in zip([0, *cuts], cuts, strict=False)]

    def ids_of(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units."""
        if len(self.known) > REMEMBERED:
            # What is not used again before the next time is forgotten.
            self.older, self.known = self.known, {}
        found, wanted = list(map(self.known.get, units)), []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            found[i] = ids = self.older.get(units[i])
            if ids is None:
                wanted.append(i)
            else:
                self.known[units[i]] = ids
        for i, ids in zip(wanted, self.learn([units[i] for i in wanted]), strict=True):
            found[i] = ids
            if len(units[i]) <= LONGEST_REMEMBERED:
                self.known[units[i]] = ids
        return found

    def laid(self, texts: list[bytes], first: bytes) -> list[np.ndarray]:
        """Ids of plain texts, each after `first`, a blank or a line end."""
        if not texts:
            return []
        whole = first + first.join(texts)
        raw = np.frombuffer(whole, np.uint8)
        at = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))  # where units start
        buffers = [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(whole)]
        units = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, buffers).dictionary_encode()
        which = units.indices.to_numpy()
        found = self.ids_of(units.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(found), self.kind)
        sizes = np.array([len(f) for f in found], np.int64) // self.kind.itemsize
        here = sizes[which]
        ends = np.cumsum(here)
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - ends + here, here)
        places += np.arange(len(places))
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = ends[np.searchsorted(at, text_ends) - 1]
        return np.split(ids[places], cuts[:-1])

    def arrays(self, texts: list[bytes], first: bytes) -> list[np.ndarray | None]:
        """Ids of each plain text after `first`, None for the others."""
        plain = [self.plain(t) for t in texts]
        found = iter(self.laid([t for t, p in zip(texts, plain, strict=True) if p], first))
        return [next(found) if p else None for p in plain]

    def texts(self, texts: list[bytes]) -> list[bytes]:
        return [
            self.directly(t) if ids is None else ids[self.line_end :].tobytes()
            for t, ids in zip(texts, self.arrays(texts, b"\n"), strict=True)
        ]

    def documents(self, texts: list[bytes], end_id: int) -> list[bytes]:
        end = np.array([end_id], dtype=self.kind).tobytes()
        return [t + end for t in self.texts(texts)]


@cache
def byte_encoder(path: str) -> ByteEncoder:
    """One for each worker process, kept from task to task."""
    return ByteEncoder(path)


@dataclass(frozen=True)
class Dictionary:
    data: bytes

    @property
    def hash(self) -> str:
        return hashlib.sha256(self.data).hexdigest()

    def compressor(self) -> zstandard.ZstdCompressor:
        given = {"dict_data": zstandard.ZstdCompressionDict(self.data)} if self.data else {}
        return zstandard.ZstdCompressor(level=LEVEL, **given)

    def decompressor(self) -> zstandard.ZstdDecompressor:
        given = {"dict_data": zstandard.ZstdCompressionDict(self.data)} if self.data else {}
        return zstandard.ZstdDecompressor(**given)


def train_dictionary(docs: DataFrame, path: str, end_id: int, text: str) -> Dictionary:
    """From a scattered sample of rows. Empty where there is too little to learn from."""

    def kernel(texts: list[bytes], encoder: ByteEncoder) -> dict:
        arrays = encoder.documents(texts, end_id)
        return {"ids": pa.array([a[:SAMPLE_BYTES] for a in arrays], pa.binary())}

    texts = docs.select(F.col(text).alias("_text"), F.lit(0).alias("_id"))
    sample = scattered(texts, SAMPLE_DOCS)
    rows = per_text(sample, ["_id"], "_text", "ids binary", kernel, lambda: byte_encoder(path))
    samples = sorted(bytes(r["ids"]) for r in rows.collect())
    try:
        return Dictionary(zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes())
    except zstandard.ZstdError:
        return Dictionary(b"")


def encoded_frames(
    docs: DataFrame, path: str, end_id: int, dictionary: Dictionary, keys: list[str], text: str
) -> DataFrame:
    """`keys`, `n` ids with the end id, and the compressed `frame` of each row."""

    def kernel(texts: list[bytes], encoder: ByteEncoder) -> dict:
        arrays = encoder.documents(texts, end_id)
        compress, width = dictionary.compressor().compress, encoder.kind.itemsize
        return {
            "n": pa.array([len(a) // width for a in arrays], pa.int64()),
            "frame": pa.array([compress(a) for a in arrays], pa.binary()),
        }

    schema = "n long, frame binary"
    return per_text(docs, keys, text, schema, kernel, lambda: byte_encoder(path))


def _blocks(path: str, kind: int, dictionary: Dictionary, id_type: pa.DataType):
    """Kernel: sorted (id, ids length, frame) rows to rows of blocks."""

    def row(part: int, number: int, before: int, held: list) -> dict:
        return {
            "part": part,
            "block": number,
            "dictionary": dictionary.hash,
            "id_bytes": kind,
            "tokens_before": before,
            "tokens": sum(h[1] for h in held),
            "doc_ids": [h[0] for h in held],
            "starts": [a for a, _ in offsets(len(h[2]) for h in held)],
            "payload": b"".join(h[2] for h in held),
        }

    schema = pa.schema(
        [
            ("part", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()),
            ("id_bytes", pa.int32()), ("tokens_before", pa.int64()), ("tokens", pa.int64()),
            ("doc_ids", pa.list_(id_type)), ("starts", pa.list_(pa.int64())),
            ("payload", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list = []
        size = number = before = 0
        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                held.append(item)
                size += len(item[2])
                if size >= BLOCK_BYTES:
                    made = row(part, number, before, held)
                    yield pa.RecordBatch.from_pylist([made], schema)
                    number, before, held, size = number + 1, before + made["tokens"], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([row(part, number, before, held)], schema)

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Dictionary:
    """Writes the ids of all rows, in ascending order of their id, to the folder `path`.

    Null texts count as empty: the end id alone. Rows without id come first; rows with the same
    id follow each other in order of a hash of their ids. An empty table writes no block.
    """
    dictionary = train_dictionary(docs, tokenizer, end_id, text)
    width = byte_encoder(tokenizer).kind.itemsize
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    given = plain.schema["_id"].dataType.simpleString()

    # Staged: the range bounds are sampled from it, and encoding must not run twice.
    frames = staged(encoded_frames(plain, tokenizer, end_id, dictionary, ["_id"], "_text"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("frame"), F.col("n")]
    sorted_ = frames.repartitionByRange(*order).sortWithinPartitions(*order)
    from pyspark.sql.pandas.types import to_arrow_type

    kernel = _blocks(path, width, dictionary, to_arrow_type(plain.schema["_id"].dataType))
    schema = (
        "part int, block int, dictionary string, id_bytes int, tokens_before long, tokens long, "
        f"doc_ids array<{given}>, starts array<long>, payload binary"
    )
    sorted_.mapInArrow(kernel, schema).write.parquet(f"{path}/blocks")
    discard(frames)
    spark = docs.sparkSession
    row = [(dictionary.hash, bytearray(dictionary.data))]
    spark.createDataFrame(row, "hash string, data binary").write.parquet(f"{path}/dictionary")
    return dictionary


def read_token_files(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (array) of every document in the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    stored = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = Dictionary(bytes(stored["data"]))
    if dictionary.hash != stored["hash"]:
        raise ValueError(f"{path}/dictionary is damaged")
    # One row per part, that is per task that wrote.
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("sum"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("first"))
    placed = blocks.join(F.broadcast(starts), "part").select(
        (F.col("first") + F.col("tokens_before")).alias("first"),
        "dictionary", "id_bytes", "doc_ids", "starts", "payload",
    )
    given = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    id_type = blocks.schema["doc_ids"].dataType.elementType

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(id_type)
        open_frame = dictionary.decompressor().decompress
        for batch in batches:
            for block in batch.to_pylist():
                if block["dictionary"] != dictionary.hash:
                    raise ValueError("a block was written with another dictionary")
                width = np.dtype(f"<u{block['id_bytes']}")
                ends = [*block["starts"][1:], len(block["payload"])]
                data = block["payload"]
                arrays = [
                    np.frombuffer(open_frame(data[a:b]), width).astype("<u4")
                    for a, b in zip(block["starts"], ends, strict=True)
                ]
                at = offsets(len(a) for a in arrays)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["doc_ids"], kind),
                        pa.array([block["first"] + a for a, _ in at], pa.int64()),
                        pa.array([len(a) for a in arrays], pa.int64()),
                        pa.array([zlib.crc32(a.tobytes()) for a in arrays], pa.int64()),
                    ],
                    names=["_id", "start", "n_tokens", "ids_crc32"],
                )

    found = placed.mapInArrow(unpack, f"_id {given}, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("_id", doc_id)


def read_document(spark: SparkSession, path: str, doc_id) -> list[int] | None:
    """Ids of one document: one block is read, one frame decompressed."""
    blocks = spark.read.parquet(f"{path}/blocks")
    row = blocks.filter(F.array_contains("doc_ids", doc_id)).first()
    if row is None:
        return None
    stored = spark.read.parquet(f"{path}/dictionary").first()
    at = row["doc_ids"].index(doc_id)
    ends = [*row["starts"][1:], len(row["payload"])]
    frame = bytes(row["payload"])[row["starts"][at] : ends[at]]
    raw = Dictionary(bytes(stored["data"])).decompressor().decompress(frame)
    return np.frombuffer(raw, np.dtype(f"<u{row['id_bytes']}")).tolist()


def token_file_digest(
    docs: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Writes the files to the shared folder and reports what is read back from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id, doc_id, text)
    return read_token_files(spark, path, doc_id)
