"""Token counts by byte-pair merging with a heap over a linked list.

The count of a piece is its number of initial symbols minus the number of merges. The lowest-rank
adjacent pair is popped from a heap, its two list nodes become one, and the pairs that this makes
are pushed; an entry whose nodes have changed since is skipped. No token identifiers are formed.
"""

import json
import re
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standcarbon.llm.texts import per_text

# Words whose counts a worker remembers. Beyond it the older half is forgotten, never a text.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 100


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the symbols allow."""
    n = len(symbols)
    if n < 2:
        return 0
    symbols = list(symbols)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [
        (rank, i, a, b)
        for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
        if (rank := ranks.get((a, b))) is not None
    ]
    heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        merges += 1
        symbols[i], symbols[j] = a + b, ""
        k = after[i] = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            rank = ranks.get((symbols[i], symbols[k]))
            if rank is not None:
                heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], symbols[i]))
            if rank is not None:
                heappush(heap, (rank, h, symbols[h], symbols[i]))
    return merges


class WordCounter:
    """Counts for a tokenizer file of lower-case words with word ends, split at white space.

    Normalisation and splitting of what is not plain ASCII are the library's; merging is
    `merge_count`.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.end = model["model"]["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in model["added_tokens"]]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.marks = [s.encode() for s in self.special]
        self.ascii = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
        self.symbols = byte_symbols()
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}

    def piece(self, symbols: str) -> int:
        """Tokens of one piece, given as the symbols of its bytes."""
        count = self.pieces.get(symbols)
        if count is None:
            parts = [*symbols[:-1], symbols[-1] + self.end]
            count = len(parts) - merge_count(parts, self.ranks)
            if len(symbols) <= LONGEST_REMEMBERED:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[symbols] = count
        return count

    def word(self, word: bytes) -> int:
        """Tokens of a run without ASCII white space and without special strings."""
        if word.isascii():
            symbols = self.symbols
            return sum(
                self.piece(p.decode() if p.isalnum() else "".join(symbols[b] for b in p))
                for p in self.ascii.findall(word.lower())
            )
        return sum(self.piece(p) for p, _ in self.split(self.normalize(word.decode())))

    def learn(self, words: set[bytes]) -> None:
        """Makes the counts of all these words known."""
        if len(self.known) + len(words) > REMEMBERED:
            self.older, self.known = self.known, {}
        for word in words.difference(self.known):
            count = self.older.get(word)
            self.known[word] = self.word(word) if count is None else count

    def text(self, data: bytes) -> int:
        if any(mark in data for mark in self.marks):
            parts = self.at_special.split(data.decode())
            return sum(1 if p in self.special else self.text(p.encode()) for p in parts)
        words = data.split()
        self.learn(set(words))
        return sum(map(self.known.__getitem__, words))

    def texts(self, texts: list[bytes]) -> np.ndarray:
        return np.array([self.text(t) for t in texts], dtype=np.int64)


@cache
def word_counter(path: str) -> WordCounter:
    """One for each worker process, kept from task to task."""
    return WordCounter(path)


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row, without a shuffle.

    `path` names the tokenizer's file, which every worker can read. Null and empty texts have no
    tokens; repeated rows stay; an empty table gives an empty result; other columns are not
    looked at.
    """

    def kernel(texts: list[bytes], counter: WordCounter) -> dict:
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return {"n_bytes": sizes, "n_tokens": pa.array(counter.texts(texts))}

    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    counted = per_text(
        plain, ["_id"], "_text", "n_bytes long, n_tokens long", kernel, lambda: word_counter(path)
    )
    over = (F.col("n_tokens") > limit).alias("over_limit")
    return counted.select(F.col("_id").alias(doc_id), "n_bytes", "n_tokens", over)
