"""Alignment of two tokenizers over the same text, by divide and conquer at shared cuts.

A cut is a byte offset at which a token of either tokenizer ends. An interval of tokens is halved
at the shared cut nearest to its middle, which a bisection in the other tokenizer's ends finds;
both halves follow, and an interval without a cut inside is a leaf, that is one group of tokens on
either side. All open intervals of one depth are handled together, over the texts of a batch laid
end to end, so a worker takes about log2(tokens) vectorised steps a batch.

Counts of linked id pairs are corpus-wide. Pairs that hold a fair share of all links are few by
arithmetic and are broadcast; only the links of all other pairs are shuffled to their counts.
"""

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standcarbon.llm.texts import per_text
from standcarbon.llm.token_files import ByteEncoder
from standcarbon.session import discard, staged

# A pair with at least 1 / HOT_PAIRS of all links is looked up in a broadcast table, which so has
# no more than HOT_PAIRS rows. The links of other pairs meet their counts in a shuffled join.
HOT_PAIRS = 200_000
# Steps from the middle of all intervals together, before the rest is searched block by block.
STEPS = 8
ID_BITS = 24
# Up to so many bytes of texts are compared with the bytes of their ids in one step.
WHOLE_BYTES = 8 << 20


class SpacedEncoder(ByteEncoder):
    """Ids of a blank and the text, by a byte-level tokenizer, special strings as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.marks = []
        characters = {c: b for b, c in enumerate(_byte_characters())}
        self.bytes = [b""] * len(self.sizes)
        for token, number in self.library.get_vocab().items():
            self.bytes[number] = bytes(characters.get(c, 0) for c in token)

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        return [
            np.frombuffer(self.directly(b" " + t), dtype=self.kind) if ids is None else ids
            for t, ids in zip(texts, self.arrays(texts, b" "), strict=True)
        ]


def _byte_characters() -> list[str]:
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PieceEncoder:
    """Ids of texts by a sentencepiece model, and the bytes that each id stands for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(self.model.id_to_piece(i)) for i in range(len(self.model))]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        whole = [t.decode("utf-8", "replace") for t in texts]
        return [np.array(ids, dtype=np.int64) for ids in self.model.encode(whole, num_threads=1)]


def _nearest(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray):
    """For each interval [low, high) of places in `a`: the place nearest to its middle whose value
    is in `b`, and its place in `b`; -1 where there is none."""
    at_a, at_b = np.full(len(low), -1), np.full(len(low), -1)
    middle = (low + high) // 2
    todo = np.arange(len(low))
    for step in range(STEPS):
        for place in (middle[todo] - step, middle[todo] + step)[: 2 if step else 1]:
            inside = (place >= low[todo]) & (place < high[todo]) & (at_a[todo] < 0)
            which, value = todo[inside], a[place[inside]]
            found = np.searchsorted(b, value)
            hit = b[found] == value
            at_a[which[hit]], at_b[which[hit]] = place[inside][hit], found[hit]
        wider = (middle[todo] - step > low[todo]) | (middle[todo] + step + 1 < high[todo])
        todo = todo[(at_a[todo] < 0) & wider]
        if not len(todo):
            return at_a, at_b
    for i in todo.tolist():
        reach = STEPS
        while at_a[i] < 0 and (middle[i] - reach >= low[i] or middle[i] + reach < high[i]):
            reach *= 2
            start, end = max(low[i], middle[i] - reach), min(high[i], middle[i] + reach + 1)
            found = np.searchsorted(b, a[start:end])
            hits = np.flatnonzero(b[found] == a[start:end])
            if len(hits):
                best = hits[np.argmin(np.abs(start + hits - middle[i]))]
                at_a[i], at_b[i] = start + best, found[best]
    return at_a, at_b


def _beside(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.stack([left, right], axis=1).ravel()


def shared_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` and in `b` of all values that both have, ascending.

    `a` and `b` are ascending, without repeats, and end with the same value.
    """
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = [(np.array([len(a) - 1]), np.array([len(b) - 1]))]
    low, high = np.array([0]), np.array([len(a) - 1])
    low_b, high_b = np.array([0]), np.array([len(b) - 1])
    while True:
        inner = (low < high) & (low_b < high_b)
        low, high, low_b, high_b = low[inner], high[inner], low_b[inner], high_b[inner]
        if not len(low):
            break
        at_a, at_b = _nearest(a, b, low, high)
        cut = at_a >= 0
        at_a, at_b = at_a[cut], at_b[cut]
        cuts.append((at_a, at_b))
        # Both halves side by side: intervals stay in ascending order, so a bisection begins near
        # the place that the one before found.
        low, high = _beside(low[cut], at_a + 1), _beside(at_a, high[cut])
        low_b, high_b = _beside(low_b[cut], at_b + 1), _beside(at_b, high_b[cut])
    return tuple(np.sort(np.concatenate(side)) for side in zip(*cuts, strict=True))


class FlatTable:
    """The bytes of all ids, end to end."""

    def __init__(self, table: list[bytes]):
        self.sizes = np.array([len(b) for b in table], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def gives(self, texts: list[bytes], ids: list[np.ndarray]) -> bool:
        """Whether the ids of each text are those of a blank and the text."""
        if not texts:
            return True
        every, counts = np.concatenate(ids), np.cumsum([len(i) for i in ids])
        sizes = self.sizes[every]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if not np.array_equal(ends[counts], np.cumsum([len(t) + 1 for t in texts])):
            return False
        places = np.repeat(self.starts[every] - ends[:-1], sizes)
        places += np.arange(len(places))
        return self.bytes[places].tobytes() == b" " + b" ".join(texts)


class Aligner:
    """Groups and links of texts under two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SpacedEncoder(path_a), PieceEncoder(path_b)
        self.flat_a, self.flat_b = FlatTable(self.a.bytes), FlatTable(self.b.bytes)
        # What follows an id in the written form of groups: another of its side, or the next side.
        self.shown = [f"{i}{end}" for i in range(len(self.a.bytes)) for end in ",|"]
        self.shown_b = len(self.shown)
        self.shown += [f"{i}{end}" for i in range(len(self.b.bytes)) for end in ",;"]

    def encoded(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of either side; none where a side's bytes are not those of a blank and the text."""
        none = np.zeros(0, np.int64)
        all_a, all_b = self.a.texts(texts), self.b.texts(texts)
        whole = sum(map(len, texts)) <= WHOLE_BYTES
        known = whole and all(t.gives(texts, ids) for t, ids in ((self.flat_a, all_a), (self.flat_b, all_b)))
        found = []
        for text, a, b in zip(texts, all_a, all_b, strict=True):
            same = text and (known or self._same(text, a, b))
            found.append((a.astype(np.int64), b) if same else (none, none))
        return found

    def _same(self, text: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        spaced = b" " + text
        return all(
            b"".join(map(table.__getitem__, ids.tolist())) == spaced
            for ids, table in ((a, self.a.bytes), (b, self.b.bytes))
        )

    def __call__(self, texts: list[bytes]) -> dict:
        sides = self.encoded(texts)
        n_a, n_b = (np.array([len(s[i]) for s in sides], dtype=np.int64) for i in (0, 1))
        a, b = (np.concatenate([s[i] for s in sides] or [np.zeros(0, np.int64)]) for i in (0, 1))
        at_a, at_b = shared_cuts(np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b]))
        doc_a, doc_b = np.cumsum(n_a), np.cumsum(n_b)
        cuts_to = np.searchsorted(at_a, doc_a)  # cuts before the end of each text
        n_groups = np.diff(cuts_to, prepend=0)

        # Both sides in the order in which groups are written.
        group_a = np.repeat(np.arange(len(at_a)), np.diff(at_a, prepend=-1))
        group_b = np.repeat(np.arange(len(at_b)), np.diff(at_b, prepend=-1))
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        b_before = np.concatenate([[0], at_b + 1])
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a], last_b[at_b] = 1, 1
        codes[np.arange(len(a)) + b_before[group_a]] = 2 * a + last_a
        codes[np.arange(len(b)) + at_a[group_b] + 1] = self.shown_b + 2 * b + last_b
        written, start = [], 0
        for end in (doc_a + doc_b).tolist():
            text = "".join(map(self.shown.__getitem__, codes[start:end].tolist()))
            written.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
            start = end

        # Links of each text, equal ones together.
        linked = (a[at_a] << ID_BITS) | b[at_b]
        text_of = np.repeat(np.arange(len(texts)), n_groups)
        order = np.lexsort((linked, text_of))
        linked, text_of = linked[order], text_of[order]
        new = np.ones(len(linked), dtype=bool)
        new[1:] = (np.diff(linked) != 0) | (np.diff(text_of) != 0)
        first = np.flatnonzero(new)
        times = np.diff(first, append=len(linked))
        lists = np.concatenate([[0], np.searchsorted(text_of[first], np.arange(len(texts)), "right")])
        lists = pa.array(lists, pa.int32())
        return {
            "n_a": pa.array(n_a),
            "n_b": pa.array(n_b),
            "n_groups": pa.array(n_groups.astype(np.int64)),
            "groups_sha256": pa.array(written, pa.string()),
            "pairs": pa.ListArray.from_arrays(lists, pa.array(linked[first])),
            "times": pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int64))),
        }


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, kept from task to task."""
    return Aligner(path_a, path_b)


_SCHEMA = (
    "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
)


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str) -> DataFrame:
    """_row, _id and what `Aligner` finds in every row of `docs`, staged."""
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = per_text(
        plain, ["_id"], "_text", _SCHEMA, lambda texts, found: found(texts), lambda: aligner(path_a, path_b)
    )
    return staged(rows.withColumn("_row", F.monotonically_increasing_id()))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of all linked id pairs: links that hold the pair, and whether no other pair
    of its B id has more. `pair` is the A id and, in the lower ID_BITS, the B id."""
    counted = staged(_links(rows).groupBy("pair").agg(F.sum("times").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    # One row for each id of the B vocabulary at most.
    top = counted.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    known = counted.withColumn("b", b).join(F.broadcast(top), "b")
    scored = staged(known.select("pair", "n", (F.col("n") == F.col("top")).alias("best")))
    discard(counted)
    return scored


def _links(rows: DataFrame) -> DataFrame:
    linked = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    return linked.select("_row", "l.pairs", "l.times").withColumnRenamed("pairs", "pair")


def token_alignment(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    doc_id: str = "doc_id",
    text: str = "text",
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    A is a byte-level tokenizer, read over a blank and the text, B a sentencepiece model that adds
    that blank itself; special strings are plain text. A text that is null or empty, or whose
    tokens do not give its bytes back on either side, has no tokens. As no token is without bytes,
    each cut links exactly one token of A with one of B. Repeated rows count each time; an empty
    table gives an empty result; other columns are not looked at.
    """
    rows = aligned(docs, path_a, path_b, doc_id, text)
    counts = pair_counts(rows)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") * hot_pairs >= total))
    links = _links(rows).join(hot, "pair", "left")
    cold = links.filter(F.col("n").isNull()).select("_row", "pair", "times").join(counts, "pair")

    def sums(found: DataFrame) -> DataFrame:
        best = F.when(F.col("best"), F.col("times")).otherwise(0)
        return found.groupBy("_row").agg(
            F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
        )

    parts = sums(links.filter(F.col("n").isNotNull())).unionByName(sums(cold))
    found = parts.groupBy("_row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    joined = rows.drop("pairs", "times").join(found, "_row", "left")
    return joined.select(
        F.col("_id").alias(doc_id), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
