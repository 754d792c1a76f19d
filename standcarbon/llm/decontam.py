"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items.

The index is inverted and cut into blocks with their largest contribution. A posting's weight is
the term's BM25 contribution to its item, divided by the item's score for itself, so a score is
the share of the item's weight that the passage holds, and one threshold suits items of any
length. Block-max WAND returns every item above the threshold; question and answer must
then really overlap with the passage.
"""

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standcarbon.llm.texts import byte_blocks, per_text, pieces
from standcarbon.session import discard, staged

THRESHOLD = 0.6
SHINGLE = 5
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.8, 0.5
BLOCK = 8
PASSAGES = 4096  # whose blocks are looked at together
K1, B = 1.2, 0.75
# Items of one index; a larger test set is searched with several, one after the other. Scores do
# not depend on it: rarity and mean length are those of the whole test set.
INDEX_ITEMS, INDEX_BYTES = 20_000, 16 << 20
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256)
)


def normal_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, ASCII marks read as blanks."""
    return text.translate(_PLAIN).split()


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """An item's words; the answer is its last sentence, or, of one sentence, its last quarter."""
    parts = [normal_words(p) for p in text.replace(b"\n", b". ").split(b". ")]
    parts = [p for p in parts if p]
    words = [w for p in parts for w in p]
    cut = len(words) - len(parts[-1]) if len(parts) > 1 else len(words) - len(words) // 4
    return words[:cut], words[cut:]


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Runs of SHINGLE words; fewer words are one run."""
    n = min(SHINGLE, len(words))
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if words else set()


@dataclass(frozen=True)
class Item:
    id: object
    question: frozenset
    answer: frozenset
    words: tuple[bytes, ...]

    @staticmethod
    def of(id_, text: bytes) -> "Item | None":
        question, answer = question_and_answer(text)
        words = (*question, *answer)
        if len(words) < SHINGLE:
            return None
        return Item(id_, frozenset(shingles(question)), frozenset(answer), words)

    def overlap(self, passage: list[bytes]) -> tuple[float, float]:
        """Share of the question's shingles and of the answer's words in the passage."""
        held = set(zip(*(passage[i:] for i in range(SHINGLE)), strict=False))
        short = len(next(iter(self.question))) if self.question else 0
        if 0 < short < SHINGLE:
            held = set(zip(*(passage[i:] for i in range(short)), strict=False))
        question = len(self.question & held) / max(1, len(self.question))
        answer = len(self.answer & set(passage)) / max(1, len(self.answer))
        return question, answer


@dataclass(frozen=True)
class Spread:
    """How words are spread over the searchable items of the whole test set: the number of items,
    their mean length, and in how many each word is, for the words of one part."""

    n: int
    mean: float
    found_in: dict[bytes, int]

    def rarity(self, word: bytes) -> float:
        df = self.found_in[word]
        return log(1 + (self.n - df + 0.5) / (df + 0.5))


def wand(postings: list[tuple[list[int], list[float]]], threshold: float):
    """All (item, score) of at least `threshold` in the postings of a query's terms.

    Cursors stand in order of their item; the pivot is the first item that the largest weights up
    to it can lift to the threshold, and cursors before it skip to it.
    """
    found = []
    tops = [max(weights) for _, weights in postings]
    at = [0] * len(postings)
    live = list(range(len(postings)))
    while True:
        live = sorted((c for c in live if at[c] < len(postings[c][0])), key=lambda c: postings[c][0][at[c]])
        reach, pivot = 0.0, None
        for c in live:
            reach += tops[c]
            if reach >= threshold:
                pivot = postings[c][0][at[c]]
                break
        if pivot is None:
            return found
        if postings[live[0]][0][at[live[0]]] == pivot:
            here = [c for c in live if postings[c][0][at[c]] == pivot]
            score = sum(postings[c][1][at[c]] for c in here)
            if score >= threshold:
                found.append((pivot, score))
            for c in here:
                at[c] += 1
        else:
            for c in live:
                if postings[c][0][at[c]] < pivot:
                    at[c] = bisect_left(postings[c][0], pivot, at[c])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of consecutive ranges, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Index:
    """Inverted index of items of similar length, and the passages that query it.

    Passages are runs of twice `span` words, `span` apart, so every run of `span` words, and with
    it every item, lies whole inside one. Blocks are runs of BLOCK items; every term keeps its
    largest weight in each block that it occurs in.
    """

    def __init__(self, items: list[Item], span: int, spread: Spread):
        self.items, self.span = items, span
        counts = [Counter(item.words) for item in items]
        postings: dict[bytes, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        for number, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(items[number].words) / spread.mean)
            parts = {t: spread.rarity(t) * tf * (K1 + 1) / (tf + norm) for t, tf in c.items()}
            whole = sum(parts.values())
            for t, weight in parts.items():
                postings[t][0].append(number)
                postings[t][1].append(weight / whole)
        self.terms, self.postings = list(postings), list(postings.values())
        blocks: list[dict[int, float]] = []
        for numbers, weights in self.postings:
            most: dict[int, float] = {}
            for number, weight in zip(numbers, weights, strict=True):
                most[number // BLOCK] = max(weight, most.get(number // BLOCK, 0.0))
            blocks.append(most)
        self.sizes = np.array([len(m) for m in blocks] + [0])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.block = np.array([b for m in blocks for b in m], dtype=np.int64)
        self.most = np.array([w for m in blocks for w in m.values()])
        self.top = np.array([max(w) for _, w in self.postings] + [0.0])
        self.n_blocks = -(-len(items) // BLOCK)

    def passages(self, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Starts, and distinct terms, of the passages whose terms could reach the threshold."""
        width, n, none = 2 * self.span, len(terms), len(self.postings)
        starts = np.arange(0, max(1, n - self.span), self.span)
        sums = np.concatenate([[0.0], np.cumsum(self.top[terms])])
        reach = sums[np.minimum(starts + width, n)] - sums[starts]
        starts = starts[reach >= threshold - 1e-6]  # running sums are off by rounding only
        padded = np.concatenate([terms, np.full(width, none)])
        distinct = np.sort(padded[starts[:, None] + np.arange(width)], axis=1)
        distinct[:, 1:][distinct[:, 1:] == distinct[:, :-1]] = none
        able = self.top[distinct].sum(axis=1) >= threshold - 1e-9
        return starts[able], distinct[able]

    def open_blocks(self, distinct: np.ndarray, threshold: float) -> np.ndarray:
        """(passage, block) pairs in which the largest weights reach the threshold together."""
        sizes = self.sizes[distinct].ravel()
        at = _ranges(self.starts[distinct].ravel(), sizes)
        passage = np.repeat(np.repeat(np.arange(len(distinct)), distinct.shape[1]), sizes)
        cells = passage * self.n_blocks + self.block[at]
        reach = np.bincount(cells, self.most[at], minlength=len(distinct) * self.n_blocks)
        return np.argwhere(reach.reshape(len(distinct), self.n_blocks) >= threshold - 1e-9)

    def in_block(self, terms: list[int], block: int) -> list[tuple[list[int], list[float]]]:
        lists = []
        for t in terms:
            numbers, weights = self.postings[t]
            low, high = (bisect_left(numbers, (block + i) * BLOCK) for i in (0, 1))
            if low < high:
                lists.append((numbers[low:high], weights[low:high]))
        return lists

    def search(self, words: list[bytes], terms: np.ndarray, threshold: float) -> dict[int, tuple]:
        """Verified items of a text: number -> (score, question overlap, answer overlap)."""
        hits: dict[int, tuple] = {}
        every, rows = self.passages(terms, threshold)
        for low in range(0, len(every), PASSAGES):
            starts, distinct = every[low : low + PASSAGES], rows[low : low + PASSAGES]
            for at, block in self.open_blocks(distinct, threshold).tolist():
                own = distinct[at][distinct[at] < len(self.postings)].tolist()
                passage = words[starts[at] : starts[at] + 2 * self.span]
                for number, score in wand(self.in_block(own, block), threshold):
                    question, answer = self.items[number].overlap(passage)
                    if question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP:
                        hit = (score, question, answer)
                        hits[number] = max(hits.get(number, hit), hit)
        return hits


@dataclass
class Searcher:
    """Indexes by length class over one bounded part of the test set."""

    texts: list[tuple[object, bytes]]
    spread: Spread

    @cached_property
    def indexes(self) -> list[Index]:
        classes: dict[int, list[Item]] = defaultdict(list)
        for id_, text in self.texts:
            item = Item.of(id_, text)
            if item:
                classes[max(4, (len(item.words) - 1).bit_length())].append(item)
        return [Index(items, 1 << c, self.spread) for c, items in sorted(classes.items())]

    @cached_property
    def vocabulary(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(dict.fromkeys(t for x in self.indexes for t in x.terms))}

    @cached_property
    def own_terms(self) -> list[np.ndarray]:
        """For each index, its term number of each word of the vocabulary and of no word."""
        tables = []
        for index in self.indexes:
            table = np.full(len(self.vocabulary) + 1, len(index.terms))
            table[[self.vocabulary[t] for t in index.terms]] = np.arange(len(index.terms))
            tables.append(table)
        return tables

    def __getstate__(self):
        return {"texts": self.texts, "spread": self.spread}

    def search(self, text: bytes, threshold: float) -> list[tuple[object, float, float, float]]:
        """(item id, score, question overlap, answer overlap), in order of the index."""
        best: dict[tuple[int, int], tuple] = {}
        longest = max((i.span for i in self.indexes), default=0)
        carry: list[bytes] = []
        for block in byte_blocks(text):
            # A passage that crosses two blocks is whole in the carried words and the new ones.
            words = carry + normal_words(block)
            ids = map(self.vocabulary.get, words, repeat(len(self.vocabulary)))
            numbers = np.fromiter(ids, np.int64, len(words))
            for at, (index, own) in enumerate(zip(self.indexes, self.own_terms, strict=True)):
                for number, hit in index.search(words, own[numbers], threshold).items():
                    best[at, number] = max(best.get((at, number), hit), hit)
            carry = words[-2 * longest :]
        return [(self.indexes[at].items[n].id, *hit) for (at, n), hit in sorted(best.items())]


def _words_of(texts: list[bytes]) -> dict[str, pa.Array]:
    """Number of words, and distinct words of those with enough to be searched."""
    words = [normal_words(t) for t in texts]
    kinds = [list(dict.fromkeys(w)) if len(w) >= SHINGLE else [] for w in words]
    return {
        "n_words": pa.array([len(w) for w in words], pa.int32()),
        "words": pa.array(kinds, pa.list_(pa.binary())),
    }


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(_row, _item, _text, n_words, words) of items with a text."""
    rows = benchmark.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(item_id).alias("_item"),
        F.col(text).cast("string").alias("_text"),
    ).filter(F.col("_text").isNotNull())
    keys = ["_row", "_item", "_text"]
    return per_text(rows, keys, "_text", "n_words int, words array<binary>", _words_of)


def not_searchable(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n_words) of the items with a text of too few words to be told from chance."""
    short = _items(benchmark, item_id, text).filter(F.col("n_words") < SHINGLE)
    return short.select(F.col("_item").alias(item_id), "n_words")


def searchers(benchmark: DataFrame, item_id: str, text: str) -> list[Searcher]:
    """The test set in parts of bounded size. Items without text are no items.

    In how many items a word is, is counted by Spark over the whole test set; each item comes with
    the counts of its own words.
    """
    known = staged(_items(benchmark, item_id, text))
    searched = known.filter(F.col("n_words") >= SHINGLE)
    n, mean = searched.agg(F.count(F.lit(1)), F.avg("n_words")).first()
    each = searched.select("_row", F.explode("words").alias("word"))
    spread = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    held = each.join(spread, "word").groupBy("_row").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    rows = searched.select("_row", "_item", "_text").join(held, "_row")
    parts: list[Searcher] = []
    texts: list[tuple[object, bytes]] = []
    found_in: dict[bytes, int] = {}
    size = 0
    for row in rows.orderBy("_item", "_text", "_row").toLocalIterator():
        texts.append((row["_item"], row["_text"].encode()))
        found_in |= {bytes(w): count for w, count in row["held"]}
        size += len(texts[-1][1])
        if len(texts) >= INDEX_ITEMS or size >= INDEX_BYTES:
            parts.append(Searcher(texts, Spread(n, mean, found_in)))
            texts, found_in, size = [], {}, 0
    discard(known)
    return [*parts, Searcher(texts, Spread(n, mean, found_in))] if texts else parts


def _per_document(
    searcher: Searcher, keys: int, threshold: float, made: Callable[[pa.RecordBatch, list], pa.RecordBatch]
):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, keys)):
            texts = batch.column(keys).cast(pa.binary()).to_pylist()
            yield made(batch, [searcher.search(t, threshold) if t else [] for t in texts])

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified leak.

    Null and empty texts leak nothing; items with fewer than SHINGLE words cannot be told from
    chance and are never found (`not_searchable` lists them); repeated rows are reported each; empty tables give an empty
    result; other columns are not looked at. No shuffle.
    """
    ids, items = docs.schema[doc_id].dataType, benchmark.schema[item_id].dataType
    schema = (
        f"`_id` {ids.simpleString()}, `_item` {items.simpleString()}, score double, "
        "question_overlap double, answer_overlap double"
    )
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items)

    def made(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        rows = [i for i, found in enumerate(hits) for _ in found]
        flat = [h for found in hits for h in found]
        columns = [
            batch.column(0).take(pa.array(rows, pa.int64())),
            pa.array([h[0] for h in flat], item_type),
            *(pa.array([h[j] for h in flat], pa.float64()) for j in (1, 2, 3)),
        ]
        names = ["_id", "_item", "score", "question_overlap", "answer_overlap"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for searcher in searchers(benchmark, item_id, item_text):
        out = out.unionByName(plain.mapInArrow(_per_document(searcher, 1, threshold, made), schema))
    return out.withColumnsRenamed({"_id": doc_id, "_item": item_id})


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of `docs` without a leak, all columns unchanged, without a shuffle."""
    at = docs.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def made(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        return batch.filter(pa.array([not h for h in hits], pa.bool_()))

    for searcher in searchers(benchmark, item_id, item_text):
        docs = docs.mapInArrow(_per_document(searcher, at, threshold, made), fields)
    return docs
