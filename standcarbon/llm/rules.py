"""Quality rules: text statistics, and a decision list learned from labelled ones.

The list is grown by sequential covering. A rule is a conjunction of thresholds on statistics; it is
grown on two thirds of the rows, condition by condition, by information gain, then conditions that
do not pay on the other third are pruned. Rows that a rule covers leave, and the next rule is grown
on the rest. The result is an ordered chain of Spark conditional expressions.
"""

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standcarbon.llm.texts import per_text, word_blocks

# Labelled rows that the list is learned from, at most; the only sample in this module.
LABELLED_ROWS = 20_000
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_distinct", "n_adjacent", "n_upper", "n_digits", "n_marks")

# What rules may test: name -> SQL over the counts.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "stuttered_words": "n_adjacent / greatest(n_words, 1)",
    "upper_case": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    # Equal hashes only select; the windows themselves decide.
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    windows = [tuple(ids[p : p + width].tolist()) for p in maybe]
    counts = Counter(windows)
    inside = np.zeros(len(ids) + 1, dtype=np.int64)
    for p, w in zip(maybe, windows, strict=True):
        if counts[w] > 1:
            inside[p] += 1
            inside[p + width] -= 1
    return int((np.cumsum(inside) > 0).sum())


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def measure(data: bytes) -> tuple[int, ...]:
    """BASE and EXTRA of one text."""
    index: dict[bytes, int] = {}
    parts, stutter, last = [], 0, None
    for words in word_blocks(data):
        for w in dict.fromkeys(words):
            index.setdefault(w, len(index))
        parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        stutter += sum(map(eq, words, words[1:])) + (words[0] == last)
        last = words[-1]
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    return (
        len(ids),
        len(data) - _without(data, _CONTINUATION + SPACES),
        _without(data, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(index),
        stutter,
        _without(data, _UPPER),
        _without(data, _DIGITS),
        _without(data, b"!?"),
    )


def statistics(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys` and the counts for every row. A null or empty text has zero of everything."""
    names = [*BASE, *EXTRA]

    def kernel(texts: list[bytes]) -> dict:
        columns = zip(*map(measure, texts), strict=True) if texts else ([] for _ in names)
        return dict(zip(names, map(list, columns), strict=True))

    return per_text(docs, keys, text, ", ".join(f"{n} long" for n in names), kernel)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.feature]
        return values > self.bound if self.above else values <= self.bound

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.bound if self.above else value <= self.bound


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction that rejects; what no rule covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self) -> Column:
        """True: keep. One `when` per rule, in order."""
        chain = None
        for rule in self.rules:
            test = F.lit(True)
            for condition in rule:
                test = test & condition.column()
            chain = F.when(test, F.lit(False)) if chain is None else chain.when(test, F.lit(False))
        return F.lit(True) if chain is None else chain.otherwise(F.lit(True))

    def rule_number(self) -> Column:
        """Which rule decides, from 1; null where none does."""
        chain = F.lit(None).cast("int")
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            test = F.lit(True)
            for condition in rule:
                test = test & condition.column()
            chain = F.when(test, F.lit(number)).otherwise(chain)
        return chain


def _covered(rule, table, rows: np.ndarray) -> np.ndarray:
    for condition in rule:
        rows = rows & condition.holds(table)
    return rows


def _best_condition(table, bad: np.ndarray, rows: np.ndarray) -> tuple[float, Condition | None]:
    """Largest FOIL gain over all thresholds between neighbouring values."""
    p0, n0 = int((rows & bad).sum()), int((rows & ~bad).sum())
    best: tuple[float, Condition | None] = (0.0, None)
    if not p0:
        return best
    before = np.log2(p0 / (p0 + n0))
    for name in table:
        values = table[name][rows]
        order = np.argsort(values, kind="stable")
        values, marks = values[order], bad[rows][order]
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        p_low = np.cumsum(marks)[cuts].astype(float)
        n_low = (cuts + 1) - p_low
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), 0.0)
            at = int(np.argmax(gain))
            if gain[at] > best[0] + 1e-9:
                bound = float((values[cuts[at]] + values[cuts[at] + 1]) / 2)
                best = (float(gain[at]), Condition(name, above, bound))
    return best


def _worth(rule, table, bad, rows) -> float:
    """Precision on held-out rows, with a prior of one good row."""
    covered = _covered(rule, table, rows)
    p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
    return p / (p + n + 1)


def learn(
    table: dict[str, np.ndarray],
    bad: np.ndarray,
    max_rules: int = 12,
    max_conditions: int = 4,
    precision: float = 0.98,
) -> DecisionList:
    """Decision list for the rows marked `bad`; a rule must be this precise on all rows left."""
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(bad), dtype=bool)
    grow = np.arange(len(bad)) % 3 != 2
    while len(rules) < max_rules and (left & bad).any():
        rule: tuple[Condition, ...] = ()
        rows = left & grow
        while len(rule) < max_conditions and (rows & ~bad).any():
            _, condition = _best_condition(table, bad, rows)
            if condition is None:
                break
            rule += (condition,)
            rows = _covered(rule, table, left & grow)
        held = left & ~grow
        while len(rule) > 1:
            shorter = [rule[:i] + rule[i + 1 :] for i in range(len(rule))]
            scored = [_worth(s, table, bad, held) for s in shorter]
            if max(scored) < _worth(rule, table, bad, held):
                break
            rule = shorter[int(np.argmax(scored))]
        covered = _covered(rule, table, left)
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        if not rule or p < 3 or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~covered
    return DecisionList(tuple(rules))


def learn_rules(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    bound: int = LABELLED_ROWS,
) -> DecisionList:
    """From at most `bound` rows of `labels` (0: bad), chosen by a hash of the id.

    Only the texts of these rows are measured. Without labelled rows the list is empty.
    """
    sample = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    sample = sample.na.drop().dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(bound)
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # The sample has two numbers a row and at most `bound` rows.
    chosen = chosen.join(F.broadcast(sample), "id")
    counts = statistics(chosen, ["id", "label"]).dropDuplicates(["id"])
    features = [F.expr(sql).alias(name) for name, sql in FEATURES.items()]
    rows = counts.select("id", "label", *features).toPandas().sort_values("id", kind="stable")
    table = {name: rows[name].to_numpy(dtype=float) for name in FEATURES}
    return learn(table, rows["label"].to_numpy() == 0)


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: the counts, base_failed, kept, and the rule that rejected.

    Null and empty texts have no words and fail the base rule; repeated rows stay; an empty table
    gives an empty result; other columns are not looked at.
    """
    rules = learn_rules(docs, labels, "quality", doc_id, text)
    failed = base_failed()
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_words"))
    return statistics(plain, ["_id"], "_words").select(
        F.col("_id").alias(doc_id),
        *BASE,
        failed.alias("base_failed"),
        (~failed & rules.verdict()).alias("kept"),
        F.when(~failed, rules.rule_number()).alias("rule"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of `docs` that are kept, all columns unchanged, without a shuffle."""
    rules = learn_rules(docs, labels, "quality", doc_id, text)
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    measured = statistics(docs.toDF(*inner), inner, inner[docs.columns.index(text)])
    return measured.filter(~base_failed() & rules.verdict()).select(*inner).toDF(*docs.columns)
