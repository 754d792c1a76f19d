"""Quality classifier without labels: heuristic labellers, their estimated accuracies, and a hashed
linear scorer trained on the posterior.

Each labeller votes good, bad or abstains. Documents enter expectation-maximisation only as counts of
vote patterns, at most 3 ** len(LABELLERS) of them whatever the corpus. Posteriors of the patterns
label a bounded sample, on which the scorer is trained; it then scores every document by its words.
"""

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standcarbon.llm.rules import BASE, EXTRA, measure
from standcarbon.llm.texts import per_text, scattered, word_blocks

# Documents that the scorer is trained on: about this many, at most twice.
TRAIN_DOCS = 8_000
BUCKETS = 1 << 14
ROUNDS = 60
KEEP_FROM = 0.5

BAD, GOOD, ABSTAIN = 0, 1, 2

Counts = dict[str, int]


def _ratio(part: str, whole: str = "n_words") -> Callable[[Counts], float]:
    return lambda c: c[part] / max(1, c[whole])


def _low_is_good(value: Callable[[Counts], float], good: float, bad: float):
    def vote(c: Counts) -> int:
        x = value(c)
        return GOOD if x <= good else BAD if x > bad else ABSTAIN

    return vote


def _length(c: Counts) -> int:
    return BAD if c["n_words"] < 6 else GOOD if c["n_words"] >= 40 else ABSTAIN


def _word_length(c: Counts) -> int:
    x = c["word_chars"] / max(1, c["n_words"])
    return GOOD if 3 <= x <= 9 else BAD if x < 2 or x > 14 else ABSTAIN


LABELLERS: dict[str, Callable[[Counts], int]] = {
    "length": _length,
    "word_length": _word_length,
    "symbols": _low_is_good(_ratio("n_symbols"), 0.05, 0.2),
    "repeated_words": _low_is_good(_ratio("n_repeat_words"), 0.05, 0.2),
    "repeated_lines": _low_is_good(_ratio("n_dup_lines", "n_lines"), 0.1, 0.3),
    "distinct_words": _low_is_good(lambda c: 1 - c["n_distinct"] / max(1, c["n_words"]), 0.5, 0.75),
    "stutter": _low_is_good(_ratio("n_adjacent"), 0.02, 0.1),
    "upper_case": _low_is_good(_ratio("n_upper", "word_chars"), 0.15, 0.4),
    "marks": _low_is_good(_ratio("n_marks"), 0.05, 0.3),
}


def pattern(text: bytes) -> int:
    """The votes on a text as digits to base three."""
    counts = dict(zip((*BASE, *EXTRA), measure(text), strict=True))
    number = 0
    for vote in LABELLERS.values():
        number = number * 3 + vote(counts)
    return number


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """(pattern, labeller) votes."""
    powers = 3 ** np.arange(len(LABELLERS))[::-1]
    return patterns[:, None] // powers % 3


# The kind of fault that each labeller looks for. Faults of one kind come together; those of
# different kinds don't, so bad documents are one latent class per kind.
FAULTS = {
    "length": "short", "word_length": "short", "symbols": "symbols", "repeated_words": "repetition",
    "repeated_lines": "repetition", "distinct_words": "repetition", "stutter": "repetition",
    "upper_case": "shouting", "marks": "shouting",
}
CLASSES = ("good", *dict.fromkeys(FAULTS.values()))


@dataclass(frozen=True)
class LabelModel:
    prior: np.ndarray  # class
    votes: np.ndarray  # labeller x class x vote

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """(pattern, class) probabilities."""
        cast = votes_of(patterns)
        log = np.log(self.prior)[None, :] + sum(
            np.log(self.votes[i][:, cast[:, i]]).T for i in range(len(LABELLERS))
        )
        likely = np.exp(log - log.max(axis=1, keepdims=True))
        return likely / likely.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good."""
        return self.classes(patterns)[:, 0]

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among the votes of each labeller."""
        good, bad = self.votes[:, 0] * self.prior[0], self.votes[:, 1:] * self.prior[1:, None]
        right = good[:, GOOD] + bad[:, :, BAD].sum(axis=1)
        cast = good[:, :2].sum(axis=1) + bad[:, :, :2].sum(axis=(1, 2))
        return dict(zip(LABELLERS, (right / cast).tolist(), strict=True))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation, started from the belief that a bad vote is mostly right about its
    kind of fault."""
    cast, n, kinds = votes_of(patterns), len(LABELLERS), len(CLASSES)
    belief = np.full((len(patterns), kinds), 0.01)
    for i, name in enumerate(LABELLERS):
        belief[cast[:, i] == BAD, CLASSES.index(FAULTS[name])] = 1.0
    belief[:, 0] = np.where((cast == BAD).any(axis=1), 0.1, 1.0)
    belief /= belief.sum(axis=1, keepdims=True)
    total = max(1.0, float(counts.sum()))
    # Of each class as many votes as of a thousandth of the documents: mostly right ones.
    smooth = np.full((n, kinds, 3), 1.0)
    smooth[:, 0, GOOD] = 4.0
    for i, name in enumerate(LABELLERS):
        smooth[i, CLASSES.index(FAULTS[name]), BAD] = 4.0
    smooth *= total * 1e-3 / 6
    for _ in range(rounds):
        weight = belief * counts[:, None]
        prior = (weight.sum(axis=0) + total * 1e-3) / (total * (1 + 1e-3 * kinds))
        votes = np.stack(
            [[weight[cast[:, i] == v].sum(axis=0) for v in range(3)] for i in range(n)]
        ).transpose(0, 2, 1)
        votes = votes + smooth
        model = LabelModel(prior, votes / votes.sum(axis=2, keepdims=True))
        belief = model.classes(patterns)
    return model


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: its words and their endings, lengths normalised."""
    counts: Counter[bytes] = Counter()
    for words in word_blocks(text.lower()):
        counts.update(words)
    if not counts:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    code, mask = zlib.crc32, BUCKETS - 1
    buckets = [code(w) & mask for w in counts] + [code(w[-3:], 7) & mask for w in counts]
    values = np.fromiter(counts.values(), float, len(counts))
    sums = np.bincount(np.array(buckets), np.concatenate([values, values]), minlength=BUCKETS)
    at = np.flatnonzero(sums)
    value = np.log1p(sums[at])
    return at, value / np.sqrt((value * value).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Logistic regression on soft labels, by Adam on the whole sample; the last weight is the bias."""
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        weights[-1] = 5.0  # nothing is known: keep
        return weights
    sizes = np.array([len(a) for a, _ in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.concatenate([a for a, _ in rows])
    value = np.concatenate([v for _, v in rows])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        score = np.bincount(row, weights[at] * value, minlength=len(rows)) + weights[-1]
        error = target - 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        slope = np.append(np.bincount(at, error[row] * value, minlength=BUCKETS), error.sum())
        slope = slope / len(rows) - 1e-6 * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        weights += 0.3 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return weights


@dataclass(frozen=True)
class Classifier:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: bytes) -> float:
        at, value = hashed(text)
        x = float((self.weights[at] * value).sum() + self.weights[-1])
        return 1 / (1 + np.exp(-min(50.0, max(-50.0, x))))


def train(docs: DataFrame, text: str = "text") -> Classifier:
    """Label model from all rows, scorer from a scattered sample."""
    texts = docs.select(F.lit(0).alias("_id"), F.col(text).alias("_text"))
    votes = per_text(texts, ["_id"], "_text", "pattern int", lambda ts: {"pattern": pa.array([pattern(t) for t in ts], pa.int32())})
    counted = votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    patterns = np.array([r["pattern"] for r in counted], dtype=np.int64)
    labels = estimate(patterns, np.array([r["n"] for r in counted], dtype=float))

    def sampled(ts: list[bytes]) -> dict:
        made = [hashed(t) for t in ts]
        return {
            "pattern": pa.array([pattern(t) for t in ts], pa.int32()),
            "at": pa.array([a.astype("<u2").tobytes() for a, _ in made], pa.binary()),
            "value": pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary()),
        }

    schema = "pattern int, at binary, value binary"
    rows = per_text(scattered(texts, TRAIN_DOCS), ["_id"], "_text", schema, sampled).drop("_id")
    rows = sorted(tuple(map(lambda x: x if isinstance(x, int) else bytes(x), r)) for r in rows.collect())
    posterior = labels.posterior(np.array([r[0] for r in rows], dtype=np.int64)) if rows else np.zeros(0)
    features = [
        (np.frombuffer(r[1], "<u2").astype(np.int64), np.frombuffer(r[2], "<f4").astype(float))
        for r in rows
    ]
    return Classifier(labels, fit(features, posterior))


def classify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM
) -> DataFrame:
    """doc_id, posterior of the votes, score of the words, and keep (score >= keep_from).

    Null and empty texts are scored by the bias alone and their votes; repeated rows stay; an empty
    table gives an empty result; other columns are not looked at.
    """
    model = train(docs, text)

    def kernel(texts: list[bytes]) -> dict:
        votes = np.array([pattern(t) for t in texts], dtype=np.int64)
        posterior = model.labels.posterior(votes) if len(texts) else np.zeros(0)
        scores = [model.score(t) for t in texts]
        return {"posterior": pa.array(posterior, pa.float64()), "score": pa.array(scores, pa.float64())}

    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    scored = per_text(plain, ["_id"], "_text", "posterior double, score double", kernel)
    keep = (F.col("score") >= keep_from).alias("keep")
    return scored.select(F.col("_id").alias(doc_id), "posterior", "score", keep)
