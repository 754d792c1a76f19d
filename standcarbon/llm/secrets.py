"""Secret scan: fixed patterns, and a conditional random field that finds what they miss.

The field tags tokens as secret begin, inside or outside from shape, neighbours and features of
the file. It is trained here, on windows around the spans that the patterns find in a bounded
sample, and decoded by Viterbi. Most tokens lead for `outside` by more than any transition can make
up; they are outside on every best path, so only the stretches between them need decoding.
"""

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standcarbon.llm import crf
from standcarbon.llm.texts import per_text, pieces, scattered

# The field is trained on windows of a sample of about this many documents.
SAMPLE_DOCS = 20_000
WINDOWS = 8_000
WINDOWS_PER_DOC = 4
WINDOW = 32
# Added to the order of windows without a secret.
_PLAIN = 1 << 53
REMEMBERED = 250_000
LONGEST_REMEMBERED = 100

# Fixed patterns of the contract, per kind, with the group whose length counts and its minimum.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

Span = tuple[str, int, int]
_HEX_MARKS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_NAMES = (b"passw", b"secret", b"token", b"api")


def base_matches(text: str, data: bytes) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the patterns, in code points."""
    found = []
    lower = data.lower()
    if any(name in lower for name in _NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                found.append(("assign", m.start(), m.end(), m.start(2)))
    if b"AKIA" in data:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                found.append(("access", m.start(), m.end(), m.start()))
    if b"\1" * 16 in data.translate(_HEX_MARKS):
        found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


# --- tokens and their classes ---

TOKEN = re.compile(rb"[A-Za-z0-9+/_\x80-\xff-]+|.", re.DOTALL)
_KEYWORDS = (
    (b"password", 1), (b"passwd", 1), (b"pwd", 1), (b"secret", 2), (b"token", 3), (b"bearer", 3),
    (b"api", 4), (b"key", 4), (b"auth", 5), (b"credential", 5), (b"akia", 6),
)
N_KINDS, N_LENGTHS, N_WORDS, N_SPREADS = 14, 6, 7, 3
N_CLASSES = 1 + N_KINDS * N_LENGTHS * N_WORDS * N_SPREADS * 2
_LENGTHS = (3, 7, 11, 15, 23)


def _kind(token: bytes) -> int:
    """Shape: letters by case, digits, mixtures, marks."""
    if len(token) == 1 and not token.isalnum():
        return {b"=": 8, b":": 9, b'"': 10, b"'": 10}.get(token, 11)
    if not token.isascii():
        return 12
    if token.isalpha():
        return 0 if token.islower() else 1 if token.istitle() else 2 if token.isupper() else 3
    if token.isdigit():
        return 4
    if not token.translate(None, b"0123456789abcdef"):
        return 5
    if token.isalnum():
        return 6 if token.islower() else 7 if token.isupper() else 13
    return 13 if any(48 <= c <= 57 for c in token) else 3


def token_class(token: bytes, after_space: bool) -> int:
    kind = _kind(token)
    size = len(token)
    length = sum(size > bound for bound in _LENGTHS)
    word = spread = 0
    if kind not in (4, 8, 9, 10, 11, 12):
        lower = token.lower()
        word = next((n for w, n in _KEYWORDS if w in lower), 0)
    if size > 7 and kind >= 3:
        spread = 1 if len(set(token)) * 2 < size else 2
    at = ((kind * N_LENGTHS + length) * N_WORDS + word) * N_SPREADS + spread
    return 1 + at * 2 + after_space


def class_features() -> np.ndarray:
    """What each class is made of: class x (kind, length, word, spread, space, kind and length)."""
    parts = (N_KINDS, N_LENGTHS, N_WORDS, N_SPREADS, 2, N_KINDS * N_LENGTHS)
    starts = np.cumsum([0, *parts])
    table = np.zeros((N_CLASSES, int(starts[-1]) + 1))
    table[0, -1] = 1  # outside the text
    for c in range(1, N_CLASSES):
        rest, space = divmod(c - 1, 2)
        rest, spread = divmod(rest, N_SPREADS)
        rest, word = divmod(rest, N_WORDS)
        kind, length = divmod(rest, N_LENGTHS)
        for start, value in zip(starts, (kind, length, word, spread, space, rest), strict=False):
            table[c, start + value] = 1
    return table


FILE_CLASSES = 9


def file_class(data: bytes) -> int:
    """Share of digits and of assignment marks, in three steps each."""
    n = max(1, len(data))
    digits = n - len(data.translate(None, b"0123456789"))
    marks = data.count(b"=") + data.count(b":")
    return 3 * sum(digits * 100 > x * n for x in (1, 10)) + sum(marks * 1000 > x * n for x in (1, 10))


class Classes:
    """Class arrays of texts; the classes of a run without white space are remembered."""

    def __init__(self):
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def run(word: bytes) -> bytes:
        tokens = TOKEN.findall(word)
        found = [token_class(t, not i) for i, t in enumerate(tokens)]
        return np.array(found, dtype="<u2").tobytes()

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        words = [t.split() for t in texts]
        wanted = set().union(*words).difference(self.known)
        if len(self.known) + len(wanted) > REMEMBERED:
            self.known, wanted = {}, set().union(*words)
        for word in wanted:
            self.known[word] = self.run(word)
        look = self.known.__getitem__
        made = [np.frombuffer(b"".join(map(look, w)), dtype="<u2") for w in words]
        for word in [w for w in wanted if len(w) > LONGEST_REMEMBERED]:
            del self.known[word]
        return made


def token_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each token in code points, in the order of the class array."""
    spans = []
    at = 0
    for word in re.finditer(r"[^\x20\x09-\x0D]+", text):
        at = word.start()
        for token in TOKEN.findall(word[0].encode()):
            size = len(token.decode())
            spans.append((at, at + size))
            at += size
    return spans


def _labels(spans: list[tuple[int, int]], base: list[tuple[str, int, int, int]]) -> np.ndarray:
    labels = np.zeros(len(spans), dtype=np.int64)
    starts = np.array([a for a, _ in spans])
    ends = np.array([b for _, b in spans])
    for _, _, end, value in base:
        inside = np.flatnonzero((starts < end) & (ends > value))
        fresh = inside[labels[inside] == crf.OUTSIDE]
        labels[fresh] = crf.INSIDE
        if len(inside) and len(fresh) == len(inside):
            labels[inside[0]] = crf.BEGIN
    return labels


# Shapes that a masked secret may take: letters and digits in lower case, in upper case, in both.
_DISGUISES = (6, 7, 13)


def _masked(classes: np.ndarray, labels: np.ndarray, kind: int) -> np.ndarray:
    """A window without its keywords, its secret in another shape; the marks around it stay.

    The patterns would not find this secret, so the field has to learn it from the marks and from
    length and spread of its characters.
    """
    rest, space = np.divmod(classes - 1, 2)
    rest, spread = np.divmod(rest, N_SPREADS)
    rest, _ = np.divmod(rest, N_WORDS)
    kinds, length = np.divmod(rest, N_LENGTHS)
    value = (labels != crf.OUTSIDE) & (length >= 2)
    kinds = np.where(value, kind, kinds)
    made = 1 + (((kinds * N_LENGTHS + length) * N_WORDS * N_SPREADS) + spread) * 2 + space
    return np.where(classes > 0, made, 0)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: training windows of the texts, around pattern spans and in the middle."""
    classes = known_classes()
    for batch in (x for whole in batches for x in pieces(whole, 0)):
        texts = batch.column(0).to_pylist()
        data = [t.encode() for t in texts]
        rows: dict[str, list] = {"order": [], "file": [], "classes": [], "labels": []}
        for text, raw, array in zip(texts, data, classes.texts(data), strict=True):
            base = base_matches(text, raw)
            labels = np.zeros(len(array), dtype=np.int64)
            if base:
                labels = _labels(token_spans(text), base)
            at = np.flatnonzero(labels == crf.BEGIN)[:WINDOWS_PER_DOC].tolist()
            for i, middle in enumerate([*at, len(array) // 2]):
                start = max(0, middle - WINDOW // 2)
                piece = array[start : start + WINDOW].astype(np.int64)
                marks = labels[start : start + WINDOW]
                gap = WINDOW - len(piece)
                rank = int.from_bytes(hashlib.blake2b(raw, digest_size=6).digest()) * 32 + 4 * i
                versions = [piece]
                if marks.any():
                    versions += [_masked(piece, marks, kind) for kind in _DISGUISES]
                for j, version in enumerate(versions):
                    # Windows with a secret come first when the sample is cut to its bound.
                    rows["order"].append(rank + j if marks.any() else rank + _PLAIN)
                    rows["file"].append(file_class(raw))
                    rows["classes"].append(np.pad(version, (0, gap)).astype("<u2").tobytes())
                    rows["labels"].append(np.pad(marks, (0, gap)).astype("u1").tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows["order"], pa.int64()),
                pa.array(rows["file"], pa.int32()),
                pa.array(rows["classes"], pa.binary()),
                pa.array(rows["labels"], pa.binary()),
            ],
            names=[*rows],
        )


def train(docs: DataFrame, text: str) -> crf.Model:
    """The field for this corpus. Without any pattern span in the sample it tags nothing."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Bounded by the sample: at most 4 x (WINDOWS_PER_DOC + 1) windows of 3 x WINDOW bytes a document.
    schema = "order long, file int, classes binary, labels binary"
    found = scattered(texts, SAMPLE_DOCS).mapInArrow(_windows, schema).collect()
    # Half of the bound is kept for windows without a secret.
    with_, without = ([r for r in found if (r["order"] < _PLAIN) == x] for x in (True, False))
    halves = (sorted(h)[: WINDOWS // 2] for h in (with_, without if with_ else []))
    rows = [r for half in halves for r in half]
    read = lambda name, kind: np.frombuffer(b"".join(bytes(r[name]) for r in rows), kind)
    return crf.train(
        read("classes", "<u2").astype(np.int64).reshape(-1, WINDOW),
        read("labels", "u1").astype(np.int64).reshape(-1, WINDOW),
        np.array([r["file"] for r in rows], dtype=np.int64),
        class_features(),
        FILE_CLASSES,
    )


@cache
def known_classes() -> Classes:
    """One for each worker process, kept from task to task."""
    return Classes()


class Tagger:
    """Spans of a batch of texts."""

    def __init__(self, model: crf.Model):
        self.model, self.slack = model, model.slack() + 1e-9
        self.classes = known_classes()

    def tagged(self, arrays: list[np.ndarray], files: list[int]) -> list[np.ndarray]:
        """Labels of every token of every text, decoded together; class 0 parts the texts."""
        lengths = [len(a) for a in arrays]
        apart = np.zeros(1, dtype=np.int64)
        joined = np.concatenate([x for a in arrays for x in (a.astype(np.int64), apart)])
        wide = np.repeat(np.array(files), [n + 1 for n in lengths])
        scores = self.model.scores(joined, wide)
        lead = scores[:, crf.OUTSIDE] - np.maximum(scores[:, crf.BEGIN], scores[:, crf.INSIDE])
        open_ = np.flatnonzero((lead <= self.slack) & (joined != 0))
        labels = np.zeros(len(joined), dtype=np.int64)
        if len(open_):
            for stretch in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                labels[stretch] = crf.viterbi(scores[stretch], self.model.step)
        ends = np.cumsum([n + 1 for n in lengths])
        return [labels[e - n - 1 : e - 1] for e, n in zip(ends.tolist(), lengths, strict=True)]

    def extra(self, text: str, labels: np.ndarray, base: list) -> list[Span]:
        """Tagged spans that no pattern span touches."""
        if not labels.any():
            return []
        spans = token_spans(text)
        found: list[list[int]] = []
        for i in np.flatnonzero(labels).tolist():
            start, end = spans[i]
            follows = found and labels[i] == crf.INSIDE and labels[i - 1] and found[-1][1] == start
            if follows:
                found[-1][1] = end
            else:
                found.append([start, end])
        taken = [(a, b) for _, a, b, _ in base]
        return [("model", a, b) for a, b in found if not any(a < y and x < b for x, y in taken)]

    def texts(self, data: list[bytes]) -> list[tuple[list[Span], list[Span]]]:
        """(pattern spans, added spans) of each text."""
        arrays = self.classes.texts(data)
        labels = self.tagged(arrays, [file_class(d) for d in data]) if data else []
        made = []
        for raw, tags in zip(data, labels, strict=True):
            text = raw.decode()
            base = base_matches(text, raw)
            made.append(([s[:3] for s in base], self.extra(text, tags, base)))
        return made


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: counts per pattern, digest of their spans, and all spans.

    A null text counts as empty: no span, the digest of an empty string. Repeated rows stay; an
    empty table gives an empty result; other columns are not looked at. Spans of the field have
    the kind `model` and never touch a pattern span.
    """
    model = train(docs, text)

    def kernel(texts: list[bytes], tagger: Tagger) -> dict:
        rows = tagger.texts(texts)
        order = lambda s: (s[1], (*KINDS, "model").index(s[0]))
        digest = [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in rows]
        counts = {
            f"n_{k}": pa.array([sum(s[0] == k for s in b) for b, _ in rows], pa.int64())
            for k in KINDS
        }
        spans = [_joined(sorted([*b, *m], key=order)) for b, m in rows]
        return {
            **counts,
            "base_sha256": pa.array(digest, pa.string()),
            "spans": pa.array(spans, pa.string()),
            "n_model": pa.array([len(m) for _, m in rows], pa.int64()),
        }

    schema = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_model long"
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    found = per_text(plain, ["_id"], "_text", schema, kernel, lambda: Tagger(model))
    return found.withColumnRenamed("_id", doc_id)
