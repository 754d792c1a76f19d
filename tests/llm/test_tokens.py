import random
import zlib
from collections import Counter

import numpy as np
import pytest

from standcarbon.llm import token_counts as C
from standcarbon.llm import token_files as T

from .corpus import awkward_rows, prose, table

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
BYTES, WORDS = (public.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = [
    *"abcXYZ09 '’\n\té́ÀßſK  　\u0085\x1c\x00<|>İΣς日本語🙂.,-_", "<|endoftext|>",
    "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", "the", " word", "  ", "\n\n", " \n", ", ",
]


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(n)]


def test_merge_count_against_rescanning():
    """Lowest rank first, leftmost on ties, by looking at all pairs again after each merge."""
    rng = random.Random(1)
    for _ in range(400):
        pairs = [("".join(rng.choices("ab", k=rng.randint(1, 3))), "".join(rng.choices("ab", k=rng.randint(1, 3)))) for _ in range(12)]
        ranks = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
        symbols = rng.choices("ab", k=rng.randint(0, 14))
        left, merges = list(symbols), 0
        while True:
            able = [(ranks[p], i) for i, p in enumerate(zip(left, left[1:], strict=False)) if p in ranks]
            if not able:
                break
            _, i = min(able)
            left[i : i + 2] = [left[i] + left[i + 1]]
            merges += 1
        assert C.merge_count(symbols, ranks) == merges


def test_counts_equal_the_library():
    library = tokenizers.Tokenizer.from_file(WORDS)
    counter = C.WordCounter(WORDS)
    for text in odd_texts(3000, 2) + ["a" * 5000, "né " * 400]:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.text(text.encode()) == want, text


def test_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 50)
    library = tokenizers.Tokenizer.from_file(BYTES)
    encoder = T.ByteEncoder(BYTES)
    texts = odd_texts(3000, 3) + ["a" * 5000, "a b " * 400, "one\ntwo three\nfour"]
    for low in range(0, len(texts), 100):
        part = texts[low : low + 100]
        for text, raw in zip(part, encoder.texts([t.encode() for t in part]), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u2").tolist() == want, text


def test_units_of_a_batch_are_looked_up_once(monkeypatch):
    encoder, seen = T.ByteEncoder(BYTES), []
    ids_of = encoder.ids_of
    monkeypatch.setattr(encoder, "ids_of", lambda units: seen.append(units) or ids_of(units))
    texts = ["one two\nthree one " * 200 + "end", "two one\nthree", "", "one"]
    for text, raw in zip(texts, encoder.texts([t.encode() for t in texts]), strict=True):
        want = encoder.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, encoder.kind).tolist() == want
    assert [sorted(s) for s in seen] == [[b"\none", b"\nthree", b"\ntwo", b" end", b" one", b" two"]]


def test_counted_table(spark):
    rows = awkward_rows()
    got = C.token_counts(table(spark, rows, clashing=True), WORDS, limit=100).collect()
    library = tokenizers.Tokenizer.from_file(WORDS)
    want = Counter()
    for i, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 100] += 1
    assert Counter(map(tuple, got)) == want
    assert C.token_counts(table(spark, []), WORDS).count() == 0


def test_files_round_trip(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 80)), "en", "s", 1) for i in rng.sample(range(-50, 900), 600)]
    path = str(tmp_path / "ids")
    dictionary = T.write_token_files(table(spark, rows), path, BYTES, 2)
    assert dictionary.data
    got = sorted(T.read_token_files(spark, path).collect(), key=lambda r: r.doc_id)
    library, start = tokenizers.Tokenizer.from_file(BYTES), 0
    for row, (i, text, *_) in zip(got, sorted(rows), strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(row) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    i, text, *_ = rows[17]
    assert T.read_document(spark, path, i) == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert T.read_document(spark, path, 10_000) is None
    assert {r.dictionary for r in spark.read.parquet(f"{path}/blocks").collect()} == {dictionary.hash}


def test_awkward_files(spark):
    rows = awkward_rows()
    got = T.token_file_digest(table(spark, rows, clashing=True), BYTES).collect()
    library = tokenizers.Tokenizer.from_file(BYTES)
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert min(r.start for r in got if r.doc_id is not None) > max(r.start for r in got if r.doc_id is None)
    assert T.token_file_digest(table(spark, []), BYTES).count() == 0
