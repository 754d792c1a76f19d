import hashlib
import random
import re

import numpy as np

from standcarbon.llm import crf
from standcarbon.llm import secrets as S

from .corpus import awkward_rows, prose, table

_WORD = "|".join(
    "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    for w in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = re.compile(f"({_WORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def plain_spans(text: str | None) -> str:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def texts_with_secrets(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        hexa = "".join(rng.choices("0123456789abcdef", k=rng.choice([15, 16, 40])))
        value = "".join(rng.choices("ABCabc019+/_.=-", k=rng.choice([11, 12, 30])))
        key = rng.choice(["PassWord", "passwd", "SECRET", "token", "api_key", "APIKEY", "ſecret", "toKen"])
        middle = rng.choice(
            [f'{key} = "{value}"', f"{key}:{value}", hexa, "AKIA" + "A1B2" * rng.choice([3, 4]),
             f"é {key}'  =  '{hexa}'", "ssh-rsa " + value]
        )
        made.append(f"{prose(rng, 8)} né {middle} {prose(rng, 5)}")
    return made


def test_patterns_by_hand():
    for text in texts_with_secrets(400, 1):
        base = S.base_matches(text, text.encode())
        assert ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base) == plain_spans(text)


def test_cut_decoding_equals_whole_decoding():
    """Decoding only the open stretches gives the best path of the whole sequence."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        model = crf.Model(
            rng.normal(size=(6, 3)) + [2, 0, 0], rng.normal(size=(6, 3)), rng.normal(size=(6, 3)),
            rng.normal(size=(2, 3)), rng.normal(size=(3, 3)),
        )
        classes = rng.integers(1, 6, n)
        tagger = S.Tagger(model)
        cut = tagger.tagged([classes], [1])[0].tolist()
        # Class 0 parts the texts and is outside.
        inner = np.concatenate([classes, [0]])
        scores = model.scores(inner, np.ones(n + 1, dtype=int))[:n]
        assert cut == crf.viterbi(scores, model.step)


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(50):
        scores, step = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))

        def value(path, scores=scores, step=step):
            whole = (0, *path, 0)
            return sum(scores[i, y] for i, y in enumerate(path)) + sum(
                step[a, b] for a, b in zip(whole, whole[1:], strict=False)
            )

        assert tuple(crf.viterbi(scores, step)) == max(product(range(3), repeat=5), key=value)


def test_field_adds_what_the_patterns_miss(spark):
    rng = random.Random(8)
    texts = texts_with_secrets(400, 2) + [prose(rng, 60) for _ in range(400)]
    missed = "Zq8Tr4Lm2Xw9Kp3Vb7Nc5Hd1Jf6G"
    texts += [f"{prose(rng, 6)} pwd = '{missed}' {prose(rng, 6)}"]
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in S.scan(docs).collect()}
    for i, text in enumerate(texts):
        plain = plain_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert set(filter(None, plain.split(","))) <= set(got[i].spans.split(","))
    clean = [got[i] for i in range(400, 800)]
    assert sum(r.n_model for r in clean) == 0
    text = texts[-1]
    found = [tuple(map(int, s.split(":")[1:])) for s in got[800].spans.split(",") if s]
    assert any(text[a:b] == missed for a, b in found)


def test_masked_secrets_are_found(spark):
    """Held-out secrets that no pattern can find: other names, values of all shapes."""
    rng = random.Random(11)
    texts = texts_with_secrets(600, 4)
    shapes = {"upper": "ABCDEFGHJK0123456789", "mixed": "aBcDeFgHjK0123456789", "lower": "ghjkmnpqrs0123456789"}
    held = []
    for shape, letters in shapes.items():
        for _ in range(60):
            value = "".join(rng.choices(letters, k=rng.choice([24, 30, 36])))
            text = f'{prose(rng, 8)} {rng.choice(["cred", "login", "signing"])} = "{value}" {prose(rng, 5)}'
            assert plain_spans(text) == ""
            held.append((shape, value, text))
    clean = [prose(rng, 60) for _ in range(200)]
    model = S.train(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts + clean[:100])]), "text")
    tagger = S.Tagger(model)
    found = dict.fromkeys(shapes, 0)
    for (shape, value, text), (_, added) in zip(held, tagger.texts([t.encode() for *_, t in held]), strict=True):
        found[shape] += any(text[a:b] == value for _, a, b in added)
    assert min(found.values()) >= 0.9 * 60, found
    assert not any(added for _, added in tagger.texts([t.encode() for t in clean[100:]]))


def test_awkward_tables(spark):
    rows = awkward_rows()
    got = S.scan(table(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in got if r.doc_id in (0, 1, 2)} == {empty}
    assert all(r.spans == "" for r in got if r.doc_id in (0, 1, 2))
    assert S.scan(table(spark, [])).count() == 0
