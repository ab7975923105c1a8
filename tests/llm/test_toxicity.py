"""Toxicity: the string kernel against enumeration, sentences against plain splitting, held-out accuracy."""

import itertools
import random

import numpy as np
import pytest

from simlens.llm import toxicity as tox

WORDS = ["idiot", "i d i o t", "id-iot", "iddiot", "Clown", "clówn", "clean", "aaaaaaa", "ab", "", "ß日本語x", "x1y2z3w", "abcabcabc"]


def letters(word):
    return [int(n) for n in tox.numbers_of([word.encode()])[0]]


def features(word):
    out, own, size = {}, letters(word), 0.0
    for i, j, k in itertools.combinations(range(len(own)), 3):
        if k - i < tox.SPAN:
            weight = tox.DECAY ** (k - i - 2)
            out[own[i], own[j], own[k]] = out.get((own[i], own[j], own[k]), 0.0) + weight
            size += weight * weight
    return out, size ** 0.5


def kernel(a, b):
    (x, p), (y, q) = features(a), features(b)
    return (sum(v * y.get(u, 0.0) for u, v in x.items()) / (p * q)) ** tox.POWER if p and q else 0.0


def test_kernel_equals_enumeration():
    marks = ["idiot", "clown", "aaaa", "abc"]
    got = tox.Landmarks([m.encode() for m in marks]).kernel([w.encode() for w in WORDS])
    for i, w in enumerate(WORDS):
        for j, m in enumerate(marks):
            assert abs(got[i, j] - kernel(w, m)) < 1e-9, (w, m)
    values = np.arange(tox.CODES) % 7 - 3.0
    want = [sum(v * values[(u[0] << 10) | (u[1] << 5) | u[2]] for u, v in features(w)[0].items()) / (features(w)[1] or 1) for w in WORDS]
    assert np.allclose(tox.summed_over([w.encode() for w in WORDS], values), want)


def test_gaps_and_inserted_characters():
    marks = tox.Landmarks([b"idiot"])
    same, spaced, marked, doubled, inserted, other = marks.kernel([b"Idiot", b"i d i o t", b"i*d.i-o_t", b"iddiiott", b"idixot", b"inside"])[:, 0]
    assert same == spaced == marked and doubled > 0.3 and inserted > 0.2 and other < 0.1


def plain(text):
    """Sentences of a text as sets of words, by the rules of the docstring."""
    out, now = [], []
    words = [(w, at) for w, at in _spans(text)]
    for i, (w, at) in enumerate(words):
        now.append((w, at))
        after = text[at + len(w):at + len(w) + 1]
        if w[-1] in ".!?" or after in ("\n", "") or len(now) == tox.SENTENCE:
            out.append(now)
            now = []
    out += [now] if now else []
    sets = []
    for s in out:
        own, i = set(), 0
        while i < len(s):
            k = i
            while k + 1 < len(s) and len(s[k][0]) == len(s[k + 1][0]) == 1 and s[k + 1][1] == s[k][1] + 2:
                k += 1
            if k - i >= 2:
                joined = text[s[i][1]:s[k][1] + 1]
                own |= {joined[a:a + tox.PIECE] for a in range(0, max(len(joined) - tox.OVERLAP, 1), tox.PIECE - tox.OVERLAP)}
                i = k + 1
                continue
            w = s[i][0]
            own |= {w.lower()} if len(w) <= tox.PIECE else {w[a:a + tox.PIECE] for a in range(0, max(len(w) - tox.OVERLAP, 1), tox.PIECE - tox.OVERLAP)}
            i += 1
        sets.append(own)
    return sets


def _spans(text):
    at = 0
    for part in text.replace("\n", " ").split(" "):
        if part:
            yield part, at
        at += len(part) + 1


def test_sentences_and_words():
    draw = random.Random(6)
    for _ in range(300):
        text = "".join(draw.choice(["a", "b ", " ", "\n", ". ", "word", "x y z ", "! ", "q" * 40, "Te"]) for _ in range(draw.randrange(120)))
        words, number, sentence, of_text = tox.Reader().read([text, "", text])
        want = plain(text)
        got = [set() for _ in of_text]
        for n, s in zip(number, sentence):
            got[s].add(words[n].decode().lower())
        assert of_text.tolist() == [0] * len(want) + [2] * len(want)
        assert got == [{w.lower() for w in s} for s in want] * 2, text


def test_long_words_keep_all_subsequences():
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    pieces = tox.Reader().read([word])[0]
    whole = {c for codes, _, _ in tox.subsequences([word.encode()]) for c in codes.tolist()}
    assert {c for codes, _, _ in tox.subsequences(pieces) for c in codes.tolist()} == whole and max(map(len, pieces)) <= tox.PIECE


@pytest.fixture
def rows(prose):
    draw = random.Random(9)
    out = []
    for i in range(500):
        text, toxic = prose(40, i).replace(" ", ". ", draw.randrange(4)), int(i % 3 == 0)
        if toxic:
            text += " " + draw.choice(["you blorfin now", "such a grumzik.", "qwaxel" + draw.choice("abc") + " go"])
        out.append((i, text, toxic))
    return out


def test_held_out_accuracy_and_hidden_insults(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "'x' as y", "1 as draw", "'z' as words")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    known = "doc_id % 4 <> 2"
    model = tox.train(docs.where(known), labels.where(known), "toxic")
    got = {r["doc_id"]: r["score"] for r in tox.score(docs, model).collect()}
    unseen = [(got[i] >= 0.3, y) for i, _, y in rows if i % 4 == 2]
    assert np.mean([bool(a) == bool(b) for a, b in unseen]) > 0.97
    long = "alpha beta gamma. " * 60_000
    odd = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + "such a gr-um-zik"), (6, "g r u m z i k"), (6, "g r u m z i k"), (None, "you bl.orf.in"), (7, "!" * 100_000), (8, "z" * 1_000_000)]
    again = tox.score(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as score"), model).collect()
    found = {}
    for r in again:
        found.setdefault(r["doc_id"], []).append(r["score"])
    assert len(again) == len(odd) and found[1] == found[2] == found[3] and all(0 <= s <= 1 for s in sum(found.values(), []))
    assert found[1][0] < 0.3 and found[4][0] < 0.3 and found[7][0] < 0.3 and found[8][0] < 0.3
    assert found[5][0] >= 0.3 and found[6][0] == found[6][1] >= 0.3 and found[None][0] >= 0.3


def test_one_class_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for own, want in (([(1, 1)], 1.0), ([(1, 0)], 0.0), ([], 0.5)):
        model = tox.train(docs, spark.createDataFrame(own, "doc_id long, toxic int"), "toxic")
        assert [r["score"] for r in tox.score(docs, model).collect()] == [want, want]
    both = tox.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), "toxic")
    assert tox.score(docs, both).count() == 2 and tox.score(docs.limit(0), both).count() == 0
