"""Operators on documents against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from simlens.llm import decontaminate, jaccard, language, pii, quality, tokenfile
from simlens.llm.common import Words, held_out_id, words_of, SPACES


# --- personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _plain_base(text):
    def luhn(d):
        d = [int(c) for c in d][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
    out = []
    for k, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if name == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if name == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_entities_equal_the_patterns():
    draw = random.Random(5)
    parts = ["a@b.c", "@", "a@b", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "+1 (23) 456-78", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "12", " ", "-", "é", "x", "(", "9", "a.b%c@d-e.f.g@h.i", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 14)))
        assert pii.base_entities(text) == _plain_base(text), text
    assert pii.base_entities("9" * 50_000 + "a" * 50_000) == []


def test_bootstrapping_finds_unseen_identifiers(spark, make_docs, edge):
    seeds = [f"please call office line +1 555 010 {i:04d} today" for i in range(6)]
    texts = [*edge, *seeds, "please call office line 555 010 9999 today", "some total of 555 010 8888 items"]
    docs = make_docs(texts, extra=True)
    rows = {r["doc_id"]: r for r in pii.digests(docs).collect()}
    assert len(rows) == len(texts)
    found = len(texts) - 2
    start = texts[found].index("555")
    assert rows[found]["spans"] == f"phone:{start}:{start + 12}" and rows[found]["n_phone"] == 0
    assert rows[found + 1]["spans"] == ""
    for i, text in enumerate(texts):
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in _plain_base(text or ""))
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[found] == "please call office line [PHONE] today" and masked[0] is None
    assert pii.digests(make_docs([])).count() == 0


# --- token files

def test_token_files(spark, make_docs, prose, edge, paths, tmp_path):
    from tokenizers import Tokenizer

    path = paths("word_bpe_49k.json")
    texts = [*edge, prose(400, 1), "It's 3D, isn't it?! ÉTÉ İstanbul ΟΔΟΣ Å <|ENDOFTEXT|>.", "ﬁ… a,b. c.. d,"]
    ids = list(range(-3, len(texts) - 3))
    ids[2] = None
    rows = {r["doc_id"]: r for r in tokenfile.token_table(make_docs(texts, ids=ids, extra=True), str(tmp_path / "t"), path).collect()}
    plain = Tokenizer.from_file(path)
    at = 0
    for ident, text in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        own = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert (rows[ident]["start"], rows[ident]["n_tokens"]) == (at, len(own)), text
        assert rows[ident]["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        at += len(own)
    assert tokenfile.token_table(make_docs([]), str(tmp_path / "e"), path).count() == 0


def test_many_shards_and_repeated_ids(spark, make_docs, prose, paths, tmp_path):
    docs = make_docs([prose(40, i % 5) for i in range(60)], ids=[7] * 30 + list(range(30)))
    folder = str(tmp_path / "t")
    manifest = tokenfile.write_token_files(docs, folder, paths("word_bpe_49k.json"), 1, shard_ids=200)
    assert manifest.count() > 8
    rows = sorted(tokenfile.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted([7] * 30 + list(range(30)))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:])) and rows[0]["start"] == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(2000)), sorted(random.Random(1).randrange(1 << 40) for _ in range(3000))])
def test_elias_fano(values):
    made = tokenfile.EliasFano.of(np.array(values, dtype=np.int64))
    back, at = tokenfile.EliasFano.load(memoryview(made.dump()), 0)
    assert at == len(made.dump()) and back.values().tolist() == values
    assert [back[i] for i in range(0, len(values), 7)] == values[::7]
    if len(values) > 1000:
        assert back.values(300, 900).tolist() == values[300:900]
        assert len(made.dump()) < len(values) * 8


# --- decontamination

def _plain_hits(texts, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for ident, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(ident)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i:i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in own if x is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination(spark, make_docs, prose, edge):
    passage = prose(30, 3)
    items = [(1, passage), (20, prose(12, 4)), (3, "Short one"), (4, None), (5, ""), (None, prose(11, 6)), (6, passage), (7, "a b c d e f"), (3, prose(10, 9))]
    texts = [*edge, prose(50, 8) + " " + passage[20:160].upper() + "!" + prose(20, 7), "the short-one here", "x " + prose(11, 6), prose(11, 6)[:40],
             " ".join(["a b c d e f"] * 40), prose(12, 4) + " " + prose(12, 4), passage + prose(10, 9), "same text"]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as span", "'q' as window")
    docs = make_docs(texts, extra=True)
    rows = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, ["doc_id"]).collect()}
    for i, (n, hit, found) in enumerate(_plain_hits(texts, items)):
        assert (rows[i]["n_words"], rows[i]["n_hit"], rows[i]["items"], rows[i]["contaminated"]) == (n, hit, found, hit > 0), texts[i]
        assert sum(s["end"] - s["at"] for s in rows[i]["spans"]) == hit
    empty = decontaminate.decontaminate(docs, bench.limit(0), ["doc_id"])
    assert empty.where("contaminated").count() == 0 and empty.count() == len(texts)
    assert decontaminate.decontaminate(make_docs([]), bench, ["doc_id"]).count() == 0


# --- Jaccard join

def _plain_components(texts, ids):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    low = defaultdict(list)
    for i in range(len(texts)):
        low[root(i)].append(ids[i])
    return [(len(sets[i]), min((x for x in low[root(i)] if x is not None), default=None)) for i in range(len(texts))]


def test_jaccard_components(spark, make_docs, prose, edge):
    draw = random.Random(2)
    texts = [*edge]
    shared = prose(60, 99)
    for group in range(6):
        base = prose(draw.choice([30, 120, 300]), group).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2, 3, 5, 8])):
                copy[draw.randrange(len(copy))] = "changed" + str(draw.randrange(9))
            texts.append(" ".join(copy if draw.random() < 0.8 else copy + prose(draw.randrange(1, 40), draw.random()).split()))
    texts += [shared + " " + prose(draw.randrange(5, 80), 1000 + i) for i in range(60)]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    ids[3] = None
    docs = make_docs(texts, ids=ids, extra=True)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    want = dict(zip(ids, _plain_components(texts, ids)))
    assert rows == want
    kept = jaccard.first_of_components(make_docs(texts, ids=ids)).collect()
    want_ids = sorted({c for i, (n, c) in want.items() if n and c is not None} | {i for i, (n, _) in want.items() if not n and i is not None})
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == want_ids
    assert jaccard.jaccard_components(make_docs([])).count() == 0


def test_jaccard_threshold_is_exact(spark, make_docs):
    # sets of 9 and 9 shingles with 8 in common: 8 / 10, exactly at the threshold; 7 of 9 below it
    words = [f"w{i}" for i in range(13)]
    a, b = " ".join(words), " ".join([*words[:12], "other"])
    c = " ".join(["o1", "o2", *[f"v{i}" for i in range(11)]])
    d = " ".join([*c.split()[:11], "p1", "p2"])
    rows = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(make_docs([a, b, c, d])).collect()}
    assert rows == {0: 0, 1: 0, 2: 2, 3: 3}


def test_word_hashes_follow_words():
    texts = ["One two  one", "", "two x two", "\x0bone\x0c"]
    starts, ends, hashes, data, first = Words(words_of(SPACES)).split(texts)
    words = [data[a:b].decode().lower() for a, b in zip(starts, ends)]
    assert words == ["one", "two", "one", "two x", "two", "one"] and first.tolist() == [0, 3, 3, 5, 6]
    assert all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(6) for j in range(6))


# --- language and quality

def test_language_profiles(spark, make_docs, edge):
    draw = random.Random(3)
    sounds = {"aa": "ba ra ta ma la".split(), "bb": "ko to ro éo nö".split()}
    texts, langs = [], []
    for i in range(160):
        lang = "aa" if i % 2 else "bb"
        texts.append(" ".join("".join(draw.choice(sounds[lang]) for _ in range(3)) for _ in range(30)))
        langs.append(lang if i % 7 else None)
    docs = make_docs([*texts, *edge], [*langs, *[None] * len(edge)], extra=True)
    profiles = language.train_profiles(docs, docs["doc_id"].isNotNull())
    assert set(profiles) == {"aa", "bb"}
    rows = {r["doc_id"]: r for r in language.identify(docs, profiles, ["doc_id"]).collect()}
    assert all(rows[i]["lang_pred"] == ("aa" if i % 2 else "bb") for i in range(160))
    for i, text in enumerate(edge):
        known = any(c.isalpha() for c in text or "")
        assert (rows[160 + i]["lang_pred"] == "und") == (not known) and 0 <= rows[160 + i]["score"] <= 1
    assert {r["lang_pred"] for r in language.identify(docs, {}, ["doc_id"]).collect()} == {"und"}
    assert language.identify(make_docs([]), profiles, ["doc_id"]).count() == 0


def test_bundled_vectors_are_sums_of_bound_letters():
    space = language.LetterSpace(64)
    got = space.vectors(["Ab a!!b", "", "12"])
    vector = {s: np.random.default_rng(7_919 + (ord(s) if s != " " else 0)).integers(0, 2, 64, dtype=np.int8) * 2 - 1 for s in "ab "}
    text, want = " ab a b ", np.zeros(64)
    for i in range(len(text) - 2):
        want += vector[text[i]] * np.roll(vector[text[i + 1]], 1) * np.roll(vector[text[i + 2]], 2)
    assert (got[0] == want).all() or (got[0] == sum(np.roll(vector[text[i]], 0) * np.roll(vector[text[i + 1]], 1) * np.roll(vector[text[i + 2]], 2) for i in range(len(text) - 2))).all()
    assert not got[1:].any()


def test_quality(spark, make_docs, prose, edge):
    texts = [prose(40, i) if i % 3 else " ".join(w + "!!" for w in prose(40, i).split()) for i in range(240)]
    docs = make_docs([*texts, *edge], extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(1, 1), (0, None), (None, 1), (999, 0)], "doc_id long, quality int")
    model = quality.train(docs.where("doc_id % 5 > 0"), labels.where("doc_id % 5 > 0"), "quality")
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    wrong = sum((rows[i] >= 0.3) != (i % 3 > 0) for i in range(0, 240, 5))
    assert wrong == 0 and all(0 <= s <= 1 for s in rows.values()) and len(rows) == 240 + len(edge)
    again = quality.train(docs.where("doc_id % 5 > 0").repartition(2), labels.where("doc_id % 5 > 0"), "quality")
    assert np.allclose(again["weights"], model["weights"]) and again["slope"] == pytest.approx(model["slope"])
    one = quality.train(docs, labels.where("quality = 1"), "quality")
    assert one == {"share": 1.0} and quality.train(docs, labels.limit(0), "quality") == {"share": 0.5}


def test_dual_coordinate_descent_reaches_the_optimum():
    draw = np.random.default_rng(1)
    rows = [np.flatnonzero(draw.random(30) < 0.3) for _ in range(60)]
    labels = np.array([int(5 in r) for r in rows])
    ratio = np.ones(30)
    weights = quality.dual_coordinate_descent(rows, labels, ratio, rounds=400)
    sign = np.where(labels == 1, 1, -1)
    margins = np.array([weights[r].sum() + weights[-1] for r in rows])
    primal = 0.5 * weights @ weights + np.maximum(0, 1 - sign * margins).sum()
    for _ in range(200):
        other = weights + draw.normal(0, 0.05, 31)
        value = 0.5 * other @ other + np.maximum(0, 1 - sign * np.array([other[r].sum() + other[-1] for r in rows])).sum()
        assert value >= primal - 1e-2


def test_held_out_rule():
    assert held_out_id(None) and held_out_id(3) == (zlib.crc32(b"3") % 5 == 0)


def test_large_group_of_near_copies(spark, make_docs):
    """Copies of one text with more and more changed words: links among them by all pairs of sets."""
    import random

    draw = random.Random(11)
    base = [f"w{draw.randrange(400)}" for _ in range(220)]
    texts = []
    for i in range(260):
        own = list(base)
        for _ in range(draw.randrange(1, 7)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10 ** 6)}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    lowest = list(range(len(texts)))

    def root(i):
        while lowest[i] != i:
            i = lowest[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                lowest[b] = a
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(make_docs(texts)).collect()}
    assert got == {i: root(i) for i in range(len(texts))} and 1 < len(set(got.values())) < 200


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_language_vectors_do_not_depend_on_the_piece_length(monkeypatch, piece):
    texts = ["", " ", "a", "ab c", "Ὀδυσσεύς  ΣΑΣ, σας", "x1y2 \n z", "The quick--brown fox. " * 9, "...a", "a...", "é" * 70]
    whole = language.LetterSpace().vectors(texts)
    monkeypatch.setattr(language, "PIECE", piece)
    assert (language.LetterSpace().vectors(texts) == whole).all()
    assert not whole[0].any() and not whole[1].any() and whole[2].any()
