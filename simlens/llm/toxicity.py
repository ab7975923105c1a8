"""Toxicity by a support vector machine on sentences with a gapped string kernel and Nyström landmarks.

Words are compared by the subsequences of three letters that they share, with up to three letters in
between; every letter in a gap weighs ``DECAY``, so inserted letters cost a little similarity and hide
nothing, and symbols other than letters between the letters of a word cost nothing. The kernel of two words is the product of their weighted subsequences over
the sizes of both, raised to ``POWER``; the kernel of two sentences is the sum over all pairs of their
words (a convolution kernel). A few hundred words serve as landmarks: the kernel against them, whitened
by their own kernel matrix, is the feature vector of a sentence, on which a linear hinge-loss model is
fitted by dual coordinate descent. As sums pass through, the model is one number per distinct word, and
a sentence's margin is their sum. A text is as toxic as its worst sentence.

Labels are given for texts. A text's sentence of strongest evidence stands for it: first by the odds of
its subsequences among toxic and other texts, then once more by the fitted model.

Sentences end with ``.``, ``!``, ``?``, a line or after 64 words. A word is a run without white space;
runs of three or more single characters with spaces between are one word, and words over 32 bytes are read
in overlapping pieces of 32 that miss no subsequence. A-Z and accented letters count as their base
letters, other letters fall into five classes, all other symbols are passed over.

``FIT_ROWS`` bounds the texts of each class that are learned from; they are read whole, and so are the
texts that are scored.

Defined results: a null text is empty; a text without words has the margin of an empty sentence;
labels that are null, or repeated and in disagreement, teach nothing; with one class only every score
is its share of 1 (0.5 without labels); rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.llm.common import SPACES, Words, arrow_rows, blocks, cut, likely_among, mix, words_of
from simlens.llm.quality import logistic

#: Texts of each class that are learned from, at most, and landmarks.
FIT_ROWS, LANDMARKS = 1500, 192
SPAN, DECAY, POWER = 6, 0.8, 3
SENTENCE, PIECE, OVERLAP = 64, 32, 8
CODES = 1 << 15
#: Distinct words handled at once.
CHUNK = 4096
#: Strongest sentences of a text that are learned from, rounds of choosing among them, and the kernel above which two landmarks are too alike.
CHOSEN, TURNS, ALIKE = 4, 4, 0.6
#: Weight of the odds of whole words against those of their subsequences.
KNOWN = 3.0


def _letters() -> np.ndarray:
    """Letter number of each code point below 0x250: 1 to 26, 27 to 31 for letters without a base letter, 0 for other symbols."""
    out = np.zeros(0x250, dtype=np.int32)
    for point in range(0x250):
        char = chr(point)
        base = unicodedata.normalize("NFD", char)[0].lower()
        if "a" <= base <= "z":
            out[point] = ord(base) - 96
        elif char.isalpha():
            out[point] = 27 + point % 5
    return out


LETTERS = _letters()
#: Places of the second and third letter after the first, and the weight of such a subsequence.
SHAPES = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]


def numbers_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all letters of all words, one after the other, and the words they belong to."""
    joined = b"\n".join(words) + b"\n"
    points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = points == 10
    known = points < len(LETTERS)
    numbers = np.where(known, LETTERS[np.where(known, points, 0)], 27 + (points % 5).astype(np.int32))
    owner = np.cumsum(ends) - ends
    letters = numbers > 0
    return numbers[letters], owner[letters]


def subsequences(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Codes of all subsequences of three letters, the words they are in, and their weight, shape by shape."""
    numbers, owner = numbers_of(words)
    for a, b, weight in SHAPES:
        if len(numbers) > b:
            at = np.flatnonzero(owner[:-b] == owner[b:])
            yield (numbers[at] << 10) | (numbers[at + a] << 5) | numbers[at + b], owner[at], weight


def sizes(words: list[bytes]) -> np.ndarray:
    """Size of each word in the kernel: root of the summed squared weights of its subsequences."""
    total = np.zeros(len(words))
    for _, owner, weight in subsequences(words):
        total += np.bincount(owner, minlength=len(words)) * weight * weight
    return np.sqrt(total)


def summed_over(words: list[bytes], values: np.ndarray) -> np.ndarray:
    """For each word the weighted sum of ``values`` over its subsequences, by its size; 0 for words without any."""
    total = np.zeros(len(words))
    for codes, owner, weight in subsequences(words):
        total += np.bincount(owner, values[codes], minlength=len(words)) * weight
    size = sizes(words)
    return np.divide(total, size, out=total, where=size > 0)


class Landmarks:
    """Kernel of words against fixed words."""

    def __init__(self, words: list[bytes]):
        self.words = words
        size = np.maximum(sizes(words), 1e-12)
        codes, owners, weights = [], [], []
        for code, owner, weight in subsequences(words):
            codes.append(code)
            owners.append(owner)
            weights.append(weight / size[owner])
        pairs, at = np.unique(np.concatenate([*codes, np.zeros(0, np.int32)]).astype(np.int64) * len(words) + np.concatenate([*owners, np.zeros(0, np.int64)]), return_inverse=True)
        self.weight = np.bincount(at, np.concatenate([*weights, np.zeros(0)]), minlength=len(pairs))
        self.landmark = (pairs % max(len(words), 1)).astype(np.int32)
        self.first = np.searchsorted(pairs // max(len(words), 1), np.arange(CODES + 1))
        self.count = np.diff(self.first)

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """One row per word, one column per landmark."""
        places, weights, total = [], [], np.zeros(len(words))
        for codes, owner, weight in subsequences(words):
            total += np.bincount(owner, minlength=len(words)) * (weight * weight)
            count = self.count[codes]
            hit = np.flatnonzero(count)
            codes, owner, count = codes[hit], owner[hit], count[hit]
            if len(codes):
                end = np.cumsum(count)
                at = np.arange(end[-1]) - np.repeat(end - count - self.first[codes], count)
                places.append(np.repeat(owner * len(self.words), count) + self.landmark[at])
                weights.append(self.weight[at] * weight)
        cells = len(words) * len(self.words)
        out = np.bincount(np.concatenate(places), np.concatenate(weights), minlength=cells) if places else np.zeros(cells)
        out = out.reshape(len(words), len(self.words)) / np.sqrt(np.where(total > 0, total, 1))[:, None]
        powered = out
        for _ in range(POWER - 1):
            powered = powered * out
        return powered


class Reader:
    """Words and sentences of a list of texts."""

    def __init__(self):
        self.split_words = Words(words_of(SPACES))

    def read(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words; for every word of a sentence its place among them and the sentence, by sentence; the text of each sentence."""
        starts, ends, hashes, data, first = self.split_words.split(texts)
        n = len(starts)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        raw = np.frombuffer(data, np.uint8)
        last = raw[ends - 1] if n else raw[:0]
        stop = np.isin(last, (0x21, 0x2E, 0x3F)) | (raw[ends] == 10) if n else np.zeros(0, bool)
        new = np.ones(n, dtype=bool)
        new[1:] = stop[:-1] | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        inside = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        new |= inside % SENTENCE == 0
        sentence = np.cumsum(new) - 1
        of_text = text[new]

        # single characters in a row, with one sentence and single spaces around them, are one word
        single = (ends - starts) == 1
        joined = np.zeros(n, dtype=bool)
        if n > 1:
            joined[1:] = single[1:] & single[:-1] & (sentence[1:] == sentence[:-1]) & (starts[1:] - ends[:-1] == 1)
        lead = np.flatnonzero(~joined)
        length = np.diff(np.append(lead, n))
        runs = length > 2
        alone = np.ones(n, dtype=bool)
        for a, k in zip(lead[runs].tolist(), length[runs].tolist()):
            alone[a:a + k] = False
        long = alone & (ends - starts > PIECE)
        plain = alone & ~long
        _, where, inverse = np.unique(hashes[plain], return_index=True, return_inverse=True)
        own = np.flatnonzero(plain)[where]
        words = [data[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())]
        number, of_sentence = [inverse], [sentence[plain]]
        more: list[tuple[int, int, int]] = [(int(starts[a]), int(ends[a + k - 1]), int(sentence[a])) for a, k in zip(lead[runs].tolist(), length[runs].tolist())]
        more += [(int(starts[i]), int(ends[i]), int(sentence[i])) for i in np.flatnonzero(long)]
        added = []
        for a, b, s in more:
            for at in range(a, max(b - OVERLAP, a + 1), PIECE - OVERLAP):
                added.append(s)
                words.append(data[at:min(at + PIECE, b)])
        if added:
            number.append(np.arange(len(words) - len(added), len(words)))
            of_sentence.append(np.array(added))
        pairs = np.unique(np.concatenate(of_sentence) * max(len(words), 1) + np.concatenate(number))       # a word counts once in a sentence
        return words, pairs % max(len(words), 1), pairs // max(len(words), 1), of_text


def by_chunk(words: list[bytes], value) -> np.ndarray:
    """``value`` of all words, a bounded number of them at once."""
    parts = [value(words[a:a + CHUNK]) for a in range(0, len(words), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Model:
    """One number per word; a sentence's margin is their sum and the intercept."""

    def __init__(self, landmarks: list[bytes], weights: np.ndarray, intercept: float, slope: float, offset: float):
        self.parts = (landmarks, weights, intercept, slope, offset)
        self.landmarks, self.weights, self.intercept, self.slope, self.offset = Landmarks(landmarks), weights, intercept, slope, offset

    def __reduce__(self):
        return Model, self.parts

    def words(self, words: list[bytes]) -> np.ndarray:
        return by_chunk(words, lambda some: self.landmarks.kernel(some) @ self.weights)

    def margins(self, reader: Reader, texts: list[str]) -> np.ndarray:
        """Largest margin of a sentence of each text; that of an empty sentence where there is none."""
        words, number, sentence, of_text = reader.read(texts)
        own = np.bincount(sentence, self.words(words)[number], minlength=len(of_text)) + self.intercept if len(of_text) else np.zeros(0)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, of_text, own)
        return np.where(np.isinf(out), self.intercept, out)

    def scores(self, reader: Reader, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(reader, texts) + self.offset, -500, 500)))


def hinge_fit(rows: np.ndarray, labels: np.ndarray, cost: float = 10.0, rounds: int = 60, seed: int = 1) -> np.ndarray:
    """Weights and intercept (last) of the L2-regularised hinge-loss model with classes of equal weight, by dual coordinate descent."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
    sign = np.where(labels == 1, 1.0, -1.0)
    most = cost * np.where(labels == 1, len(labels) / (2 * max(labels.sum(), 1)), len(labels) / (2 * max(len(labels) - labels.sum(), 1)))
    norms = (rows * rows).sum(axis=1)
    weights, alphas = np.zeros(rows.shape[1]), np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            after = min(max(alphas[i] - (sign[i] * (weights @ rows[i]) - 1) / norms[i], 0.0), most[i])
            if after != alphas[i]:
                moved = max(moved, abs(after - alphas[i]))
                weights += (after - alphas[i]) * sign[i] * rows[i]
                alphas[i] = after
        if moved < 1e-4 * cost:
            break
    return weights


def odds(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """Log odds of what occurs in so many toxic and other texts, drawn to 0 by two standard errors."""
    p, q = toxic + 0.5, other + 0.5
    value = np.log(p / (n_toxic + 1)) - np.log(q / (n_other + 1))
    return np.sign(value) * np.maximum(np.abs(value) - 2 * np.sqrt(1 / p + 1 / q), 0)


class Evidence:
    """Strength of words before a model exists: odds of their subsequences, and of words that many texts share."""

    def __init__(self, codes: np.ndarray, known: dict[bytes, float]):
        self.codes, self.known = codes, known

    def words(self, words: list[bytes]) -> np.ndarray:
        out = by_chunk(words, lambda some: summed_over(some, self.codes))
        if self.known:
            out += [self.known.get(w.lower(), 0.0) for w in words]
        return out

    def strongest(self, reader: Reader, texts: list[str]) -> list[list[list[bytes]]]:
        """Words of the strongest ``CHOSEN`` sentences of each text; a sentence is as strong as its strongest word."""
        words, number, sentence, of_text = reader.read(texts)
        best = np.full(len(of_text), -np.inf)
        np.maximum.at(best, sentence, self.words(words)[number])
        bounds = np.searchsorted(sentence, np.arange(len(of_text) + 1))
        first = np.searchsorted(of_text, np.arange(len(texts) + 1))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            top = a + np.argsort(-best[a:b], kind="stable")[:CHOSEN]
            out.append([[words[i] for i in number[bounds[s]:bounds[s + 1]]] for s in top.tolist()] or [[]])
        return out


def choose_landmarks(words: list[bytes], strength: np.ndarray, toxic: np.ndarray) -> list[bytes]:
    """Half from toxic texts and a quarter from others, strongest first and none too like an earlier one; the rest drawn by hash."""
    drawn = np.argsort(mix(np.arange(1, len(words) + 1, dtype=np.uint64)), kind="stable")
    order = np.argsort(-strength, kind="stable")
    has = sizes(words) > 0
    chosen: list[int] = []
    for group, most in ((order[toxic[order] & has[order]], LANDMARKS // 2), (order[~toxic[order] & has[order]], LANDMARKS * 3 // 4), (drawn[has[drawn]], LANDMARKS)):
        pool = group[:8 * LANDMARKS].tolist()
        like = Landmarks([words[i] for i in pool]).kernel([words[i] for i in pool]) if pool else np.zeros((0, 0))
        near = np.zeros(len(pool), dtype=bool)
        for at, i in enumerate(pool):
            if len(chosen) < most and not near[at]:
                chosen.append(i)
                near |= like[at] > ALIKE
    return [words[i] for i in dict.fromkeys(chosen)] or [b"aaa"]


def fit(texts: list[list[list[bytes]]], labels: np.ndarray, evidence: Evidence, share: float) -> Model:
    """A model from the strongest sentences of each text and the texts' labels."""
    words = sorted({w for own in texts for s in own for w in s})
    place = {w: i for i, w in enumerate(words)}
    sentences = [[place[w] for w in s] for own in texts for s in own]
    of_text = np.repeat(np.arange(len(texts)), [len(own) for own in texts])
    number = np.array([i for s in sentences for i in s], dtype=np.int64)
    owner = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    toxic = np.zeros(len(words), dtype=bool)
    toxic[number[labels[of_text[owner]] == 1]] = True
    marks = choose_landmarks(words, evidence.words(words), toxic)
    landmarks = Landmarks(marks)
    values, vectors = np.linalg.eigh(landmarks.kernel(marks))
    kept = values > 1e-6 * max(values.max(), 1e-12)
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    kernel = np.concatenate([landmarks.kernel(words[a:a + CHUNK]) @ whiten for a in range(0, len(words), CHUNK)] + [np.zeros((0, kept.sum()))])
    rows = np.zeros((len(sentences), kept.sum()))
    np.add.at(rows, owner, kernel[number])

    unseen = np.arange(len(texts)) % 4 == 0
    if len(set(labels[~unseen].tolist())) < 2 or len(set(labels[unseen].tolist())) < 2:
        unseen[:] = False
    is_toxic = labels[of_text] == 1
    stands = ~unseen[of_text]
    first = np.searchsorted(of_text, np.arange(len(texts)))
    use = stands & (~is_toxic | np.isin(np.arange(len(sentences)), first))
    for _ in range(TURNS):
        weights = hinge_fit(rows[use], labels[of_text][use])
        margins = rows @ weights[:-1] + weights[-1]
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, of_text, margins)
        use = stands & (~is_toxic | (margins > 0) | (margins == worst[of_text]))
    shown = unseen if unseen.any() else ~unseen
    slope, offset = logistic(worst[shown], labels[shown], share)
    return Model(marks, whiten @ weights[:-1], float(weights[-1]), slope, offset)


def train(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS):
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id and a 0/1 column), both already cut to the training rows; the share of 1 if there is one class only."""
    agreed = cut(labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
                 .agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").select("doc_id", F.col("y").cast("int").alias("y")))
    totals = {r["y"]: r["n"] for r in docs.select("doc_id").join(agreed, "doc_id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return float(next(iter(totals), 0.5))
    share = totals[1] / (totals[0] + totals[1])
    steps = 1 << 20
    limit = {y: min(steps, int(steps * 0.9 * fit_rows / n)) if n > fit_rows else steps for y, n in totals.items()}
    drawn = agreed.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(steps))).where(F.when(F.col("y") == 1, F.col("draw") < limit[1]).otherwise(F.col("draw") < limit[0]))
    sample = cut(likely_among(docs.select("doc_id", "text"), "doc_id", drawn.select("doc_id")).join(drawn, "doc_id")
                 .select(F.coalesce("text", F.lit("")).alias("text"), "y", "draw").limit(2 * fit_rows))
    spread = sample.repartition(max(1, sample.count() // 64), F.xxhash64("text", "draw"))
    counted = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        reader, codes = Reader(), np.zeros((2, CODES), dtype=np.int64)
        for columns in batches:
            seen: dict[tuple[int, bytes], int] = {}
            for text, y in zip(columns["text"].to_pylist(), columns["y"].to_pylist()):
                words = sorted({w.lower() for w in reader.read([text])[0]})
                own = np.zeros(CODES, dtype=bool)
                for a in range(0, len(words), CHUNK):
                    for found, _, _ in subsequences(words[a:a + CHUNK]):
                        own[found] = True
                codes[y] += own
                for w in words:
                    seen[y, w] = seen.get((y, w), 0) + 1
            if seen:
                yield {"y": [y for y, _ in seen], "code": [None] * len(seen), "word": [w for _, w in seen], "n": list(seen.values())}
        for y in (0, 1):
            found = np.flatnonzero(codes[y])
            yield {"y": np.full(len(found), y), "code": found, "word": [None] * len(found), "n": codes[y][found]}

    passed = cut(arrow_rows(spread.select("text", "y"), count, "y int, code int, word binary, n long").groupBy("y", "code", "word").agg(F.sum("n").alias("n")))
    table = np.zeros((2, CODES))
    for r in passed.where("code is not null").select("y", "code", "n").collect():                    # two rows a code at most
        table[r["y"], r["code"]] = r["n"]
    n_toxic, n_other = float(counted.get(1, 0)), float(counted.get(0, 0))
    both = passed.where("word is not null").groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    lower = F.expr(f"ln((p + 0.5) / {n_toxic + 1}) - ln((q + 0.5) / {n_other + 1}) - 2 * sqrt(1 / (p + 0.5) + 1 / (q + 0.5))")
    shared = both.where("p > 1").withColumn("odds", lower).where("odds > 0").orderBy(F.desc("odds"), "word").limit(LANDMARKS).collect()
    evidence = Evidence(odds(table[1], table[0], n_toxic, n_other), {bytes(r["word"]): KNOWN * r["odds"] for r in shared})

    def strongest(batches: Iterator[dict]) -> Iterator[dict]:
        reader = Reader()
        for columns in batches:
            texts = columns["text"].to_pylist()
            yield {"y": columns["y"], "draw": columns["draw"], "sentences": [s for a, b in blocks(texts) for s in evidence.strongest(reader, texts[a:b])]}

    chosen = cut(arrow_rows(spread.select("text", "y", "draw"), strongest, "y int, draw long, sentences array<array<binary>>"))

    def learn(batches: Iterator[dict]) -> Iterator[dict]:
        rows = [r for columns in batches for r in zip(columns["draw"].to_pylist(), columns["y"].to_pylist(), columns["sentences"].to_pylist())]
        if len({r[1] for r in rows}) == 2:
            rows.sort()                                                                                # the same order, whatever the tasks
            model = fit([r[2] for r in rows], np.array([r[1] for r in rows]), evidence, share)
            marks, weights, *rest = model.parts
            yield {"marks": [marks], "weights": [weights], "rest": [rest]}

    made = arrow_rows(chosen.repartition(1), learn, "marks array<binary>, weights array<double>, rest array<double>").collect()      # bounded by FIT_ROWS and CHOSEN
    return Model([bytes(m) for m in made[0]["marks"]], np.array(made[0]["weights"]), *made[0]["rest"]) if made else share


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts if isinstance(model, Model) else model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own, reader = shared.value, Reader()
        own = Model(*own) if isinstance(own, tuple) else own
        for columns in batches:
            texts = [t or "" for t in columns["text"].to_pylist()]
            scores = np.concatenate([own.scores(reader, texts[a:b]) for a, b in blocks(texts)] + [np.zeros(0)]) if isinstance(own, Model) else np.full(len(texts), own)
            yield {"doc_id": columns["doc_id"], "score": scores}

    return arrow_rows(docs.select("doc_id", "text"), run, "doc_id long, score double")
