"""Quality scores by a naive Bayes support vector machine.

Features are indicators of hashed n-grams: bytes (1 to 4, case kept), and patterns of repetition among
4 consecutive words. Class log-count ratios come from all labelled training rows; indicators are
scaled by them, and a linear hinge-loss model is fitted by dual coordinate descent on a bounded
sample. A logistic curve over the margins of a part of the sample that the fit has not seen, weighted
to the classes' true shares, gives scores from 0 to 1.

``FIT_ROWS`` bounds the sample per class; counts and scores cover all rows and whole texts.

Defined results: a null text is empty and gets the score of a text without features; labels that are
null, or repeated and in disagreement, teach nothing; with one class only every score is its share of
1 (0.5 without labels); rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.llm.common import SPACES, Words, arrow_rows, blocks, cut, likely_among, mix, words_of

SLOTS = 1 << 17
#: Rows of each class that the hinge-loss model is fitted on, at most.
FIT_ROWS = 3000
BITES = 4
WORDS = 4


class Features:
    """Slots of the n-grams in a text."""

    def __init__(self, slots: int = SLOTS):
        self.mask = np.uint64(slots - 1)
        self.flags = np.zeros(slots, dtype=bool)
        self.words = Words(words_of(SPACES))

    def slots(self, texts: list[str]) -> list[np.ndarray]:
        starts, _, hashes, data, first = self.words.split(texts)
        raw = np.frombuffer(data, np.uint8).astype(np.uint64)
        grams = [raw]
        for n in range(1, BITES):
            grams.append((grams[-1][:-1] << np.uint64(8)) | raw[n:])
        grams = [(mix(g * np.uint64(16) + np.uint64(n)) & self.mask).astype(np.int32) for n, g in enumerate(grams)]
        pattern = np.zeros(max(len(hashes) - WORDS + 1, 0), dtype=np.uint64)
        bit = 0
        for a in range(WORDS):
            for b in range(a + 1, WORDS):
                m = len(pattern)
                pattern |= (hashes[a:a + m] == hashes[b:b + m]).astype(np.uint64) << np.uint64(bit)
                bit += 1
        pattern = (mix(pattern * np.uint64(16) + np.uint64(BITES)) & self.mask).astype(np.int32)
        at, out = 0, []
        for i, text in enumerate(texts):
            size = len(text.encode("utf-8", "surrogatepass"))
            for n, g in enumerate(grams):
                self.flags[g[at:at + max(size - n, 0)]] = True
            a, b = int(first[i]), int(first[i + 1])
            self.flags[pattern[a:max(b - WORDS + 1, a)]] = True
            found = np.flatnonzero(self.flags)
            self.flags[found] = False
            out.append(found.astype(np.int32))
            at += size + 1
        return out


def log_count_ratio(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of the smoothed shares of each slot among class 1 and class 0 counts."""
    p, q = counts[1] + smooth, counts[0] + smooth
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model on indicators scaled by ``ratio``; the last weight is the intercept."""
    rng = np.random.default_rng(seed)
    weights = np.zeros(len(ratio) + 1)
    values = [ratio[r] for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    alphas = np.zeros(len(rows))
    sign = np.where(labels == 1, 1.0, -1.0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1
            after = min(max(alphas[i] - gradient / norms[i], 0.0), cost)
            step = after - alphas[i]
            if step:
                alphas[i] = after
                weights[rows[i]] += step * sign[i] * values[i]
                weights[-1] += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-4 * cost:
            break
    return weights


def logistic(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps with smoothed targets; classes weigh as their shares."""
    ones = max(labels.sum(), 1)
    zeros = max(len(labels) - labels.sum(), 1)
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(labels == 1, share / ones, (1 - share) / zeros) * len(labels)
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    scale = np.abs(margins).max() or 1.0
    x[:, 0] /= scale
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> dict:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id and a 0/1 column), both already cut to the training rows."""
    agreed = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
              .agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").select("doc_id", F.col("y").cast("int").alias("y")))
    agreed = cut(agreed)
    known = likely_among(docs.select("doc_id", "text"), "doc_id", agreed.select("doc_id")).join(agreed, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    totals = {r["y"]: r["n"] for r in docs.select("doc_id").join(agreed, "doc_id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return {"share": float(next(iter(totals), 0.5))}
    share = totals[1] / (totals[0] + totals[1])

    # one pass gives the counts of all rows and the features of the sampled ones
    steps = 1 << 20
    limit = {y: min(steps, int(steps * 0.9 * fit_rows / n)) if n > fit_rows else steps for y, n in totals.items()}

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        features, sums, ones = Features(), np.zeros((2, SLOTS), dtype=np.int64), 0
        for columns in batches:
            texts, ys, draws = columns["text"].to_pylist(), columns["y"].to_pylist(), columns["draw"].to_pylist()
            kept = []
            for a, b in blocks(texts):
                for i, found in zip(range(a, b), features.slots(texts[a:b])):
                    sums[ys[i], found] += 1
                    ones += 1
                    if draws[i] < limit[ys[i]]:
                        kept.append((ys[i], draws[i], found))
            if kept:
                yield {"y": [k[0] for k in kept], "draw": [k[1] for k in kept], "slots": [k[2] for k in kept], "n": [None] * len(kept)}
        if ones:
            for y in (0, 1):
                found = np.flatnonzero(sums[y])
                yield {"y": [y], "draw": [None], "slots": [found], "n": [sums[y, found]]}

    passed = cut(arrow_rows(known.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(steps))).select("text", "y", "draw"), count,
                            "y int, draw long, slots array<int>, n array<long>"))
    counts = np.zeros((2, SLOTS))
    summed = (passed.where("n is not null").select("y", F.explode(F.arrays_zip("slots", "n")).alias("s")).groupBy("y", "s.slots").agg(F.sum("s.n").alias("n")).toArrow())
    counts[summed["y"].to_numpy(), summed["slots"].to_numpy()] = summed["n"].to_numpy()          # at most two rows a slot
    ratio = log_count_ratio(counts)

    def fit(batches: Iterator[dict]) -> Iterator[dict]:
        rows, ys, draws = [], [], []
        for columns in batches:
            rows += [np.array(s, dtype=np.int64) for s in columns["slots"].to_numpy(zero_copy_only=False)]
            ys += columns["y"].to_pylist()
            draws += columns["draw"].to_pylist()
        labels_ = np.array(ys)
        if len(set(ys)) < 2:
            return
        order = np.lexsort(([len(r) for r in rows], labels_, draws))            # the same order, whatever the tasks
        rows, labels_ = [rows[i] for i in order], labels_[order]
        unseen = np.arange(len(rows)) % 4 == 0
        seen = np.flatnonzero(~unseen)
        weights = dual_coordinate_descent([rows[i] for i in seen], labels_[seen], ratio)
        scaled = weights[:-1] * ratio
        margins = np.array([scaled[r].sum() for r in rows]) + weights[-1]
        slope, offset = logistic(margins[unseen], labels_[unseen], share)
        yield {"weights": [scaled], "intercept": [weights[-1]], "slope": [slope], "offset": [offset]}

    sample = passed.where("n is null").select("y", "draw", "slots").limit(2 * fit_rows).repartition(1)    # bounded by FIT_ROWS
    made = arrow_rows(sample, fit, "weights array<double>, intercept double, slope double, offset double").collect()
    if not made:
        return {"share": share}
    return {"weights": np.array(made[0]["weights"]), "intercept": made[0]["intercept"], "slope": made[0]["slope"], "offset": made[0]["offset"]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own = shared.value
        features = Features()
        for columns in batches:
            texts = [t or "" for t in columns["text"].to_pylist()]
            if "weights" not in own:
                scores = np.full(len(texts), own["share"])
            else:
                margins = np.array([own["weights"][found].sum() for a, b in blocks(texts) for found in features.slots(texts[a:b])]) + own["intercept"]
                scores = 1 / (1 + np.exp(-np.clip(own["slope"] * margins + own["offset"], -500, 500)))
            yield {"doc_id": columns["doc_id"], "score": scores}

    return arrow_rows(docs.select("doc_id", "text"), run, "doc_id long, score double")
