"""Language identification with hyperdimensional letter profiles.

Every letter has a random vector of -1 and 1, drawn from its code point, so that all tasks agree. A
letter n-gram is bound by multiplying its letters' vectors, each permuted by its place; a text is the
bundle (sum) of its n-grams, and a language is the bundle of its training texts, each at unit length.
A text goes to the language of the largest cosine. Letters are lower-cased; every run of other
characters is one gap symbol with a vector of its own.

Defined results: text that is null or has no letter gives ``und`` with score 0; equal cosines go to
the label first in order; without any training text all texts are ``und``; rows are scored one by
one, repeated ones alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlens.llm.common import arrow_rows, blocks

DIMENSIONS = 1024
N = 3
#: Labels that a profile set may hold: bounds what is sent to the driver and to tasks.
MOST_LANGUAGES = 1000
#: Unit vectors are summed as integers of this scale, so that sums do not depend on their order.
SCALE = 1 << 20
PIECE = 1 << 19


class LetterSpace:
    """Letter vectors and text vectors of one task."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = N):
        self.dimensions, self.n = dimensions, n
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        self.count = 0
        self.tables = np.zeros((n, 64, dimensions), dtype=np.int8)
        self._add(0)

    def _add(self, code: int) -> None:
        if self.count == self.tables.shape[1]:
            self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], axis=1)
        vector = np.random.default_rng(7_919 + code).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        for place in range(self.n):
            self.tables[place, self.count] = np.roll(vector, place)
        self.symbol[code] = self.count
        self.count += 1

    def _symbols(self, text: str) -> np.ndarray:
        """Symbols of lower-case text: 0 for other characters, others for letters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if (self.symbol[codes] < 0).any():
            for code in np.unique(codes[self.symbol[codes] < 0]).tolist():
                if chr(code).isalpha():
                    self._add(code)
                else:
                    self.symbol[code] = 0
        return self.symbol[codes]

    def _grams(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes and counts of the n-grams of a text, piece by piece: letters, with one gap between words and at both ends.

        The last symbols of a piece go on to the next, so the length of a piece changes nothing.
        """
        text, tail, letters = text.lower(), np.zeros(1, np.int32), False
        for at in range(0, len(text) + 1, PIECE):
            last = at + PIECE > len(text)
            stream = np.concatenate([tail, self._symbols(text[at:at + PIECE]), np.zeros(int(last), np.int32)])
            kept = np.ones(len(stream), dtype=bool)
            kept[len(tail):] = (stream[len(tail):] != 0) | (stream[len(tail) - 1:-1] != 0)
            stream = stream[kept].astype(np.int64)
            letters = letters or bool(stream.any())
            m = len(stream) - self.n + 1
            tail = stream[-(self.n - 1):].astype(np.int32)
            if m > 0 and letters:
                code = np.zeros(m, np.int64)
                for place in range(self.n):
                    code = (code << 20) | stream[place:place + m]
                yield np.unique(code, return_counts=True)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Bundled vectors of texts, one row each; a text without letters gives zeros."""
        found = [(i, codes, counts) for i, text in enumerate(texts) for codes, counts in self._grams(text)]
        exact = np.float32 if max(map(len, texts), default=0) < 1 << 23 else np.float64          # sums are whole numbers
        out = np.zeros((len(texts), self.dimensions), dtype=exact)
        if not found:
            return out
        every, inverse = np.unique(np.concatenate([codes for _, codes, _ in found]), return_inverse=True)
        weights = np.zeros((len(texts), len(every)), dtype=exact)
        np.add.at(weights, (np.repeat([i for i, *_ in found], [len(c) for _, c, _ in found]), inverse), np.concatenate([n for *_, n in found]))
        for at in range(0, len(every), 8192):
            part = every[at:at + 8192]
            bound = np.ones((len(part), self.dimensions), dtype=np.int8)
            for place in range(self.n):
                bound *= self.tables[place, (part >> (20 * (self.n - 1 - place))) & 0xFFFFF]
            out += weights[:, at:at + 8192] @ bound.astype(exact)
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1, length)


def train_profiles(docs: DataFrame, train: Column, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language profiles from ``text`` and non-null ``lang`` of the rows where ``train`` holds.

    Each task sums its texts; the sums of tasks are added by language and dimension. The driver gets
    one vector per label, at most ``MOST_LANGUAGES``.
    """
    def sums(batches: Iterator[dict]) -> Iterator[dict]:
        space, total = LetterSpace(dimensions), {}
        for columns in batches:
            texts, langs = columns["text"].to_pylist(), columns["lang"].to_pylist()
            for a, b in blocks(texts, 1 << 18):
                scaled = np.rint(unit(space.vectors(texts[a:b])) * SCALE).astype(np.int64)
                labels = np.array(langs[a:b], dtype=object)
                for lang in set(langs[a:b]):
                    total[lang] = total.get(lang, 0) + scaled[labels == lang].sum(axis=0)
        if total:
            yield {"lang": list(total), "v": list(total.values())}

    chosen = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    found = (arrow_rows(chosen, sums, "lang string, v array<long>").select("lang", F.posexplode("v").alias("at", "x"))
             .groupBy("lang", "at").agg(F.sum("x").alias("x"))
             .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v")))
    rows = found.limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} language labels")
    return {r["lang"]: np.array(r["v"], dtype=np.float64) for r in sorted(rows, key=lambda r: r["lang"]) if any(r["v"])}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the predicted language and its cosine (negative ones as 0), called ``names``, from ``text``."""
    labels = list(profiles)
    dimensions = len(next(iter(profiles.values()))) if profiles else DIMENSIONS
    prototypes = unit(np.stack(list(profiles.values()))).astype(np.float32).T if profiles else np.zeros((dimensions, 0), np.float32)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def score(batches: Iterator[dict]) -> Iterator[dict]:
        space = LetterSpace(dimensions)
        for columns in batches:
            texts = [t or "" for t in columns["text"].to_pylist()]
            best, value = [], []
            for a, b in blocks(texts, 1 << 18):
                rows = space.vectors(texts[a:b])
                cosines = unit(rows) @ prototypes.astype(np.float64) if labels else np.zeros((b - a, 1))
                known = rows.any(axis=1) & bool(labels)
                top = cosines.argmax(axis=1)
                best += [labels[t] if k else "und" for t, k in zip(top, known)]
                value.append(np.where(known, np.clip(cosines[np.arange(b - a), top], 0, 1), 0.0))
            yield {c: columns[c] for c in keep} | {names[0]: best, names[1]: np.concatenate(value) if value else []}

    wanted = docs.select(*dict.fromkeys([*keep, "text"]))
    return arrow_rows(wanted, score, ", ".join([f"`{c}` {fields[c]}" for c in keep] + [f"{names[0]} string", f"{names[1]} double"]))
