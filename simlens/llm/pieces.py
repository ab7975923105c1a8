"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here, and its parts are rebuilt as a tokenizer: the normaliser with its
character map, the marker for spaces and the dummy prefix, unigram scores or merges ordered by score,
and byte fallback. Ids are compared with the sentencepiece library's own.

Where no piece holds a marker after another character and the normaliser has no character map, a
text's ids are the ids of its runs (markers, then other characters) in order. Each distinct run is
then encoded once, in multithreaded batches, and compared with the sentencepiece library once; the
first text of every batch is also encoded whole by both libraries. Other models encode and compare
every text whole.

Defined results: null or empty text has no ids and decodes to an empty text; ``round_trip`` compares
the decoded text with the normalised one; ``parity`` is false where the two libraries differ; rows
are handled one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from simlens.llm.common import arrow_rows

MARK = "▁"
#: Fixed values of the model format: kinds of piece, kinds of model.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protobuf message as (number, integer or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at:at + size]
            at += size


class PieceModel:
    """A parsed model: pieces as (text, score, kind), and the settings of trainer and normaliser."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.built = None
        trainer, rules = {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.character_map = rules.get(2, b"")
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))

    def runs_are_safe(self) -> bool:
        return not self.character_map and not self.squeeze and self.prefix and all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p, _, _ in self.pieces)

    def _model(self):
        """Unigram scores, or merges in the order of the scores of what they make."""
        from tokenizers import models

        if self.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        usable = {p: (s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        pairs = [(-s, i, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, (s, i) in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        return models.BPE(vocab=ids, merges=[(a, b) for *_, a, b in sorted(pairs)], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)

    def tokenizer(self, prefix: bool = True):
        """The model as a tokenizer of the tokenizers library; ``prefix=False`` leaves the dummy prefix out."""
        from tokenizers import Regex, Tokenizer, decoders, normalizers

        if self.built is None:
            self.built = self._model()
        out = Tokenizer(self.built)          # tokenizers share one model
        steps = [normalizers.Precompiled(self.character_map)] if self.character_map else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.prefix and prefix:
            steps.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.prefix else [])])
        return out

    def piece_bytes(self) -> list[bytes]:
        def one(text: str, kind: int) -> bytes:
            if kind == BYTE:
                return bytes([int(text[3:5], 16)])
            return b"" if kind == CONTROL else (self.unknown_text if kind == UNKNOWN else text.replace(MARK, " ")).encode()
        return [one(p, kind) for p, _, kind in self.pieces]


class PieceCodec:
    """Encoder and decoder of one task."""

    def __init__(self, path: str, threads: int = 2, limit: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import sentencepiece

        with open(path, "rb") as source:
            self.model = PieceModel(source.read())
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_runs = self.model.runs_are_safe()
        self.whole = self.model.tokenizer()
        if self.by_runs:
            self.run, self.runs = self.model.tokenizer(prefix=False), self.model.tokenizer(prefix=False)
            from tokenizers import pre_tokenizers

            self.runs.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="never", split=True)
        self.starts = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.table, self.threads, self.limit = self.model.piece_bytes(), threads, limit
        self.young, self.old, self.odd = {}, {}, set()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> None:
        """Encode new runs: runs of one marker go through the libraries many at a time, cut where a piece begins with the marker."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        single = [k for k in keys if k and k[0] != MARK]
        others = [k for k in keys if not k or k[0] == MARK]
        groups = [single[at:at + 200] for at in range(0, len(single), 200)]
        coded = self.runs.encode_batch_fast([MARK + MARK.join(g) for g in groups], add_special_tokens=False)
        for group, made, own in zip(groups, coded, self.own.encode([" ".join(g) for g in groups], num_threads=self.threads)):
            ids = np.array(made.ids, "<i4")
            cuts = np.flatnonzero(self.starts[ids])
            if made.ids != own or len(cuts) != len(group):
                others += group
                continue
            ids, edges = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
            self.young.update(zip(group, [ids[a:b] for a, b in zip(edges, edges[1:])]))
        for key, made, own in zip(others, self.run.encode_batch_fast([MARK + k for k in others], add_special_tokens=False), self.own.encode(others, num_threads=self.threads)):
            if key and made.ids != own:
                self.odd.add(key)
            self.young[key] = np.array(made.ids, "<i4").tobytes()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether both libraries agree on them."""
        if not self.by_runs:
            made, own = self._whole(texts), self.own.encode(texts, num_threads=self.threads)
            return [np.array(m, "<i4") for m in made], [m == o for m, o in zip(made, own)]
        out, same = [], []
        for at in range(0, len(texts), 256):
            split = []
            for text in texts[at:at + 256]:
                marked = text.replace(" ", MARK)
                if MARK + MARK in marked or marked.startswith(MARK):
                    split.append([run[1:] for run in re.findall(f"{MARK}+[^{MARK}]*", MARK + marked)])
                else:
                    split.append(marked.split(MARK) if marked else [])
            missing = []
            for key in set().union(*split).difference(self.young):
                known = self.old.get(key)
                if known is None:
                    missing.append(key)
                else:
                    self.young[key] = known
            self._learn(missing)
            young, old = self.young, self.old
            for keys in split:
                out.append(np.frombuffer(b"".join([young[k] if k in young else old[k] for k in keys]), "<i4"))
                same.append(not self.odd or self.odd.isdisjoint(keys))
        if texts:
            same[0] = same[0] and out[0].tolist() == self._whole(texts[:1])[0] == self.own.encode(texts[0])
        return out, same

    def decode(self, ids: np.ndarray) -> str:
        table = self.table
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text

    def normalised(self, text: str) -> str:
        """What a text decodes to if nothing is lost."""
        if self.by_runs:
            return text.replace(MARK, " ")
        plain = self.whole.normalizer.normalize_str(text).replace(MARK, " ")
        return plain[1:] if self.model.prefix and plain.startswith(" ") else plain


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (of unsigned 32-bit ids), decoded_sha256, round_trip, parity for each row of ``docs``."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codec = PieceCodec(model_path, threads)       # not kept: other stages share the worker's memory
        for columns in batches:
            names, texts = columns["doc_id"].to_pylist(), columns["text"].to_pylist()
            for at in range(0, len(texts), 512):
                part = [t or "" for t in texts[at:at + 512]]
                ids, same = codec.encode(part)
                back = [codec.decode(i) for i in ids]
                yield {"doc_id": names[at:at + 512], "ids": ids, "n_tokens": [len(i) for i in ids], "ids_crc32": [zlib.crc32(i.tobytes()) for i in ids],
                       "decoded_sha256": [hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back],
                       "round_trip": [b == codec.normalised(t) for b, t in zip(back, part)], "parity": same}

    return arrow_rows(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean")
