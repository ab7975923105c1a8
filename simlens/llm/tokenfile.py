"""Token-id files: one concatenated id array per shard, with Elias-Fano coded document boundaries.

Layout of a shard (little-endian): magic, header (documents, ids, id width in bytes, documents with a
null id, smallest id), then two Elias-Fano lists (document ids above the smallest one, and document
ends), then the ids. An Elias-Fano list keeps the low ``l`` bits of each value packed, and the high
parts in unary in a bit vector; the position of every 256th set bit is kept as a 32-bit number, so
``select`` scans a bounded stretch. A shard holds fewer than 2^32 ids; no 64-bit offset is stored.

Tasks write shards under fresh names and return a manifest row; only files named in the manifest are
read, so a failed, repeated or speculative task leaves nothing that counts.

Defined results: a null text is empty and gives the end id alone; null ids come first; equal ids are
ordered by text hash and text; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simlens.llm.common import BLOCK, Words, arrow_rows, blocks, open_shared, words_of, worker_state

MAGIC = b"SLTOKEF1"
HEADER = "<QQBQq"
EF_HEADER = "<QQBQ"
SAMPLE = 256


class EliasFano:
    """A non-decreasing list of non-negative numbers below 2^63, with select."""

    def __init__(self, n: int, top: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low, self.lows, self.highs, self.samples = n, top, low, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1) if low else np.zeros((n, 0), np.uint64)
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        highs = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        highs[places] = 1
        return cls(n, top, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(highs, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def dump(self) -> bytes:
        return struct.pack(EF_HEADER, self.n, self.top, self.low, len(self.highs)) + self.samples.tobytes() + self.lows.tobytes() + self.highs.tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, top, low, wide = struct.unpack_from(EF_HEADER, data, at)
        at += struct.calcsize(EF_HEADER)
        counts = ((n + SAMPLE - 1) // SAMPLE, (n * low + 7) // 8, wide)
        samples = np.frombuffer(data, "<u4", counts[0], at)
        lows = np.frombuffer(data, np.uint8, counts[1], at + 4 * counts[0])
        highs = np.frombuffer(data, np.uint8, wide, at + 4 * counts[0] + counts[1])
        return cls(n, top, low, lows, highs, samples), at + 4 * counts[0] + counts[1] + wide

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.uint64)
        for bit in range(self.low):
            at = i * self.low + bit
            out |= ((self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(bit)
        return out

    def select(self, i: int) -> int:
        """Bit position of the i-th set bit: from its sample over at most one stretch between samples."""
        left = i % SAMPLE
        at = int(self.samples[i // SAMPLE])
        byte = at >> 3
        end = (int(self.samples[i // SAMPLE + 1]) >> 3) + 1 if i // SAMPLE + 1 < len(self.samples) else len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[byte:end], bitorder="little"))
        return byte * 8 + int(ones[np.searchsorted(ones, at - byte * 8) + left])

    def __getitem__(self, i: int) -> int:
        return ((self.select(i) - i) << self.low) | int(self._low(np.array([i]))[0])

    def values(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Values first to last - 1; one select, then a run over the bit vector."""
        last = self.n if last is None else last
        if first >= last:
            return np.zeros(0, dtype=np.int64)
        byte = self.select(first) >> 3
        end = (self.select(last - 1) >> 3) + 1
        ones = np.flatnonzero(np.unpackbits(self.highs[byte:end], bitorder="little")) + byte * 8
        ones = ones[np.searchsorted(ones, self.select(first)):][:last - first]
        i = np.arange(first, last)
        return ((ones - i) << self.low) | self._low(i).astype(np.int64)


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, one distinct word at a time.

    Such a tokenizer never joins characters across white space, so a text's ids are its chunks' ids in
    order; a full stop or comma that ends a chunk after a letter or digit is a chunk of its own, and
    upper-case ASCII letters count as lower-case ones if the tokenizer lowers them. Chunks are found and
    hashed by array operations (64 bits; equal hashes of chunks of other length fail). Each distinct
    chunk is encoded by the library once and kept while the worker lives; two generations bound the
    memory. Texts that may hold special tokens are encoded whole. The first text of every call is also
    encoded whole and compared.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        self.words = Words(words_of(b" \t\n\r"), fold=self.lowers, marks=b".,")
        self.special = sorted({t.content[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.limit, self.young, self.old = limit, {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words. Words of letters alone are encoded many in one call and told apart by the ids that end words."""
        out: dict[str, bytes] = {}
        letters = [w for w in words if w.isalpha()] if self.ends is not None else []
        groups = [letters[at:at + 500] for at in range(0, len(letters), 500)]
        for group, made in zip(groups, self._whole([" ".join(g) for g in groups])):
            cuts = np.flatnonzero(self.ends[np.frombuffer(made, self.dtype)]) + 1
            if len(cuts) == len(group):
                edges = [0, *(cuts * self.dtype.itemsize).tolist()]
                out.update(zip(group, [made[a:b] for a, b in zip(edges, edges[1:])]))
        others = [w for w in words if w not in out]
        out.update(zip(others, self._whole(others)))
        return out

    def _values(self, keys: list[int], words) -> list[bytes]:
        """Ids for each hash; ``words(i)`` gives the text of the i-th."""
        young, old = self.young, self.old
        missing = []
        out = [young.get(k) for k in keys]
        for i, value in enumerate(out):
            if value is None:
                value = old.get(keys[i])
                if value is None:
                    missing.append(i)
                else:
                    young[keys[i]] = out[i] = value
        if missing:
            texts = [words(i) for i in missing]
            made = self._library(list(dict.fromkeys(texts)))
            for i, text in zip(missing, texts):
                young[keys[i]] = out[i] = made[text]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        starts, ends, hashes, data, first = self.words.split(texts)
        found, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = (ends - starts).astype(np.int32)
        if (sizes[where][inverse] != sizes).any():
            return self._whole(texts)
        a, b = starts[where].tolist(), ends[where].tolist()
        values = self._values(found.tolist(), lambda i: data[a[i]:b[i]].lower().decode() if self.lowers else data[a[i]:b[i]].decode())
        step = self.dtype.itemsize
        counts = np.fromiter(map(len, values), np.int64, len(values)) // step
        pool = np.frombuffer(b"".join(values), self.dtype)
        begins = np.cumsum(counts) - counts
        lengths = counts[inverse]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(begins[inverse] - upto[:-1], lengths) + np.arange(upto[-1])].tobytes()
        edges = (upto[first] * step).tolist()
        return [ids[x:y] for x, y in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        out: list[bytes] = [b""] * len(texts)
        plain, whole = [], []
        for i, text in enumerate(texts):
            (whole if any(s in text for s in self.special) else plain).append(i)
        for a, b in blocks([texts[i] for i in plain], 3 * BLOCK):
            for i, made in zip(plain[a:b], self._block([texts[i] for i in plain[a:b]])):
                out[i] = made
        for i, made in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = made
        if texts and out[0] != self._whole(texts[:1])[0]:
            raise ValueError("this tokenizer joins characters across white space; its texts must be encoded whole")
        return out


def shard_bytes(doc_ids: list, lengths: list[int], ids: bytes, width: int) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.cumsum(np.array(lengths, dtype=np.int64))
    head = MAGIC + struct.pack(HEADER, len(doc_ids), int(ends[-1]), width, len(doc_ids) - len(known), base)
    return head + EliasFano.of(known.astype(np.uint64) - np.uint64(base % (1 << 64))).dump() + EliasFano.of(ends).dump() + ids


class Shard:
    """One shard file in memory: ``document(i)`` gives an id array by two selects."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        self.n, self.n_ids, self.width, self.nulls, self.base = struct.unpack_from(HEADER, data, 8)
        view = memoryview(data)
        self.names, at = EliasFano.load(view, 8 + struct.calcsize(HEADER))
        self.ends, at = EliasFano.load(view, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def start(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.start(i):self.ends[i]]

    def doc_ids(self) -> list:
        above = self.names.values().astype(np.uint64) + np.uint64(self.base % (1 << 64))
        return [None] * self.nulls + above.astype(np.int64).tolist()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_ids: int = 1 << 24) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token-id shards in ascending doc_id order; returns the manifest.

    Rows are dealt by ranges of (doc_id, text hash), so a repeated id is split over tasks. A task
    starts a new file once ``shard_ids`` ids or 2^18 documents are gathered, which bounds its memory.
    """
    spark = docs.sparkSession
    folder = folder.rstrip("/")

    def write(batches):
        encoder = worker_state(tokenizer, lambda: WordEncoder(tokenizer))
        width = encoder.dtype.itemsize
        tail = np.array([end_id], encoder.dtype).tobytes()
        fs, root = open_shared(folder)
        fs.create_dir(root, recursive=True)
        names, lengths, parts, held = [], [], [], 0
        part = seq = None
        rows = []

        def close():
            nonlocal names, lengths, parts, held, seq
            file = f"{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(f"{root}/{file}") as out:
                out.write(shard_bytes(names, lengths, b"".join(parts), width))
            row = {"part": [part], "seq": [seq], "file": [file], "n_docs": [len(names)], "n_ids": [held]}
            names, lengths, parts, held, seq = [], [], [], 0, seq + 1
            return row

        for columns in batches:
            ids, texts, numbers = columns["doc_id"].to_pylist(), columns["text"].to_pylist(), columns["part"]
            if seq is None and len(numbers):
                part, seq = numbers[0].as_py(), 0
            for ident, coded in zip(ids, encoder.encode(texts)):
                names.append(ident)
                parts.append(coded + tail)
                lengths.append(len(coded) // width + 1)
                held += lengths[-1]
                if held >= shard_ids or len(names) >= 1 << 18:
                    rows.append(close())
            yield from rows
            rows = []
        if names:
            yield close()

    dealt = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
             .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "h")
             .sortWithinPartitions("doc_id", "h", "text")
             .select("doc_id", "text", F.spark_partition_id().alias("part")))
    arrow_rows(dealt, write, "part int, seq int, file string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before it), n_tokens, ids (bytes of unsigned 32-bit ids)."""
    folder = folder.rstrip("/")
    manifest = spark.read.parquet(f"{folder}/manifest")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)   # a row for each file, not for each document
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def read(batches):
        fs, root = open_shared(folder)
        for columns in batches:
            for file, base in zip(columns["file"].to_pylist(), columns["base"].to_pylist()):
                with fs.open_input_stream(f"{root}/{file}") as source:
                    shard = Shard(source.read())
                names = shard.doc_ids()
                for at in range(0, shard.n, 1024):
                    last = min(at + 1024, shard.n)
                    ends = shard.ends.values(at, last)
                    starts = np.concatenate([[shard.start(at)], ends[:-1]])
                    yield {"doc_id": names[at:last], "start": starts + base, "n_tokens": ends - starts,
                           "ids": [shard.ids[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist())]}

    spread = placed.select("file", "base").repartition(max(1, manifest.count()))
    return arrow_rows(spread, read, "doc_id long, start long, n_tokens long, ids binary")


def token_table(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write and read back; crc32 over the 32-bit ids of each document, its end id included."""
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
