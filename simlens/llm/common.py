"""Helpers shared by the operators of this package: shared files, splits, word hashes, row batches."""

from __future__ import annotations

import ctypes
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlens.session import checkpoint_root, cut, forget

__all__ = ["BLOCK", "arrow_rows", "blocks", "cut", "forget", "held_out", "held_out_id", "mix", "open_shared", "read_table", "shared_folder", "Words", "worker_state", "words_of"]

#: Rows and bytes of an Arrow batch, at most: whole texts are long, and several batches are in memory at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

#: Bytes of text that a vectorised kernel handles at once; bounds the memory of a task whatever the batch holds.
BLOCK = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/simlens/{kind}-{uuid.uuid4().hex}"


def open_shared(uri: str):
    """File system and path of a shared location: a plain path, or a URI of any scheme that pyarrow knows."""
    from pyarrow import fs

    if ":" not in uri.split("/")[0]:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def worker_state(key: str, make: Callable):
    """An object that the tasks of one Python worker share, such as a loaded vocabulary; results must not depend on it."""
    kept = sys.__dict__.setdefault("_simlens_worker", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def release_memory() -> None:
    """Give memory that a task has freed back to the system: idle workers stay alive and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held_out(ident: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(ident.cast("string")) % 5 == 0, F.lit(True))


def held_out_id(ident) -> bool:
    return ident is None or zlib.crc32(str(ident).encode()) % 5 == 0


#: Bits of the membership table of ``likely_among``: a fixed size.
MEMBER_BITS = 23


def likely_among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may occur in ``ids`` (one column of that name): all that do, and some others.

    Saves shuffling rows that a join would drop. The broadcast table has 2^(MEMBER_BITS - 6) rows at most, however many ids there are.
    """
    def slot():
        return F.pmod(F.xxhash64(column), F.lit(1 << MEMBER_BITS))

    bits = (ids.where(F.col(column).isNotNull()).select(F.shiftright(slot(), 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))").alias("_bit"))
            .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    marked = df.withColumn("_word", F.shiftright(slot(), 6)).join(F.broadcast(cut(bits)), "_word")
    return marked.where(F.expr(f"shiftrightunsigned(_bits, cast(pmod(xxhash64({column}), 64) as int)) & 1L") == 1).drop("_word", "_bits")


def arrow_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Apply ``rows`` to each partition; it takes and yields dictionaries of columns (lists or arrays).

    The session's limits of Arrow batches are lowered to ``BATCH``, unless they are lower already.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = ({n: c for n, c in zip(b.schema.names, b.columns)} for b in batches)
        for columns in rows(inputs):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)
        release_memory()

    conf = df.sparkSession.conf
    for name, most in BATCH.items():
        now = conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(run, schema)


def blocks(texts: list[str], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of about ``limit`` characters; a longer text stands alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Splits UTF-8 text into words and hashes each to 64 bits, with array operations only.

    ``inside`` says for each byte whether it belongs to a word. With ``fold``, A-Z count as a-z. A byte
    of ``marks`` between a letter or digit and the end of a word is a word of its own. The hash of a
    word is a polynomial in a fixed odd base over random byte values, from prefix sums modulo 2^64.
    """

    def __init__(self, inside: np.ndarray, fold: bool = True, marks: bytes = b""):
        lower = np.arange(256, dtype=np.uint8)
        if fold:
            lower[65:91] += 32
        self.marks = marks
        value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.value, self.inside = value[lower], inside[lower]
        self.size = 0
        self.base, self.inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, BLOCK + 4096)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(self.size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
        """Starts, ends and hashes of all words of the joined texts, the joined bytes, and each text's first word (one more entry than texts)."""
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(coded) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        self._powers(len(raw) + 1)
        flags = self.inside[raw].view(np.int8)
        step = np.diff(flags, prepend=np.int8(0), append=np.int8(0))
        begin, stop = step == 1, step == -1
        if self.marks:
            last = np.flatnonzero(stop) - 1
            last = last[(last > 0) & IS_MARK[self.marks][raw[last]]]
            last = last[PLAIN_BYTE[raw[last - 1]]]
            begin[last] = stop[last] = True
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.value[raw] * self.up[:len(raw)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        offsets = np.cumsum(np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded)))
        first = np.searchsorted(starts, np.concatenate([[0], offsets]))
        return starts, ends, hashes, data, first


class _Marks(dict):
    def __missing__(self, marks: bytes) -> np.ndarray:
        self[marks] = np.isin(np.arange(256), list(marks))
        return self[marks]


IS_MARK = _Marks()
PLAIN_BYTE = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


def words_of(separators: bytes, keep_high: bool = True) -> np.ndarray:
    """Table of word bytes for a set of separator bytes."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    return inside


#: Word rules of the operators, for text whose A-Z were made a-z: bytes outside words.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words; entry i covers words i to i + n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        total += hashes[j:j + m] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3) | 1) & (2 ** 64 - 1))
        total ^= total >> np.uint64(29)
    return mix(total + np.uint64(n))
