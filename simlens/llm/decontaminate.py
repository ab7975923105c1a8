"""Benchmark decontamination by winnowing.

A window of ``span`` words keeps the smallest hash among its k-grams; equal windows keep equal hashes,
so every shared span of at least ``span`` words shares a kept fingerprint. An item with fewer words is
one window of its own length and is winnowed at that length. The fingerprints of the benchmark mark a
bitmap of fixed size, which all tasks get; a document window whose fingerprint is not marked is
dropped where it is found. What is left joins the benchmark's distinct windows on fingerprint and
window text, which settles chance hits, and overlapping hits are extended to spans. A window that many
items or many documents share is one row on the benchmark side, so hits never multiply.

Defined results: null texts and texts without words have no words, no hit and no items; items without
words never occur; a null item id hits words but is not listed; repeated item ids count once; document
rows are handled one by one, repeated ones alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simlens.llm.common import NOT_ALNUM, Words, arrow_rows, blocks, cut, gram_hashes, mix, words_of

SPAN = 10
GRAM = 5
#: Bits of the fingerprint bitmap (1 MB): a fixed size, whatever the benchmark holds.
BITS = 23


def fingerprints(hashes: np.ndarray, span: int) -> np.ndarray:
    """Kept fingerprint of every window of ``span`` words, from the words' hashes."""
    k = min(GRAM, span)
    grams = gram_hashes(hashes, k)
    m = len(hashes) - span + 1
    if m <= 0:
        return grams[:0]
    kept = grams[:m].copy()
    for j in range(1, span - k + 1):
        np.minimum(kept, grams[j:j + m], out=kept)
    return mix(kept + np.uint64(span))


class Winnower:
    """Windows of texts with their fingerprints."""

    def __init__(self):
        self.words = Words(words_of(NOT_ALNUM))

    def windows(self, texts: list[str], spans: list[int], bitmap: np.ndarray | None, shorter: bool = False):
        """Word counts, and for each window that the bitmap marks: text number, first word, length, fingerprint, window text.

        ``shorter`` takes texts below ``SPAN`` words as one window of their own length.
        """
        starts, ends, hashes, data, first = self.words.split(texts)
        counts = np.diff(first)
        owner = np.repeat(np.arange(len(texts)), counts)
        out = []
        for span in spans:
            kept = fingerprints(hashes, span)
            inside = owner[:len(kept)] == owner[span - 1:] if len(kept) else np.zeros(0, bool)
            if shorter and span < SPAN:
                inside &= counts[owner[:len(kept)]] == span
            if bitmap is not None:
                slot = kept & np.uint64((1 << BITS) - 1)
                inside &= (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            for i in np.flatnonzero(inside).tolist():
                window = b" ".join([data[a:b].lower() for a, b in zip(starts[i:i + span].tolist(), ends[i:i + span].tolist())])
                out.append((int(owner[i]), i - int(first[owner[i]]), span, kept[i:i + 1].view(np.int64)[0], window.decode("utf-8", "replace")))
        return counts.tolist(), out


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, span, fingerprint and text of every window of the benchmark."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        winnower = Winnower()
        for columns in batches:
            ids, texts = columns["item_id"].to_pylist(), columns["text"].to_pylist()
            for a, b in blocks(texts):
                _, found = winnower.windows(texts[a:b], list(range(1, SPAN + 1)), None, shorter=True)
                yield {"item_id": [ids[a + f[0]] for f in found], "span": [f[2] for f in found], "fingerprint": [f[3] for f in found], "window": [f[4] for f in found]}

    chosen = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    return arrow_rows(chosen, run, "item_id long, span int, fingerprint long, window string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_words, n_hit, n_items, items (sorted as strings), spans and contaminated, from ``text``.

    The added names begin with ``prefix``, for tables that have such names already.
    """
    spark = docs.sparkSession
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    items = cut(benchmark_windows(benchmark).distinct())
    slot = F.col("fingerprint").bitwiseAND((1 << BITS) - 1)
    marks = (items.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast((fingerprint & {(1 << BITS) - 1}L) & 63L as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())        # at most 2^(BITS - 6) rows
    bitmap = np.zeros(1 << (BITS - 6), dtype=np.int64)
    bitmap[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    spans = sorted(r["span"] for r in items.select("span").distinct().collect())   # at most SPAN rows
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        winnower, marked = Winnower(), shared.value
        for columns in batches:
            texts = [t or "" for t in columns["text"].to_pylist()]
            counts, hits = [], [[] for _ in texts]
            for a, b in blocks(texts):
                own, found = winnower.windows(texts[a:b], spans, marked)
                counts += own
                for i, at, span, kept, window in found:
                    hits[a + i].append({"at": at, "span": span, "fingerprint": kept, "window": window})
            yield {c: columns[c] for c in keep} | {"_n": counts, "_hits": hits}

    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["_n long", "_hits array<struct<at:int,span:int,fingerprint:long,window:string>>"])
    met = arrow_rows(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)
    met = cut(met.withColumn("_row", F.monotonically_increasing_id()))
    key = ["fingerprint", "span", "window"]
    distinct = cut(items.select(*key).distinct().withColumn("number", F.monotonically_increasing_id()))
    hits = cut(met.select(F.col("_row").alias("row"), F.inline("_hits")).join(distinct, key).select("row", "at", (F.col("at") + F.col("span")).alias("end"), "number"))

    before = Window.partitionBy("row").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    placed = hits.select("row", "at", "end").distinct().withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(-1)))
    upto = Window.partitionBy("row").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, 0)
    extended = (placed.withColumn("n", F.greatest(F.col("end") - F.greatest("at", "seen"), F.lit(0)))
                .withColumn("part", F.sum(F.when(F.col("at") > F.col("seen"), 1).otherwise(0)).over(upto))
                .groupBy("row", "part").agg(F.min("at").alias("at"), F.max("end").alias("end"), F.sum("n").alias("n"))
                .groupBy("row").agg(F.sum("n").alias("n_hit"), F.sort_array(F.collect_list(F.struct("at", "end"))).alias("spans")))
    whose = items.join(distinct, key).select("number", F.col("item_id").cast("string").alias("item")).distinct()
    listed = (hits.select("row", "number").distinct().join(whose, "number").select("row", "item").distinct()
              .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    none = F.array().cast("array<string>")
    # only rows with possible hits meet the joins; the others, with their texts, stay where they are
    touched = F.size("_hits") > 0
    some = (met.where(touched).drop("_hits")
            .join(extended.select(F.col("row").alias("_row"), F.col("n_hit").alias("_n_hit"), F.col("spans").alias("_spans")), "_row", "left")
            .join(listed.select(F.col("row").alias("_row"), F.col("items").alias("_items")), "_row", "left"))
    out = (some.unionByName(met.where(~touched).drop("_hits"), allowMissingColumns=True)
            .select(*keep, F.col("_n").alias(f"{prefix}n_words"), F.coalesce("_n_hit", F.lit(0)).cast("long").alias(f"{prefix}n_hit"),
                    F.size(F.coalesce("_items", none)).cast("long").alias(f"{prefix}n_items"), F.coalesce("_items", none).alias(f"{prefix}items"),
                    F.coalesce("_spans", F.array().cast("array<struct<at:int,end:int>>")).alias(f"{prefix}spans"),
                    F.col("_n_hit").isNotNull().alias(f"{prefix}contaminated")))
    return out
