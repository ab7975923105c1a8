"""Exact n-gram Jaccard join with set-relation skipping, down to connected components.

A document's set holds its distinct word shingles as 64-bit hashes. Two sets link when
``den * intersection >= num * union``. The join is a prefix join: an index list holds the documents
that have a shingle among the first of their set, in one order for all sets (rarer shingles first,
then by hash). Two relations between sets save work:

- *Index level.* A list entry knows its position, hence the largest partner size it can still serve.
  Lists are cut into blocks by set size and by whether the position can serve an equal or larger
  partner; a probe meets only blocks it can link with, and entries past their position are skipped.
- *Answer level.* In each list every set is first compared with one centre, then, in rounds, those of
  other components with members of the largest one and the other way round. Rare shingles come first, so
  the set that has the list's shingle earliest has the fewest shingles of its own: it is the centre, and
  the next ones are the members that others are compared with. The distances to a list's first centre give answers for the others: a sum of two distances within the limit is a link without
  comparison, a difference beyond the limit is none. Sets already in one component need no answer.
  Only what is left is compared, so a group of n near copies costs about n comparisons, not n * n.

Shingle counts cover all documents. A set that a task has indexed is not indexed again, and equal sets are
one set in all lists. Comparisons are made on the whole texts. The order needs one
number for each slot of a fixed table, whose size does not follow the input; any order is right.

Defined results: a text with 1 to n - 1 words is one shingle; null texts and texts without words have
no shingles, link with nothing and are their own component; rows that repeat an id are rows of their
own, and a component's id is the smallest non-null id in it (null if all are null); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simlens.llm.common import SPACES, Words, arrow_rows, blocks, cut, forget, gram_hashes, likely_among, words_of

#: Slots of the table of shingle counts and the most shingles that may enter it: fixed, sent to all tasks.
SLOTS = 1 << 22
MOST_COUNTED = 1 << 18
#: Rounds against centres: at most so many, and only while lists hold more open pairs than this for each entry
#: and a round closes a quarter of them.
#: Each round has so many centres in a list. What rounds leave open is compared in full, so results do not depend on them.
ROUNDS, PAIRS_PER_ENTRY, HUBS = 4, 4, 32
#: Shingles that a task gathers before it counts them.
GATHER = 1 << 22


class Shingler:
    """Sets of sorted distinct shingle hashes."""

    def __init__(self, n: int = 5):
        self.n, self.words = n, Words(words_of(SPACES))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        _, _, hashes, _, first = self.words.split(texts)
        grams = gram_hashes(hashes, self.n)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a < self.n:
                out.append(gram_hashes(hashes[a:b], b - a) if b > a else grams[:0])
            else:
                found = np.sort(grams[a:b - self.n + 1])
                out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        return out


def lengths(size, num: int, den: int):
    """Prefix lengths of a set as probe (partners of any size) and as index entry (equal or larger partners)."""
    return size + (-num * size) // den + 1, size + (-2 * num * size) // (num + den) + 1


def shingle_levels(docs: DataFrame, n: int, num: int, den: int) -> np.ndarray:
    """How frequent shingles are: for each slot the logarithm of the largest count, 0 for rare ones.

    A task reports the shingles of its index prefixes and all that it meets twice. The bound from which
    a shingle counts as frequent is the smallest power of two that leaves at most ``MOST_COUNTED``.
    """
    def count(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, tokens, marks, held = Shingler(n), [], [], 0

        def report():
            nonlocal tokens, marks, held
            every, wanted = np.concatenate(tokens), np.concatenate(marks)
            tokens, marks, held = [], [], 0
            found, counts = np.unique(every, return_counts=True)
            asked = np.zeros(len(found), dtype=bool)
            asked[np.searchsorted(found, every[wanted])] = True
            asked |= counts > 1
            return {"token": found[asked].view(np.int64), "n": counts[asked]}

        for columns in batches:
            texts = columns["text"].to_pylist()
            for a, b in blocks(texts):
                for own in shingler.sets(texts[a:b]):
                    if len(own):
                        tokens.append(own)
                        marks.append(np.arange(len(own)) < lengths(len(own), num, den)[1])
                        held += len(own)
                if held >= GATHER:
                    yield report()
        if held:
            yield report()

    counted = (arrow_rows(docs.where(F.col("text").isNotNull()).select("text"), count, "token long, n long")
               .groupBy("token").agg(F.sum("n").alias("n")).where("n >= 4")
               .select(F.col("token").bitwiseAND(SLOTS - 1).cast("int").alias("slot"), F.floor(F.log2("n")).cast("int").alias("level")))
    counted = cut(counted.groupBy("slot").agg(F.max("level").alias("level")))
    ranks = {r["level"]: r["n"] for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect()}    # 64 rows at most
    least, kept = 64, 0
    while least > 2 and kept + ranks.get(least - 1, 0) <= MOST_COUNTED:
        least -= 1
        kept += ranks.get(least, 0)
    table = np.zeros(SLOTS, dtype=np.uint8)
    found = counted.where(F.col("level") >= least).toArrow()
    table[found["slot"].to_numpy()] = found["level"].to_numpy()
    return table


def ordered_sets(docs: DataFrame, levels: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """Row id, doc_id, text hash, set size, set digest and the prefix of each row in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def order(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, table = Shingler(n), shared.value
        seen: set[bytes] = set()
        for columns in batches:
            texts = [t or "" for t in columns["text"].to_pylist()]
            if len(seen) > 200_000:
                seen.clear()
            sizes, digests, prefixes = [], [], []
            for a, b in blocks(texts):
                for own in shingler.sets(texts[a:b]):
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    fresh = len(own) > 0 and digest not in seen
                    seen.add(digest)
                    if fresh:
                        level = table[(own & np.uint64(SLOTS - 1)).astype(np.int64)]
                        if level.any():
                            own = own[np.argsort(level, kind="stable")]
                        prefixes.append(own[:lengths(len(own), num, den)[0]].view(np.int64))
                    else:
                        prefixes.append([])
                    sizes.append(len(own))
                    digests.append(digest)
            yield {"doc_id": columns["doc_id"], "text_hash": columns["text_hash"], "size": sizes, "digest": digests, "prefix": prefixes}

    rows = arrow_rows(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), order,
                      "doc_id long, text_hash long, size int, digest binary, prefix array<long>")
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def index_lists(sets: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Index entries of shingles that several different sets have in their prefixes, with a centre for each list."""
    size = F.col("size")
    inner = F.col("pos") < size + F.ceil(-(size * 2 * num) / (num + den)) + 1
    # ceil(-x) is -floor(x): one entry too many at most, which the comparison settles
    entries = sets.select("row", "size", F.posexplode("prefix").alias("pos", "token")).withColumn("inner", inner)
    whole = Window.partitionBy("token")
    several = (entries.withColumn("n", F.count("*").over(whole)).withColumn("some", F.max("inner").over(whole))
               .where("n > 1 and some").drop("n", "some"))
    distinct = (several.join(labels, "row").select("token", F.col("label").alias("row"), "size", "pos", "inner")
                .dropDuplicates(["token", "row"]))
    first = F.min(F.struct("pos", "row")).over(whole)
    return cut(distinct.withColumn("n", F.count("*").over(whole)).withColumn("centre", first["row"]).where("n > 1").drop("n"))


def can_link(a_size: Column, b_size: Column, num: int, den: int) -> Column:
    return (a_size * den >= b_size * num) & (b_size * den >= a_size * num)


def position_allows(a: str, b: str, num: int, den: int) -> Column:
    """The overlap that is left from the positions of a first common shingle is enough."""
    rest = F.least(F.col(f"{a}.size") - F.col(f"{a}.pos"), F.col(f"{b}.size") - F.col(f"{b}.pos"))
    return rest * (num + den) >= (F.col(f"{a}.size") + F.col(f"{b}.size")) * num


def compared(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Distance (size of the symmetric difference) and link flag of each pair (a, b), from the whole texts."""
    def compare(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, last, left = Shingler(n), None, None
        for columns in batches:
            a, b = columns["a"].to_pylist(), columns["b"].to_pylist()
            others = columns["b_text"].to_pylist()
            distance, link, sizes = [], [], []
            for start, end in blocks(others):
                for i, right in zip(range(start, end), shingler.sets(others[start:end])):
                    if a[i] != last:
                        last, left = a[i], shingler.sets([columns["a_text"][i].as_py()])[0]
                    common = len(left) + len(right) - len(np.union1d(left, right))
                    distance.append(len(left) + len(right) - 2 * common)
                    link.append(den * common >= num * (len(left) + len(right) - common))
            yield {"a": a, "b": b, "distance": distance, "link": link}

    pairs = cut(pairs)
    met = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    texts = likely_among(texts, "row", met)                # the rest would only be shuffled
    both = (pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("b_text")), "b")
            .join(texts.select(F.col("row").alias("a"), F.col("text").alias("a_text")), "a").select("a", "b", "a_text", "b_text"))
    return cut(arrow_rows(both, compare, "a long, b long, distance long, link boolean"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for every node with an edge.

    Alternating large-star and small-star steps; each step is written to the shared folder.
    """
    def signature(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = signature(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        after = cut(small.select("v", "m").union(small.select(F.col("u").alias("v"), "m")).where("v <> m").distinct().select(F.col("v").alias("u"), F.col("m").alias("v")))
        sign = signature(after)
        forget(now)
        if sign == mark:
            return after.select(F.col("u").alias("node"), F.col("v").alias("label"))
        now, mark = after, sign


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of all rows after further links between labels or rows."""
    ends = labels.select("row", "label")
    edges = cut(links.join(ends.toDF("a", "u"), "a").join(ends.toDF("b", "v"), "b").select("u", "v").where("u <> v"))
    if edges.isEmpty():
        return labels
    found = components(edges)
    return cut(labels.join(found.toDF("label", "lower"), "label", "left").select("row", F.coalesce("lower", "label").alias("label")))


def unresolved(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries, with their components, of lists that hold more than one component."""
    whole = Window.partitionBy("token")
    return cut(lists.join(labels, "row").withColumn("low", F.min("label").over(whole)).withColumn("high", F.max("label").over(whole))
               .where("low <> high").drop("low", "high"))


def open_pairs_of(entries: DataFrame) -> int:
    """Pairs of entries in one list that belong to different components, before any other filter."""
    parts = entries.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return int(parts.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, component (its smallest row) and component_id for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sets = ordered_sets(docs, shingle_levels(docs, n, num, den), n, num, den)
    filled = sets.where("size > 0")
    equal = filled.groupBy("digest").agg(F.min(F.when(F.size("prefix") > 0, F.col("row"))).alias("label"))
    labels = cut(filled.select("row", "digest").join(equal, "digest").select("row", "label"))
    lists = index_lists(sets, labels, num, den)

    needed = lists.select("row").distinct().join(sets.select("row", "doc_id", "text_hash"), "row")
    texts = cut(docs.withColumn("text_hash", F.xxhash64("text")).alias("d")
                .join(needed.alias("w"), (F.col("d.text_hash") == F.col("w.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
                .select("w.row", "d.text").dropDuplicates(["row"]))

    # first each list's sets against its centre, then those left against centres of other components, while that pays
    answers = open_pairs = None
    for turn in range(ROUNDS + 1):
        if turn == 0:
            entries, centre = lists.withColumn("label", F.col("row")), F.col("row") == F.col("centre")
        else:
            entries = unresolved(lists, labels)
            size, before, open_pairs = entries.count(), open_pairs, open_pairs_of(entries)
            if open_pairs <= PAIRS_PER_ENTRY * size or turn == ROUNDS or before is not None and open_pairs > 0.75 * before:
                break
            # in each list the next members by position: of the component that is largest there, in every other round of the rest
            ranked = entries.withColumn("here", F.count("*").over(Window.partitionBy("token", "label")))
            ranked = ranked.withColumn("least", F.min(F.struct(-F.col("here"), "label")).over(Window.partitionBy("token")))
            wanted = (F.col("label") == F.col("least.label")) == F.lit(turn % 2 == 1)
            place = F.row_number().over(Window.partitionBy("token", wanted).orderBy("pos", "row"))
            past = (turn - 1) // 2 * HUBS                      # members that had their turn
            entries, spent = cut(ranked.withColumn("central", wanted & (place > past) & (place <= past + HUBS)).drop("here", "least")), entries
            forget(spent)
            centre = F.col("central")
        near = (entries.where(centre).alias("c").join(entries.alias("e"), F.col("c.token") == F.col("e.token"))
                .where((F.col("e.row") != F.col("c.row")) & (F.col("e.label") != F.col("c.label")))
                .where(can_link(F.col("c.size"), F.col("e.size"), num, den) & position_allows("c", "e", num, den))
                .select(F.col("c.row").alias("a"), F.col("e.row").alias("b")).distinct())
        if answers is not None:
            near = near.join(both_ways(answers), ["a", "b"], "left_anti")
        found = compared(near, texts, n, num, den)
        answers = found if answers is None else answers.unionByName(found)
        if turn:
            forget(entries)
        labels = relabelled(labels, found.where("link"))

    left = (unresolved(lists, labels)
            .join(answers.select(F.col("a").alias("centre"), F.col("b").alias("row"), "distance"), ["centre", "row"], "left")
            .withColumn("distance", F.when(F.col("row") == F.col("centre"), 0).otherwise(F.col("distance")))
            .withColumn("band", F.floor(F.log("size") / F.log(F.lit(den / num * 1.01))))
            .select("token", "row", "size", "pos", "inner", "label", "distance", "band"))
    left = cut(left)
    forget(lists)
    # an index entry serves partners of its own size band and the next one, up to the size its position allows
    blocks_of = left.where("inner").withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    reach = (F.col("y.size") - F.col("y.pos")) * ((num + den) / num) - F.col("y.size")
    limit = (F.col("x.size") + F.col("y.size")) * (den - num)
    gap = F.abs(F.col("x.distance") - F.col("y.distance")) * (num + den)
    met = (left.alias("x").join(blocks_of.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")))
           .where((F.col("x.label") != F.col("y.label")) & (F.col("x.size") >= F.col("y.size")) & (F.col("x.size") <= reach + 1e-6))
           .where(can_link(F.col("x.size"), F.col("y.size"), num, den) & position_allows("x", "y", num, den))
           .where(F.coalesce(gap <= limit, F.lit(True)))
           .select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b"),
                   F.coalesce((F.col("x.distance") + F.col("y.distance")) * (num + den) <= limit, F.lit(False)).alias("sure"))
           .groupBy("a", "b").agg(F.max("sure").alias("sure")))
    met = cut(met.join(both_ways(answers), ["a", "b"], "left_anti"))
    forget(left)
    found = compared(met.where("not sure").select("a", "b"), texts, n, num, den)
    forget(texts)
    labels = relabelled(labels, found.where("link").select("a", "b").unionByName(met.where("sure").select("a", "b")))

    rows = sets.select("row", "doc_id", "text_hash", "size").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    lowest = cut(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    return rows.join(lowest, "label").select("row", "doc_id", "text_hash", F.col("size").cast("long").alias("n_shingles"), F.col("label").alias("component"), "component_id")


def first_of_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that come first in their component, by doc_id (nulls last), text hash and row; all columns."""
    rows = jaccard_components(docs, n, num, den)
    none = (1 << 63) - 1
    first = rows.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(none)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "text_hash", "row")).alias("k"))
    kept = first.groupBy("k._id", "k._none", F.col("k.text_hash").alias("_hash")).agg(F.count("*").alias("_n"))
    key = ["_id", "_none", "_hash"]
    keyed = (docs.withColumn("_id", F.coalesce("doc_id", F.lit(none))).withColumn("_none", F.col("doc_id").isNull()).withColumn("_hash", F.xxhash64("text"))
             .join(kept, key))
    # rows that agree in id and text are told apart by number only
    return keyed.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("_id"))).where("_at <= _n").select(*docs.columns)
