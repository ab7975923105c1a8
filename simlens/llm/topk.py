"""Exact top-k inner products with a KD-tree per shard.

Vectors become integers, and shards of bounded size are built as KD-trees: a node is split at the
median of its widest dimension and keeps the tight box of its points. The trees are written to the
shared folder; a task takes a block of queries and goes through all shards. In a tree, nodes are
visited best first by the largest product that their box allows. The k-th best score so far goes along
from node to node and from shard to shard; a node whose bound stays below it is never opened, and one
whose bound equals it only if it may hold a smaller id.

Products are exact: they are computed in doubles only while no sum can reach 2^53, else in whole
Python numbers.

Defined results: vectors that are null, or hold a null or non-finite component, and rows without an id
take no part; vectors of different length are not compared; a query's own row is no candidate, while
other rows that repeat its id are; ties go to the smaller id; with fewer than k candidates all are
returned; an empty table gives nothing; other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlens.llm.common import arrow_rows, cut, open_shared, shared_folder

SHARD, LEAF, QUERIES = 8192, 64, 256
EXACT = 1 << 53


class KDTree:
    """Median-split tree over integer vectors, kept as arrays; nodes in the order they were made."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> KDTree:
        order = np.lexsort((rows, ids))
        ids, rows, vectors = ids[order], rows[order], vectors[order]
        place = np.arange(len(ids))
        first, last, left, right, low, high, least = [], [], [], [], [], [], []

        def node(a: int, b: int) -> int:
            own = place[a:b]
            box = vectors[own]
            number = len(first)
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            least.append(ids[own].min())
            first.append(a)
            last.append(b)
            left.append(-1)
            right.append(-1)
            return number

        todo = [node(0, len(ids))]
        while todo:
            number = todo.pop()
            a, b = first[number], last[number]
            if b - a <= LEAF:
                continue
            own = place[a:b]
            wide = int((high[number].astype(np.float64) - low[number]).argmax()) if vectors.shape[1] else 0
            if vectors.shape[1]:
                place[a:b] = own[np.argsort(vectors[own, wide], kind="stable")]      # ties stay in id order
            middle = (a + b) // 2
            left[number], right[number] = node(a, middle), node(middle, b)
            todo += [left[number], right[number]]
        return cls({"ids": ids[place], "rows": rows[place], "vectors": vectors[place], "first": np.array(first), "last": np.array(last), "left": np.array(left),
                    "right": np.array(right), "low": np.array(low), "high": np.array(high), "least": np.array(least)})

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = dict(self.__dict__)
        for name in ("vectors", "low", "high"):
            values = arrays[name]
            top = int(np.abs(values.astype(np.float64)).max()) if values.size else 0
            arrays[name] = values.astype(np.int16 if top < 1 << 15 else np.int64)
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> KDTree:
        with np.load(io.BytesIO(data)) as kept:
            return cls({n: kept[n] for n in kept.files})


def _numbers(values: np.ndarray, exact: bool) -> np.ndarray:
    return values.astype(np.float64) if exact else values.astype(object)


class Search:
    """k best candidates of a block of queries, carried over shards."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.rows, self.vectors, self.k = ids, rows, vectors, k
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in ids]       # heaps of (score, -id, -row): the worst is first

    def visit(self, tree: KDTree) -> None:
        if tree.vectors.shape[1] != self.vectors.shape[1]:
            return
        width = self.vectors.shape[1]
        top = max((float(np.abs(v.astype(np.float64)).max()) if v.size else 0.0) for v in (self.vectors, tree.vectors))
        exact = top * top * max(width, 1) < EXACT
        queries = _numbers(self.vectors, exact)
        bounds = np.maximum(queries, 0) @ _numbers(tree.high, exact).T + np.minimum(queries, 0) @ _numbers(tree.low, exact).T
        points = _numbers(tree.vectors, exact)
        first, last, left, right, least = (x.tolist() for x in (tree.first, tree.last, tree.left, tree.right, tree.least))
        for q in range(len(queries)):
            best, own, bound = self.best[q], int(self.rows[q]), bounds[q].tolist()
            heap = [(-bound[0], least[0], 0)]
            while heap:
                up, low_id, node = heapq.heappop(heap)
                if len(best) == self.k and (-up < best[0][0] or -up == best[0][0] and low_id > -best[0][1]):
                    if -up < best[0][0]:
                        break              # bounds only fall from here
                    continue
                if left[node] >= 0:
                    for child in (left[node], right[node]):
                        if len(best) < self.k or bound[child] >= best[0][0]:
                            heapq.heappush(heap, (-bound[child], least[child], child))
                    continue
                a, b = first[node], last[node]
                scores = points[a:b] @ queries[q]
                wanted = np.flatnonzero(scores >= best[0][0]) if len(best) == self.k else range(b - a)
                for i in wanted:
                    if int(tree.rows[a + i]) == own:
                        continue
                    entry = (int(scores[i]), -int(tree.ids[a + i]), -int(tree.rows[a + i]))
                    if len(best) < self.k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)

    def results(self) -> dict[str, list]:
        rows = [(int(i), rank, -entry[1], entry[0]) for i, best in zip(self.ids, self.best) for rank, entry in enumerate(sorted(best, reverse=True), 1)]
        return {n: [r[c] for r in rows] for c, n in enumerate(("query_id", "rank", "vec_id", "score"))}


def _matrix(column, width: int, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, width)


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """row, vec_id, width and v: floor(scale * x) of each usable vector."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(ok)
    return cut(usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("embedding").alias("width"),
                             F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")))


def exact_top_k(embeddings: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products of each query row of ``embeddings`` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings)
    folder = shared_folder(spark, "trees")
    count = vectors.count()

    def groups(columns: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        widths = columns["width"].to_numpy()
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            yield width, columns["vec_id"].to_numpy()[at], columns["row"].to_numpy()[at], _matrix(columns["v"].take(at), width, len(at))

    def build(batches: Iterator[dict]) -> Iterator[dict]:
        fs, root = open_shared(folder)
        fs.create_dir(root, recursive=True)
        held: dict[int, list] = {}

        def write(width: int) -> dict:
            ids, rows, values = (np.concatenate(x) for x in zip(*held.pop(width)))
            file = f"{uuid.uuid4().hex}.npz"
            with fs.open_output_stream(f"{root}/{file}") as out:
                out.write(KDTree.build(ids, rows, values).dump())
            return {"file": [file], "n": [len(ids)], "width": [width]}

        for columns in batches:
            for width, ids, rows, values in groups(columns):
                for at in range(0, len(ids), SHARD):
                    held.setdefault(width, []).append((ids[at:at + SHARD], rows[at:at + SHARD], values[at:at + SHARD]))
                    if sum(len(h[0]) for h in held[width]) >= SHARD:
                        yield write(width)
        for width in list(held):
            yield write(width)

    spread = vectors.repartition(max(1, -(-count // SHARD)), F.xxhash64("row"))
    shards = cut(arrow_rows(spread.select("row", "vec_id", "width", "v"), build, "file string, n long, width int"))
    files = sorted((r["width"], r["file"]) for r in shards.collect())           # a name for each shard

    def search(batches: Iterator[dict]) -> Iterator[dict]:
        fs, root = open_shared(folder)
        for columns in batches:
            for width, ids, rows, values in groups(columns):
                for at in range(0, len(ids), QUERIES):
                    block = Search(ids[at:at + QUERIES], rows[at:at + QUERIES], values[at:at + QUERIES], k)
                    for own, file in files:
                        if own == width:
                            with fs.open_input_stream(f"{root}/{file}") as source:
                                block.visit(KDTree.load(source.read()))
                    yield block.results()

    chosen = cut(vectors.where(is_query))
    dealt = chosen.repartition(max(1, -(-chosen.count() // QUERIES)), F.xxhash64("row"))
    return arrow_rows(dealt.select("row", "vec_id", "width", "v"), search, "query_id long, rank int, vec_id long, score long")
