"""Whitening of embeddings along principal components found by a block Jacobi-Davidson solver.

The covariance is never formed. Each product of it with a block of vectors is one pass over the rows:
every task centres its rows, multiplies them by the block and emits one partial sum, and Spark adds
the partial sums. The solver on the driver holds vectors of the embedding's length only: a Rayleigh-Ritz
step in the search space gives approximations and residuals; those whose residual has reached double
precision are locked; for the others a projected correction equation is solved by a few steps of MINRES,
all in lockstep, so that a step costs one pass whatever the number of components.

Vectors x = floor(scale * c) + offset are whole numbers; sums and deviations are exact.

Defined results: vectors that are null, or hold a null or non-finite entry, take no part; rows without
an id and rows that repeat an id stay, each by itself; vectors of each length form a fit list of their
own; directions without variance (below ``FLAT`` of the largest: rounding) have no component, so a single row, equal rows or an
empty table give no rows; a deviation beyond a long is null; components of equal variance are any
orthonormal basis of their space; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.llm.common import arrow_rows, cut

COMPONENTS = 32
#: Residuals below this multiple of the largest eigenvalue count as double precision.
PRECISION = 64 * np.finfo(float).eps
#: Components of a smaller share of the largest variance lie within rounding and cannot be scaled to one.
FLAT = 1e-11
#: Steps of MINRES per correction equation, most directions in the search space as a multiple of the components, and most rounds.
INNER, SPACE, ROUNDS = 5, 4, 400
#: Numbers of a batch that one task multiplies at once.
CELLS = 1 << 20


def whole_vectors(embeddings: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, width and x of each usable vector of ``embeddings`` (vec_id, embedding)."""
    ok = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (embeddings.where(F.col("embedding").isNotNull()).where(ok)
            .select("vec_id", F.size("embedding").alias("width"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long") + offset).alias("x")))


def matrices(columns: dict, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices of a batch and their vectors as a matrix of whole numbers."""
    rows = len(columns["x"])
    step = max(1, CELLS // max(width, 1))
    for a in range(0, rows, step):
        b = min(a + step, rows)
        yield a, b, columns["x"].slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, width)


def summed(points: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all rows of the table that ``part`` makes of a matrix of rows; each task sends one table, Spark adds them row by row.

    What reaches the driver has the size of one table.
    """
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = None
        for columns in batches:
            for _, _, x in matrices(columns, width):
                own = part(x)
                total = own if total is None else total + own
        if total is not None:
            yield {"i": np.arange(len(total), dtype=np.int32), "y": list(total)}

    partial = arrow_rows(points.select("x"), run, f"i int, y array<{kind}>")
    adds = "decimal(38,0)" if kind == "bigint" else kind
    rows = (partial.select("i", F.posexplode("y").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("y").cast(adds)).alias("y")).collect())
    out = np.zeros((max((r["i"] for r in rows), default=-1) + 1, max((r["j"] for r in rows), default=-1) + 1), dtype=object if kind == "bigint" else float)
    for r in rows:
        out[r["i"], r["j"]] = int(r["y"]) if kind == "bigint" else r["y"]
    return out


class Centre:
    """Exact mean of whole-number vectors, taken off in two parts: a whole one and the rounded rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list:
        """Sum over dimensions of (n * x - S)^2 of each row, exact; None beyond a long."""
        near = x - self.whole
        rest = np.array([s % self.n for s in self.sums], dtype=object)
        top = (max(int(np.abs(near).max()), 1) + 1) * self.n if near.size else 0
        if top * top * max(x.shape[1], 1) < 1 << 63:
            return (((near * self.n - rest.astype(np.int64)) ** 2).sum(axis=1)).tolist()
        values = [sum(v * v for v in row) for row in (near.astype(object) * self.n - rest).tolist()]
        return [v if v < 1 << 63 else None for v in values]


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of one symmetric system per column, in lockstep; each step applies all operators once."""
    def over(a, b):
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)

    out = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    old, now = np.zeros_like(right), over(right, beta)
    left, cos_old, sin_old, cos, sin = beta.copy(), np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    turn_old, turn = np.zeros_like(right), np.zeros_like(right)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        image = apply(now)
        alpha = (now * image).sum(axis=0)
        image = image - alpha * now - beta * old
        after = np.linalg.norm(image, axis=0)
        diagonal = cos * alpha - cos_old * sin * beta
        first, second, third = np.hypot(diagonal, after), sin * alpha + cos_old * cos * beta, sin_old * beta
        cos_old, cos, sin_old, sin = cos, over(diagonal, first), sin, over(after, first)
        turn_old, turn = turn, over(now - third * turn_old - second * turn, first)
        out += cos * left * turn
        left = -sin * left
        old, now, beta = now, over(image, after), after
    return out


def _new_directions(fresh: np.ndarray, *known: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what ``fresh`` adds to the spans of ``known``, whose columns are orthonormal together."""
    basis = np.concatenate(known, axis=1)
    room = basis.shape[0] - basis.shape[1]
    kept = np.zeros((basis.shape[0], 0))
    for column in fresh.T:
        size = np.linalg.norm(column)
        if kept.shape[1] == room or not size or not np.isfinite(size):
            continue
        column = column / size
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            column = column - kept @ (kept.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            kept = np.concatenate([kept, column[:, None]], axis=1)
    return kept


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], width: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, dict]:
    """The k largest eigenvalues of a symmetric operator, falling, and unit eigenvectors as columns.

    ``product`` maps a block of columns to their images. The third result tells the number of products
    and the largest residual, as a multiple of the largest eigenvalue.
    """
    k = min(k, width)
    rng = np.random.default_rng(seed)
    told = {"products": 0, "rounds": 0, "residual": 0.0}

    def image(block: np.ndarray) -> np.ndarray:
        told["products"] += 1
        return product(block)

    locked, values, residuals = np.zeros((width, 0)), [], []
    space = _new_directions(rng.standard_normal((width, k)), locked)
    images = image(space) if k else space
    top, best, stuck = 0.0, np.inf, 0
    while len(values) < k:
        told["rounds"] += 1
        small = space.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        rest = images - space * theta
        rest -= locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        top = max(top, abs(theta[0]) if len(theta) else 0.0, max(values, default=0.0))
        whole = locked.shape[1] + space.shape[1] == width         # nothing is left to add to the search space
        wanted = min(k - len(values), space.shape[1])
        done = 0
        while done < wanted and (size[done] <= PRECISION * top or whole):
            done += 1
        worst = size[done:wanted].max(initial=0.0)
        stuck = 0 if worst < 0.5 * best or done else stuck + 1
        best = min(best, worst)
        if stuck > 3 and worst <= 1e-11 * top:              # rounding of the products keeps residuals above the bound
            done = wanted
        if told["rounds"] > ROUNDS:
            raise ArithmeticError(f"no convergence after {ROUNDS} rounds: residual {worst / top}")
        if done:                                            # in order of size only: a smaller one may still be overtaken
            locked = np.concatenate([locked, space[:, :done]], axis=1)
            values += theta[:done].tolist()
            residuals += size[:done].tolist()
            space, images, theta, rest, size = space[:, done:], images[:, done:], theta[done:], rest[:, done:], size[done:]
            best = np.inf
        if len(values) >= k:
            break
        wanted = min(k - len(values), space.shape[1])
        if not wanted:
            fresh = rng.standard_normal((width, k - len(values)))
        else:
            open_ = np.flatnonzero(size[:wanted] > PRECISION * top)
            if not len(open_):
                open_ = np.arange(wanted)
            shift, near = theta[open_], space[:, open_]

            def project(block: np.ndarray) -> np.ndarray:
                block = block - locked @ (locked.T @ block)
                return block - near * (near * block).sum(axis=0)

            fresh = minres(lambda block: project(image(project(block)) - shift * project(block)), project(-rest[:, open_]), INNER)
        if space.shape[1] + fresh.shape[1] > max(SPACE * k, 2 * k + 2):     # restart from the best approximations
            keep = min(space.shape[1], 2 * wanted)
            space, images = space[:, :keep], images[:, :keep]
        added = _new_directions(fresh, locked, space)
        if not added.shape[1]:
            added = _new_directions(rng.standard_normal((width, 1)), locked, space)
        space, images = np.concatenate([space, added], axis=1), np.concatenate([images, image(added)], axis=1)
    order = np.argsort(-np.array(values), kind="stable")
    told["residual"] = max(residuals, default=0.0) / top if top else 0.0
    return np.array(values)[order], locked[:, order], told


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual for each usable vector and component."""
    spark = embeddings.sparkSession
    points = cut(whole_vectors(embeddings, scale, offset))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    out = None
    for width, n in sorted(tuple(r) for r in points.groupBy("width").count().collect()):         # lengths of vectors, commonly one
        own = points.where(F.col("width") == width)
        made = _whitened(own, width, n, components, schema) if width else None
        if made is not None:
            out = made if out is None else out.unionByName(made)
    return spark.createDataFrame([], schema) if out is None else out


def _whitened(points: DataFrame, width: int, n: int, components: int, schema: str) -> DataFrame | None:
    sums = summed(points, width, lambda x: x.sum(axis=0, dtype=np.int64)[None, :], "bigint")[0].tolist()
    centre = Centre(n, sums)
    trace = float(summed(points, width, lambda x: (centre.centred(x) ** 2).sum(axis=0)[None, :]).sum()) / n

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            near = centre.centred(x)
            return near.T @ (near @ block)
        return summed(points, width, part) / n

    if not trace:
        return None
    values, vectors, told = jacobi_davidson(product, width, components)
    kept = values > FLAT * values[0]
    values, vectors = values[kept], vectors[:, kept]
    k = len(values)
    maps = vectors / np.sqrt(values)
    mean = summed(points, width, lambda x: (centre.centred(x) @ maps).sum(axis=0)[None, :])[0] / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ maps - mean
        return w.T @ w

    error = float(np.abs(summed(points, width, spread) / n - np.eye(k)).max())
    explained = values / trace

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            for a, b, x in matrices(columns, width):
                rows = b - a
                yield {"vec_id": columns["vec_id"].slice(a, rows).take(np.repeat(np.arange(rows), k)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                       "n": np.full(rows * k, n), "deviation": [d for d in centre.deviations(x) for _ in range(k)], "whitened": (centre.centred(x) @ maps).ravel(),
                       "explained": np.tile(explained, rows), "identity_error": np.full(rows * k, error), "residual": np.full(rows * k, told["residual"])}

    return arrow_rows(points.select("vec_id", "x"), run, schema)
