"""Embedding whitening: principal components by a block Jacobi-Davidson method whose products are Spark jobs.

Vectors that are null or hold a null or non-finite entry are left out, and so are those whose length isn't the most
frequent one (of several, the longest). Entries become whole numbers, ``floor(64 * c) + 1000000``. The components are
fitted on the list of distinct vectors, stored once in blocks; the covariance matrix is never formed. A product with it
is one pass over the blocks: each is centred exactly (whole part and fraction of the mean apart), multiplied by a few
vectors at once and by itself, and the tasks' sums are added in the order of their numbers.

From a random start, each step takes the best approximations within a subspace (Rayleigh-Ritz), locks those whose
residual has come down to rounding error, in the order of their eigenvalues, and solves for each other one the
projected correction equation by a few iterations of MINRES, all in the same passes. The corrections widen the
subspace, which is cut back to its best part when it gets large. The driver holds only this subspace.

Components without variance (fewer distinct vectors than dimensions, constant entries) are left out, so a list of
one vector gives no rows, nor does an empty table. Repeated rows and ids each get their rows, null ids too. Entries
beyond 2**40 / 64 in size are cut there; a deviation beyond a long is null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import give_back, stored

COMPONENTS = 16
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 40
#: Vectors of a stored block.
BLOCK = 4096
#: Iterations of MINRES in a step, and steps without the last residual going down that end the search.
INNER, STEPS = 5, 200
#: The subspace is cut back from so many times the wanted components to so many.
WIDE, NARROW = 8, 3
#: From so many tasks on their sums are added by tasks first.
SUMS = 256
Product = Callable[[np.ndarray], np.ndarray]


def vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and the whole numbers x of the vectors that count."""
    c = F.transform(column, lambda e: e.cast("double"))
    whole = F.transform(c, lambda e: F.greatest(F.least(F.floor(e * SCALE), F.lit(MOST)), F.lit(-MOST)) + SHIFT)
    finite = ~F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.where(F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(column) > 0)).select("vec_id", whole.alias("x"))


def of_one_length(x: DataFrame) -> tuple[DataFrame, int]:
    found = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = found.d if found else 0
    return x.where(F.size("x") == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


@dataclass
class FitList:
    """Blocks of vectors of length d, and the tasks that read them."""

    blocks: DataFrame
    d: int
    tasks: int


def fit_list(x: DataFrame, d: int) -> FitList:
    """Each distinct vector once, packed into blocks: data (64-bit integers) and their sums. Stored."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            m = np.concatenate(parts)
            # entries are below 2**41, so a block's sums are exact
            return pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()), pa.array([m.sum(0).tolist()], pa.list_(pa.int64())), pa.array([len(m)], pa.int64())], ["data", "sums", "n"])

        held: list[np.ndarray] = []
        for b in batches:
            m = _matrix(b.column(0), d)
            for k in range(0, len(m), BLOCK):
                held.append(m[k : k + BLOCK])
                if sum(map(len, held)) >= BLOCK:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)
        give_back()

    blocks = stored(x.select("x").distinct().mapInArrow(each, "data binary, sums array<bigint>, n bigint"), "fit-list")
    return FitList(blocks, d, blocks.rdd.getNumPartitions())


@dataclass
class Centre:
    """The mean of n vectors: whole parts, and what is left of n times the mean."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of the squares of n * x - S, exact."""
        y = x - self.whole
        if len(y) and x.shape[1] * (self.n * (int(np.abs(y).max()) + 1)) ** 2 < 1 << 63:
            return ((self.n * y - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, self.rest)) for row in y]
        return [v if v < 1 << 63 else None for v in exact]


def centre_of(fit: FitList) -> Centre:
    rows = fit.blocks.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    n = int(rows[0].n)
    sums = [0] * fit.d
    for r in rows:
        sums[r.i] = int(r.s)
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def summed(fit: FitList, shape: tuple[int, ...], of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of what ``of_block`` makes of each, one pass; the same from run to run."""

    d = fit.d

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for b in batches:
            for data in b.column(0):
                total += of_block(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, d))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def together(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(shape)
        for t in b.sort_values("part").total:
            total += np.frombuffer(t).reshape(shape)
        return pd.DataFrame({"part": [key[0]], "total": [total.tobytes()]})

    rows = fit.blocks.select("data").mapInArrow(each, "part int, total binary")
    if fit.tasks > SUMS:
        rows = rows.groupBy((F.col("part") % 64).alias("slot")).applyInPandas(together, "part int, total binary")
    total = np.zeros(shape)
    for r in sorted(rows.collect()):  # a few kilobytes a task
        total += np.frombuffer(r.total).reshape(shape)
    return total


def minres(product: Product, b: np.ndarray, iterations: int) -> np.ndarray:
    """Approximate solutions x of A x = b, for each column an own symmetric A; ``product`` takes all columns at once."""
    norm = lambda m: np.sqrt((m * m).sum(0))
    x, r1, r2, y = np.zeros_like(b), b, b, b
    beta = norm(b)
    old, dbar, eps, phi, cs, sn = np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), beta, -np.ones_like(beta), np.zeros_like(beta)
    w = w2 = np.zeros_like(b)
    least = np.finfo(float).tiny
    first = np.maximum(beta, least)
    for k in range(iterations):
        live = beta > 1e-15 * first
        if not live.any():
            break
        safe = np.where(live, beta, 1)
        v = np.where(live, y / safe, 0)
        y = product(v)
        if k:
            y = y - (beta / old) * r1
        alpha = (v * y).sum(0)
        y = y - (alpha / safe) * r2
        r1, r2, old, beta = r2, y, safe, norm(y)
        old_eps, delta, gbar = eps, cs * dbar + sn * alpha, sn * dbar - cs * alpha
        eps, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.sqrt(gbar**2 + beta**2), least)
        cs, sn = gbar / gamma, beta / gamma
        step, phi = cs * phi, sn * phi
        w1, w2 = w2, w
        w = np.where(live, (v - old_eps * w1 - delta * w2) / gamma, 0)
        x = x + np.where(live, step * w, 0)
        beta = np.where(live, beta, 0)
    return x


def _beside(t: np.ndarray, z: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``t`` adds to the orthonormal ``z``."""
    size = np.sqrt((t * t).sum(0))
    t = t[:, size > 0] / size[size > 0]
    for _ in range(2):
        t = t - z @ (z.T @ t)
    q, r = np.linalg.qr(t)
    q = q[:, np.abs(np.diag(r)) > 1e-10] if len(q) else q
    for _ in range(2):
        q = q - z @ (z.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def leading(product: Product, d: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric d x d operator ``product``."""
    k = min(k, d)
    random = np.random.default_rng(seed)
    q = np.linalg.qr(random.standard_normal((d, min(d, 2 * k))))[0]
    w = product(q)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    largest, best, since = 0.0, np.inf, 0
    for _ in range(STEPS):
        h = q.T @ w
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        q, w = q @ y, w @ y
        want = k - len(values)
        x, t = q[:, :want], theta[:want]
        residual = w[:, :want] - x * t
        residual = residual - locked @ (locked.T @ residual)
        size = np.sqrt((residual**2).sum(0))
        largest = max(largest, abs(theta[0]), values.max(initial=0.0))
        enough = 8 * np.sqrt(d) * np.finfo(float).eps * largest
        whole = q.shape[1] + len(values) >= d  # the subspace is all there is
        # what has stopped going down near rounding error is as good as it gets
        worst = size.max(initial=0.0)
        since, best = (0, worst) if worst < best / 2 else (since + 1, best)
        done = (size <= enough) | whole | ((since >= 3) & (size <= 100 * enough))
        n = len(done) if done.all() else int(np.argmin(done))
        if n:
            locked, values = np.hstack([locked, x[:, :n]]), np.append(values, t[:n])
            q, w, x, t, residual = q[:, n:], w[:, n:], x[:, n:], t[n:], residual[:, n:]
            best, since = np.inf, 0
        if len(values) >= k:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if q.shape[1] > (WIDE - 1) * k:
            q, w = q[:, : NARROW * k], w[:, : NARROW * k]
        z = np.hstack([locked, x])
        inside = lambda m: m - z @ (z.T @ m)  # noqa: B023, E731
        new = minres(lambda m: inside(product(inside(m)) - inside(m) * t), -inside(residual), INNER)  # noqa: B023
        base = np.hstack([locked, q])
        new = _beside(new, base)
        if not new.shape[1]:  # nothing new: another random direction
            new = _beside(random.standard_normal((d, 1)), base)
        q, w = np.hstack([q, new]), np.hstack([w, product(new)])
    raise RuntimeError(f"{k - len(values)} of {k} components didn't settle in {STEPS} steps")


@dataclass
class Model:
    d: int
    centre: Centre | None
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(x: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Model]:
    """``x`` (vec_id, x) cut to one length, and its components."""
    x, d = of_one_length(x)
    none = Model(d, None, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0)
    if not d:
        return x, none
    distinct = fit_list(x, d)
    centre = centre_of(distinct)
    n = centre.n
    trace = float(summed(distinct, (1,), lambda m: (centre.centred(m) ** 2).sum(keepdims=True)[0])[0]) / n
    if not trace:
        return x, none

    def product(t: np.ndarray) -> np.ndarray:
        def of_block(m: np.ndarray) -> np.ndarray:
            c = centre.centred(m)
            return c.T @ (c @ t)

        return summed(distinct, t.shape, of_block) / n

    values, found = leading(product, d, components)
    some = values > 64 * d * np.finfo(float).eps * values.max()
    values, found = values[some], found[:, some]
    scaled = found / np.sqrt(values)
    mean = summed(distinct, values.shape, lambda m: (centre.centred(m) @ scaled).sum(0)) / n

    def spread(m: np.ndarray) -> np.ndarray:
        z = centre.centred(m) @ scaled - mean
        return z.T @ z

    covariance = summed(distinct, (len(values), len(values)), spread) / n
    return x, Model(d, centre, values, found, values / trace, float(np.abs(covariance - np.eye(len(values))).max()))


def whitened(x: DataFrame, model: Model) -> DataFrame:
    """For each row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, scaled = len(model.values), model.scaled
        for b in batches:
            for at in range(0, len(b), BLOCK):
                own = b.slice(at, BLOCK)
                m = _matrix(own.column(1), model.d)
                n = len(m)
                index = pa.array(np.repeat(np.arange(n), k))
                deviation = pa.array(model.centre.deviations(m), pa.int64())
                columns = [
                    own.column(0).take(index), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.centre.n, np.int64)), deviation.take(index),
                    pa.array((model.centre.centred(m) @ scaled).ravel()), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    schema = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    names = [c.split()[0] for c in schema.split(", ")]
    if not len(model.values):
        return x.limit(0).select("vec_id", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")[1:]))
    return x.mapInArrow(each, schema)


def whiten(rows: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    return whitened(*fit(vectors(rows, column), components))
