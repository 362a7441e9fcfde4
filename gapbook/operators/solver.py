"""Portfolio weights of universes too wide for one task, from moments in blocks.

The covariance stays in stripes of rows, and returns in blocks of dates; both are tables in the shared
folder, kept in the executors' memory while they are read again. Each step of a method is one job: the
stripes' products with all methods' vectors at once, or the blocks' portfolio returns and the sum of
their worst days. The driver holds what is as long as the universe or the calendar (weights, expected
returns, a portfolio's daily returns), never anything as large as symbols times symbols or dates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapbook.operators import optimizers as opt
from gapbook.sources.scratch import materialise

#: Numbers of a stripe or block.
CELLS = 1 << 21
#: Residual, relative, at which a linear system is solved, and relative change at which the greatest
#: eigenvalue is found.
SOLVED, FOUND = 1e-14, 1e-14

Product = Callable[[np.ndarray], np.ndarray]


class Blocks:
    """Moments of complete returns ``date, symbol, ret``: ``covariance`` has ``a, b, cov`` for a <= b, ``mu``
    a row ``symbol, mu`` for each symbol."""

    def __init__(self, complete: DataFrame, covariance: DataFrame, mu: DataFrame, cells: int = CELLS):
        numbers = complete.select("symbol").distinct().withColumn("i", F.row_number().over(Window.orderBy("symbol")) - 1)
        numbers = materialise(numbers, "solver-symbols")
        dates = complete.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)
        self.spark, self.numbers = complete.sparkSession, numbers
        own = numbers.join(mu, "symbol").orderBy("i").select("mu").toPandas()
        self.mu, self.n = own["mu"].to_numpy(float), len(own)
        self.days = dates.count()
        many = max(1, cells // max(self.n, 1))
        a, b = numbers.select(F.col("symbol").alias("a"), F.col("i").alias("row")), numbers.select(F.col("symbol").alias("b"), F.col("i").alias("col"))
        pairs = covariance.join(a, "a").join(b, "b").select("row", "col", F.col("cov").alias("v"))
        both = pairs.unionByName(pairs.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "v"))
        self.diagonal = pairs.where("row = col").orderBy("row").select("v").toPandas()["v"].to_numpy(float)
        self.stripes = self._blocks(both, many, "covariance-stripes")
        cells_of = complete.join(numbers, "symbol").join(dates, "date").select(F.col("t").alias("row"), F.col("i").alias("col"), F.col("ret").alias("v"))
        self.returns = self._blocks(cells_of, many, "return-blocks")

    def _blocks(self, cells: DataFrame, many: int, tag: str) -> DataFrame:
        """``first, data``: ``many`` whole rows of a matrix, ``row, col, v``, as bytes."""
        width = self.n

        def run(group: pa.Table) -> pa.Table:
            row, col, v = (group.column(c).to_numpy() for c in ("row", "col", "v"))
            first = int(row.min()) // many * many
            block = np.zeros((int(row.max()) - first + 1, width))
            block[row - first, col] = v
            return pa.table({"first": pa.array([first], pa.int64()), "data": pa.array([block.tobytes()], pa.binary())})

        part = F.floor(F.col("row") / many)
        made = materialise(cells.withColumn("part", part).groupBy("part").applyInArrow(run, "first long, data binary"), tag)
        return made.persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.stripes.unpersist()
        self.returns.unpersist()

    def _each(self, blocks: DataFrame, what: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """``what`` of each block of rows, in the order of rows."""
        width = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [what(np.frombuffer(d.as_py()).reshape(-1, width)).tobytes() for d in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["first", "out"])

        rows = blocks.mapInArrow(run, "first long, out binary").collect()
        return np.concatenate([np.frombuffer(r.out) for r in sorted(rows, key=lambda r: r.first)])

    def product(self, w: np.ndarray) -> np.ndarray:
        """The covariance times a vector, or times each column."""
        shared = self.spark.sparkContext.broadcast(w)
        out = self._each(self.stripes, lambda block: np.ascontiguousarray(block @ shared.value))
        shared.destroy()
        return out.reshape(w.shape)

    def portfolio(self, w: np.ndarray) -> np.ndarray:
        """The portfolio's return on each date."""
        shared = self.spark.sparkContext.broadcast(w)
        out = self._each(self.returns, lambda block: block @ shared.value)
        shared.destroy()
        return out

    def mean_of(self, w: np.ndarray, most: float) -> np.ndarray:
        """The mean returns of all symbols on the dates on which the portfolio has ``most`` or less; tasks
        add up their blocks first."""
        width = self.n
        shared = self.spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, days = np.zeros(width), 0
            for batch in batches:
                for d in batch.column(1):
                    block = np.frombuffer(d.as_py()).reshape(-1, width)
                    worst = block @ shared.value <= most
                    total, days = total + block[worst].sum(axis=0), days + int(worst.sum())
            yield pa.RecordBatch.from_arrays([pa.array([days], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["days", "total"])

        rows = self.returns.mapInArrow(run, "days long, total binary").collect()
        shared.destroy()
        return np.sum([np.frombuffer(r.total) for r in rows], axis=0) / sum(r.days for r in rows)


def greatest_eigenvalue(product: Product, n: int) -> float:
    """By Lanczos steps with full orthogonalisation, until the greatest Ritz value stands still."""
    v = 1.0 + 0.1 * np.cos(np.arange(n))
    basis, alphas, betas, tops = [v / np.linalg.norm(v)], [], [], []
    while True:
        w = product(basis[-1])
        alphas.append(float(basis[-1] @ w))
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        t = np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1)
        tops.append(float(np.linalg.eigvalsh(t)[-1]))
        still = len(tops) > 3 and all(abs(x - tops[-1]) <= FOUND * abs(tops[-1]) for x in tops[-4:])
        beta = float(np.linalg.norm(w))
        if still or len(alphas) == n or beta <= 1e-14 * abs(tops[-1]):
            return tops[-1]
        betas.append(beta)
        basis.append(w / beta)


def solved(product: Product, diagonal: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a positive definite system by conjugate gradients, scaled by the diagonal."""
    x, r = np.zeros(len(b)), b.copy()
    z = r / diagonal
    p, rz = z, float(r @ z)
    for _ in range(20 * len(b)):
        if np.linalg.norm(r) <= SOLVED * np.linalg.norm(b):
            break
        q = product(p)
        step = rz / float(p @ q)
        x, r = x + step * p, r - step * q
        z = r / diagonal
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return x


def suite_weights(m: Blocks, s: opt.OptimizerSettings, methods: Sequence[str] = opt.SUITE) -> dict[str, np.ndarray]:
    """The weights of all methods, by the order of symbols: the same steps as in one task, where all methods
    that descend by gradients share each step's job."""
    even, zero = np.full(m.n, 1.0 / m.n), np.zeros(m.n)

    def firm(w: np.ndarray) -> np.ndarray:
        return m.product(w) + opt.JITTER * w

    top = max(greatest_eigenvalue(firm, m.n), opt.TINY)
    out: dict[str, np.ndarray] = {}
    descents: dict[str, tuple[float, np.ndarray]] = {}
    for method in methods:
        if method == "Mean Variance":
            descents[method] = s.risk_aversion, m.mu
        elif method == "Minimum Variance":
            descents[method] = 2.0, zero
        elif method == "Black-Litterman":
            descents[method] = s.bl_risk_aversion, s.bl_prior_risk * m.product(even)
        elif method == "Inverse Volatility":
            out[method] = opt.project_capped(1 / np.sqrt(np.maximum(m.diagonal, 1e-12)), s.cap(method))
        elif method == "CVaR Aware":
            out[method] = _min_cvar(m, s.cvar_alpha, s.cap(method), s.cvar_iterations)
        elif method == "Kelly 50%":
            raw = np.maximum(solved(firm, m.diagonal + opt.JITTER, m.mu), 0.0)
            if raw.sum() > 0:
                out[method] = opt.project_capped(raw, s.cap(method), s.kelly_fraction)
            else:
                out |= _descents(lambda w: firm(w) + opt.JITTER * w, top + opt.JITTER, {method: (2.0, zero)}, s, 750)
        else:
            raise ValueError(f"unknown method {method}")
    return out | _descents(firm, top, descents, s, s.iterations)


def _descents(firm: Product, top: float, given: dict[str, tuple[float, np.ndarray]], s: opt.OptimizerSettings, iterations: int) -> dict[str, np.ndarray]:
    """Projected steps down a / 2 w'Cw - b'w for each method's (a, b), all in one product a step."""
    if not given:
        return {}
    n = len(next(iter(given.values()))[1])
    w = {k: np.full(n, 1.0 / n) for k in given}
    for _ in range(iterations):
        cw = firm(np.stack([*w.values()], axis=1))
        for j, (k, (a, b)) in enumerate(given.items()):
            w[k] = opt.project_capped(w[k] - (a * cw[:, j] - b) / (a * top + opt.TINY), s.cap(k))
    return w


def _min_cvar(m: Blocks, alpha: float, cap: float | None, iterations: int) -> np.ndarray:
    place = (1 - alpha) * (m.days - 1)
    below, part = int(place), place - int(place)
    ranks = [below, min(below + 1, m.days - 1)]
    w = opt.project_capped(1 / np.sqrt(np.maximum(m.diagonal, 1e-12)), cap)
    for k in range(1, iterations + 1):
        low, high = np.partition(m.portfolio(w), ranks)[ranks]
        w = opt.project_capped(w + 0.15 / np.sqrt(k) * m.mean_of(w, low + part * (high - low)), cap)
    return w
