"""Gaussian processes with a squared exponential kernel, a constant and white noise, one for each arm.

Scale, length and noise climb the marginal likelihood by its gradient from several starts, inside fixed bounds, on a capped
sample of the arm; every start of every arm is a task of its own. An arm within its cap has the exact posterior. Beyond, the sample's
first `inducing` rows stand for the function, and the statistics that join them to the outcomes are sums over all rows
of the arm, added up between tasks, so no row is left out.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.scratch import settled
from .splits import per_arm_cap
from .together import Peers, in_tasks
from .validate import check_whole, require

#: Bounds of scale, length and noise.
BOUNDS = np.log(np.array([[1e-3, 1e3], [1e-2, 1e4], [1e-6, 1e1]]))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def kernel(a: np.ndarray, b: np.ndarray, scale: float, length: float) -> np.ndarray:
    return scale * np.exp(-squares(a, b) / (2 * length * length))


def likelihood(theta: np.ndarray, d2: np.ndarray, z: np.ndarray, jitter: float) -> tuple[float, np.ndarray]:
    """Log marginal likelihood of the outcomes z and its gradient by the logs of scale, length and noise."""
    scale, length, noise = np.exp(theta)
    k = scale * np.exp(-d2 / (2 * length * length))
    try:
        chol = np.linalg.cholesky(k + (noise + jitter) * np.eye(len(z)))
    except np.linalg.LinAlgError:
        return -np.inf, np.zeros(3)
    inverse = np.linalg.inv(chol)
    inverse = inverse.T @ inverse
    alpha = inverse @ z
    value = -0.5 * z @ alpha - np.log(np.diag(chol)).sum() - 0.5 * len(z) * math.log(2 * math.pi)
    outer = np.outer(alpha, alpha) - inverse
    return value, 0.5 * np.array([(outer * k).sum(), (outer * k * d2).sum() / (length * length), noise * np.trace(outer)])


def climb(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, bounds: np.ndarray, most: int = 60) -> tuple[float, np.ndarray]:
    """A local maximum of f (value, gradient) inside the bounds, by quasi-Newton steps that are cut at them."""
    at = np.clip(start, *bounds.T)
    value, g = f(at)
    inverse = np.eye(len(at)) / max(1.0, np.abs(g).max())
    for _ in range(most):
        free = ~(((at <= bounds[:, 0]) & (g < 0)) | ((at >= bounds[:, 1]) & (g > 0)))
        if np.abs(g[free]).max(initial=0) < 1e-5 * max(1, abs(value)):
            break
        way = np.where(free, inverse @ np.where(free, g, 0), 0)
        if way @ g <= 0:
            inverse, way = np.eye(len(at)) / max(1.0, np.abs(g).max()), np.where(free, g, 0) / max(1.0, np.abs(g).max())
        size = 1.0
        while size > 1e-8:
            there = np.clip(at + size * way, *bounds.T)
            new, new_g = f(there)
            if new > value + 1e-4 * g @ (there - at) and new > value:
                break
            size /= 2
        else:
            break
        s, y = there - at, g - new_g
        if s @ y > 1e-12:
            left = np.eye(len(at)) - np.outer(s, y) / (s @ y)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ y)
        done = new - value < 1e-9 * max(1, abs(value))
        at, value, g = there, new, new_g
        if done:
            break
    return value, at


def starts(x: np.ndarray, restarts: int, seed: int) -> list[np.ndarray]:
    spread = float(np.mean(np.std(x, axis=0))) if x.shape[1] else 1.0
    draw = np.random.default_rng(seed)
    return [np.log([1.0, max(spread * math.sqrt(x.shape[1]), 1e-3), 0.1]), *(draw.uniform(*BOUNDS.T) for _ in range(restarts))]


def normal(y: np.ndarray) -> tuple[float, float]:
    return float(y.mean()), float(y.std()) or 1.0


class Posterior:
    """Mean and variance of a process at new points: k(x, points) against weights, less and plus squared factors."""

    def __init__(self, points: np.ndarray, theta: np.ndarray, mean: float, spread: float, weights: np.ndarray, less: np.ndarray, plus: np.ndarray | None = None):
        self.points, self.theta, self.mean, self.spread = points, theta, mean, spread
        self.weights, self.less, self.plus = weights, less, plus

    @classmethod
    def exact(cls, x: np.ndarray, y: np.ndarray, theta: np.ndarray, jitter: float) -> Posterior:
        scale, length, noise = np.exp(theta)
        mean, spread = normal(y)
        inverse = np.linalg.inv(np.linalg.cholesky(kernel(x, x, scale, length) + (noise + jitter) * np.eye(len(x))))
        return cls(x, theta, mean, spread, inverse.T @ (inverse @ ((y - mean) / spread)), inverse)

    @classmethod
    def induced(cls, points: np.ndarray, theta: np.ndarray, mean: float, spread: float, both: np.ndarray, with_y: np.ndarray, jitter: float) -> Posterior:
        """From the sums of k k' and k y over all rows, k being a row's kernel with the points."""
        scale, length, noise = np.exp(theta)
        own = kernel(points, points, scale, length) + (jitter + 1e-8 * scale) * np.eye(len(points))
        less = np.linalg.inv(np.linalg.cholesky(own))
        plus = np.linalg.inv(np.linalg.cholesky(own + both / (noise + jitter)))
        return cls(points, theta, mean, spread, plus.T @ (plus @ with_y) / (noise + jitter), less, plus)

    def at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale, length, _ = np.exp(self.theta)
        mean, var = np.empty(len(x)), np.empty(len(x))
        for low in range(0, len(x), 2048):
            k = kernel(x[low : low + 2048], self.points, scale, length)
            mean[low : low + 2048] = k @ self.weights
            v = scale - ((self.less @ k.T) ** 2).sum(0)
            var[low : low + 2048] = v if self.plus is None else v + ((self.plus @ k.T) ** 2).sum(0)
        return self.mean + self.spread * mean, self.spread**2 * np.maximum(var, 0)


def sums_over_rows(rows: DataFrame, points: dict[int, np.ndarray], theta: dict[int, np.ndarray], scaled: dict[int, tuple[float, float]], n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sums of k k' and k y over the rows (t, y, x) of each arm in `points`."""
    shared = rows.sparkSession.sparkContext.broadcast((points, theta, scaled))

    def work(peers: Peers, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, how, scale = shared.value
        both, with_y = ({a: np.zeros((len(u), len(u)) if square else len(u)) for a, u in at.items()} for square in (True, False))
        for batch in batches:
            t, y, x = batch.column("t").to_numpy(), batch.column("y").to_numpy(), np.array(batch.column("x").to_pylist(), float)
            for a, u in at.items():
                own = t == a
                k = kernel(x[own].reshape(-1, u.shape[1]), u, *np.exp(how[a][:2]))
                both[a] += k.T @ k
                with_y[a] += k.T @ ((y[own] - scale[a][0]) / scale[a][1])
        found = {a: (peers.total(both[a]), peers.total(with_y[a])) for a in sorted(at)}
        if peers.rank == 0:
            yield pa.RecordBatch.from_pydict({"sums": [pickle.dumps(found)]})

    return pickle.loads(in_tasks(rows, n, work, "sums binary").collect()[0][0])


def fit(rows: DataFrame, caps: dict[int, int], restarts: int = 1, inducing: int = 512, jitter: float = 1e-6, seed: int = 0) -> dict[int, Posterior]:
    """A posterior for each arm from `rows` (epk_id, t, y, x)."""
    check_whole("restarts", restarts, 0)
    check_whole("inducing", inducing, 2)
    ship(rows.sparkSession)
    table = settled(rows.select("epk_id", F.col("t").cast("int").alias("t"), F.col("y").cast("double").alias("y"), "x"), "gp_rows")
    facts = {r["t"]: r for r in table.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).collect()}
    require(all(a in facts and facts[a]["n"] > 1 for a in (0, 1)), "gp_cate needs at least two rows in each treatment arm")
    sample = settled(per_arm_cap(table, caps, f"gp{seed}"), "gp_sample")

    def tune(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("epk_id")
        x, y = np.array(part["x"].tolist(), float), part["y"].to_numpy()
        mean, spread = normal(y)
        z, d2 = (y - mean) / spread, squares(x, x)
        value, theta = climb(lambda at: likelihood(at, d2, z, jitter), starts(x, restarts, seed + int(key[0]))[int(key[1])], BOUNDS)
        return pd.DataFrame({"t": [key[0]], "value": [value], "theta": [theta.tolist()]})

    each = sample.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(restarts)))).repartition(2 * (restarts + 1), "t", "start")
    tuned = each.groupBy("t", "start").applyInPandas(tune, "t int, value double, theta array<double>").collect()
    theta = {a: np.array(max((r for r in tuned if r["t"] == a), key=lambda r: r["value"])["theta"]) for a in (0, 1)}
    seen = sample.orderBy("t", F.xxhash64("epk_id")).toPandas()  # the caps bound it
    own = {a: seen[seen["t"] == a] for a in (0, 1)}
    out, many = {}, [a for a in (0, 1) if facts[a]["n"] > caps[a]]
    for a in set(own).difference(many):
        out[a] = Posterior.exact(np.array(own[a]["x"].tolist(), float), own[a]["y"].to_numpy(), theta[a], jitter)
    if many:
        points = {a: np.array(own[a]["x"].tolist(), float)[:inducing] for a in many}
        scaled = {a: (facts[a]["m"], facts[a]["s"] or 1.0) for a in many}
        sums = sums_over_rows(table.filter(F.col("t").isin(many)).select("t", "y", "x"), points, theta, scaled, sum(facts[a]["n"] for a in many))
        for a in many:
            out[a] = Posterior.induced(points[a], theta[a], *scaled[a], *sums[a], jitter)
    return out


def effect(arms: dict[int, Posterior], x: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean difference of the arms and its interval at the level."""
    (m0, v0), (m1, v1) = (arms[a].at(x) for a in (0, 1))
    half = NormalDist().inv_cdf(0.5 + level / 2) * np.sqrt(v0 + v1)
    return m1 - m0, m1 - m0 - half, m1 - m0 + half
