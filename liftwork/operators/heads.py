"""A small head tuned on sampled episodes over a frozen representation: the nearest-neighbour stand-in's.

The representation of a row under an arm is read off the outcomes of its nearest context rows of that arm: their mean, how
the nearest quarter and the nearest sixteenth of them depart from it, and how the arm's mean departs from it. It has no weights
to train. The head is linear on it, one for each arm, and starts at the mean itself, that is at the untuned stand-in.

An episode is a context and queries, drawn apart from each other from a pool of labelled rows; every treatment and
outcome stratum that the pool has is in each context. Queries are compared with the smoothed doubly robust labels of both
potential outcomes. As nothing below the head moves, the representations of all episodes of all epochs are made in
parallel, a task for each few episodes, and only the head's steps follow each other: on the driver, over at most
(epochs * tasks + validation_tasks) * queries rows of ten numbers. Early stopping goes by fixed episodes whose queries are
held out of training.

The pool has at most `pool` rows (a parameter, one of each stratum and then the least hashes of the id) and is broadcast;
labels are learned from all rows, and scoring looks for neighbours among all training rows. Defined cases: a pool
without both arms, or too small for a context with every stratum, raises; ties in distance go to the smaller id; tables
without rows are scored to tables without rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..shipping import ship
from ..sources.scratch import settled
from .learners import Fitted, Trees, potential_outcome_labels
from .neighbours import distances, nearest_means
from .splits import context_sample
from .validate import check_range, check_whole, require

#: Of k neighbours, those whose means make the representation.
DEPTHS = (1, 4, 16)
#: The representation of one arm: its mean, then what the head weighs beside a constant.
WIDTH = len(DEPTHS) + 1


@dataclass(frozen=True)
class Episodes:
    epochs: int = 10
    tasks: int = 8
    validation_tasks: int = 4
    context: int = 1024
    queries: int = 256
    held: float = 0.2
    step: float = 1e-2
    decay: float = 1e-4
    most_gradient: float = 1.0
    patience: int = 3
    pool: int = 20_000
    seed: int = 42

    def check(self) -> None:
        for name, least in (("epochs", 1), ("tasks", 1), ("validation_tasks", 1), ("context", 4), ("queries", 1), ("patience", 1), ("pool", 8), ("seed", 0)):
            check_whole(name, getattr(self, name), least)
        check_range("step", self.step, 1e-300, 1e300)
        check_range("decay", self.decay, 0, 1e300)
        check_range("most_gradient", self.most_gradient, 1e-300, 1e300)
        require(0 < self.held < 0.5, "the held share lies between 0 and 0.5")


def depths(k: int) -> list[int]:
    return [max(1, k // d) for d in DEPTHS]


def representation(near: np.ndarray, mean: float) -> np.ndarray:
    """Of rows with the outcomes of their k nearest in order, in an arm of that mean outcome."""
    base, *closer = (near[:, :n].mean(1) for n in depths(near.shape[1]))
    return np.stack([base, *(c - base for c in closer), mean - base], 1)


def strata(t: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The places of each treatment and outcome stratum that occurs."""
    found = (np.flatnonzero((t == a) & (y == b)) for a in (0, 1) for b in (0, 1))
    return [f for f in found if len(f)]


def held_out(t: np.ndarray, y: np.ndarray, share: float, draw: np.random.Generator) -> np.ndarray:
    """Which rows are held out: the rounded share of each stratum, and never the whole of it."""
    out = np.zeros(len(t), bool)
    for places in strata(t, y):
        n = min(int(len(places) * share + 0.5), len(places) - 1)
        out[draw.permutation(places)[:n]] = True
    return out


def context_of(places: np.ndarray, t: np.ndarray, y: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """n of the places, ascending, at least one of each stratum among them."""
    groups = [places[g] for g in strata(t[places], y[places])]
    require(len({int(t[g[0]]) for g in groups}) == 2, "the context lacks an arm")
    require(n >= len(groups), "the context is too small for every stratum")
    forced = np.array([draw.choice(g) for g in groups])
    rest = np.setdiff1d(places, forced)
    return np.sort(np.append(forced, draw.choice(rest, min(n - len(forced), len(rest)), replace=False)))


class Pool:
    """The labelled rows that episodes draw from, by ascending id."""

    def __init__(self, rows: pd.DataFrame, columns: list[str], s: Episodes, neighbours: int):
        rows = rows.sort_values("epk_id")
        self.x, self.t, self.y = rows[columns].to_numpy(float), rows["t"].to_numpy(int), rows["y"].to_numpy(float)
        self.labels, self.s, self.k = rows[["label0", "label1"]].to_numpy(float), s, neighbours
        self.hold = held_out(self.t, self.y, s.held, np.random.default_rng([s.seed, 97]))
        n = int((~self.hold).sum())
        require(n >= 8 and self.hold.sum() >= 2, "too few rows for episodes")
        self.queries = min(s.queries, max(1, n // 4))
        self.context = min(s.context, n - self.queries)

    def episode(self, nth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places of the context, of the queries, the queries' representations of both arms, their labels); the last `validation_tasks` ask the held rows."""
        draw, train = np.random.default_rng([self.s.seed, 211, nth]), np.flatnonzero(~self.hold)
        if nth >= self.s.epochs * self.s.tasks:
            asked = np.flatnonzero(self.hold)
            asked = np.sort(draw.choice(asked, min(self.s.queries, len(asked)), replace=False))
        else:  # a row that is alone in its stratum stays in the contexts
            alone = [g[0] for g in strata(self.t[train], self.y[train]) if len(g) == 1]
            asked = np.sort(draw.choice(np.delete(train, alone), self.queries, replace=False))
            train = np.setdiff1d(train, asked)
        context = context_of(train, self.t, self.y, self.context, draw)
        arms = [context[self.t[context] == a] for a in (0, 1)]
        k = max(1, min(self.k, *map(len, arms), len(context) // 2))
        parts = []
        for own in arms:
            order = np.argsort(distances(self.x[asked], self.x[own]), 1, kind="stable")[:, :k]
            parts.append(representation(self.y[own][order], self.y[own].mean()))
        return context, asked, np.concatenate(parts, 1), self.labels[asked]


def made_episodes(pool: Pool, labelled: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(representations, labels) of each episode, made in tasks."""
    spark, n = labelled.sparkSession, pool.s.epochs * pool.s.tasks + pool.s.validation_tasks
    ship(spark)
    shared = spark.sparkContext.broadcast(pool)

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for nth in part["id"].tolist():
                _, asked, seen, labels = shared.value.episode(nth)
                yield pd.DataFrame({"episode": nth, "place": asked, "seen": list(seen), "labels": list(labels)})

    found = spark.range(0, n, 1, min(n, spark.sparkContext.defaultParallelism)).mapInPandas(make, "episode long, place long, seen array<double>, labels array<double>").toPandas()
    parts = {e: rows.sort_values("place") for e, rows in found.groupby("episode")}
    return {e: (np.array(rows["seen"].tolist()), np.array(rows["labels"].tolist())) for e, rows in parts.items()}


def outcomes(w: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Both outcome means under the head w, whose row of an arm is a constant and a weight for each departure."""
    arms = seen.reshape(len(seen), 2, WIDTH)
    return arms[:, :, 0] + w[:, 0] + (arms[:, :, 1:] * w[:, 1:]).sum(2)


def loss(w: np.ndarray, seen: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """(mean squared distance to the labels of both arms, its gradient)."""
    gap = outcomes(w, seen) - labels
    arms = seen.reshape(len(seen), 2, WIDTH)
    inner = np.concatenate([np.ones((len(seen), 2, 1)), arms[:, :, 1:]], 2)
    return float((gap**2).mean()), (gap[:, :, None] * inner).sum(0) / len(seen)


def tuned_head(made: dict[int, tuple[np.ndarray, np.ndarray]], s: Episodes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(the head of the least validation loss, the training and validation loss of each epoch run)."""
    checks = [made[s.epochs * s.tasks + i] for i in range(s.validation_tasks)]
    w, first, second, nth = np.zeros((2, WIDTH)), 0.0, 0.0, 0
    best, stale, history = (np.inf, w), 0, []
    for epoch in range(s.epochs):
        losses = []
        for i in range(s.tasks):
            value, g = loss(w, *made[epoch * s.tasks + i])
            require(np.isfinite(value), "the head has no finite loss")
            losses.append(value)
            g, nth = g * min(1.0, s.most_gradient / max(float(np.linalg.norm(g)), 1e-300)), nth + 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - s.step * (s.decay * w + first / (1 - 0.9**nth) / (np.sqrt(second / (1 - 0.999**nth)) + 1e-8))
        history.append((float(np.mean(losses)), float(np.mean([loss(w, *c)[0] for c in checks]))))
        best, stale = ((history[-1][1], w), 0) if history[-1][1] < best[0] - 1e-6 else (best, stale + 1)
        if stale >= s.patience:
            break
    return best[1], history


def with_outcomes(df: DataFrame, have: DataFrame, columns: list[str], k: int, means: dict[int, float], w: np.ndarray) -> DataFrame:
    """`df` with mu0 and mu1 under the head, from the k nearest of each arm among all rows of `have`; rows are known by epk_id."""
    seen = nearest_means(df, have, columns, k, "t", depths(k))

    def mean(a: int):
        base, *closer = (F.col(f"mean_{a}_{n}") for n in depths(k))
        departs = [*(c - base for c in closer), F.lit(means[a]) - base]
        return clip(base + float(w[a, 0]) + sum((float(v) * d for v, d in zip(w[a, 1:], departs, strict=True)), F.lit(0.0)), 0.0, 1.0)

    return seen.select(*df.columns, mean(0).alias("mu0"), mean(1).alias("mu1"))


def tuned_stand_in(train: DataFrame, columns: list[str], neighbours: int = 64, episodes: Episodes = Episodes(), trees: Trees = Trees(rounds=100), folds: int = 5, low: float = 0.02, labels: Callable[[DataFrame], DataFrame] | None = None) -> Fitted:
    """The stand-in with a head tuned on episodes. Adds cate, mu0 and mu1.

    train: epk_id, t, y, features and columns. labels: another way to add label0 and label1 than `potential_outcome_labels`.
    """
    check_whole("neighbours", neighbours, 1)
    episodes.check()
    facts = {r["t"]: (r["n"], r["m"]) for r in train.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("m")).collect()}
    require(len(facts) == 2, "the context lacks an arm")
    labelled = settled((labels or (lambda rows: potential_outcome_labels(rows, trees, folds, low)))(train).select("epk_id", "t", "y", *columns, "label0", "label1"), "labelled")
    pool = Pool(context_sample(labelled, episodes.pool, f"pool{episodes.seed}").toPandas(), columns, episodes, neighbours)  # `pool` rows at most
    w, history = tuned_head(made_episodes(pool, labelled), episodes)
    k, have = min(neighbours, *(n for n, _ in facts.values())), train.select("epk_id", "t", "y", *columns)
    settings = vars(episodes) | {"neighbours": k, "folds": folds, "low": low, "pool_used": len(pool.t), "context_used": pool.context, "queries_used": pool.queries}
    settings |= {"epochs_used": len(history), "history": history, "validation_loss": min(v for _, v in history), "head": w.tolist(), "head_shift": float(np.linalg.norm(w)), "trainable": w.size}

    def add(df: DataFrame) -> DataFrame:
        return with_outcomes(df, have, columns, k, {a: m for a, (_, m) in facts.items()}, w).withColumn("cate", F.col("mu1") - F.col("mu0"))

    return Fitted("tuned_stand_in", add, settings)
