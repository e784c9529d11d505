"""A network with a shared trunk, an outcome head for each arm and a propensity head, trained where the rows are.

The rows stay in the tasks of one barrier stage; in every step the tasks add up the gradients of their share of the batch and
take the same step of AdamW. A row's batch in an epoch comes from a hash of its id, so batches are the same however rows are
partitioned, and weights agree up to the rounding of sums. An epoch has at most `most_steps` steps: beyond, batches grow.

Trunk of two ELU layers, heads of an ELU layer of half the width, propensity by one linear layer. The loss is the mean
log loss of the row's own arm plus that of the treatment. Training stops when the loss on the validation rows has not
fallen for `patience` epochs; the best weights are kept. Without validation rows a hash picks 15 % of the rows for it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..shipping import ship
from ..sources.scratch import settled
from .together import Peers, in_tasks
from .validate import check_range, check_whole, require

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Net:
    width: int = 128
    epochs: int = 100
    batch: int = 512
    step: float = 1e-3
    decay: float = 1e-4
    patience: int = 12
    seed: int = 42
    most_steps: int = 1024

    def check(self) -> None:
        for name, least in (("width", 2), ("epochs", 1), ("batch", 1), ("patience", 1), ("seed", 0), ("most_steps", 1)):
            check_whole(name, getattr(self, name), least)
        check_range("step", self.step, 1e-300, 1e300)
        check_range("decay", self.decay, 0, 1e300)


def first_weights(d: int, net: Net) -> Weights:
    draw = np.random.default_rng(net.seed)
    shapes = {"w1": (d, net.width), "w2": (net.width, net.width), "g0": (net.width, net.width // 2), "g1": (net.width, net.width // 2), "v0": (net.width // 2, 1), "v1": (net.width // 2, 1), "e": (net.width, 1)}
    out = {}
    for name, (rows, columns) in shapes.items():
        reach = max(rows, 1) ** -0.5
        out[name], out[f"{name}b"] = draw.uniform(-reach, reach, (rows, columns)), draw.uniform(-reach, reach, columns)
    return out


def elu(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.expm1(np.minimum(z, 0))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def forward(w: Weights, x: np.ndarray) -> dict[str, np.ndarray]:
    a = {"x": x}
    for name, below in (("w1", "x"), ("w2", "w1"), ("g0", "w2"), ("g1", "w2")):
        a[name] = elu(a[below] @ w[name] + w[f"{name}b"])
    for name, below in (("v0", "g0"), ("v1", "g1"), ("e", "w2")):
        a[name] = (a[below] @ w[name] + w[f"{name}b"])[:, 0]
    return a


def losses(a: dict[str, np.ndarray], t: np.ndarray, y: np.ndarray) -> float:
    """The sum over the rows."""
    return loss_of(np.where(t > 0.5, a["v1"], a["v0"]), a["e"], t, y)


def loss_of(own: np.ndarray, e: np.ndarray, t: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, own) - y * own + np.logaddexp(0, e) - t * e).sum())


def shaped(flat: np.ndarray, w: Weights) -> Weights:
    """The parts of `flat` with the names and shapes of `w`."""
    return {k: part.reshape(v.shape) for (k, v), part in zip(w.items(), np.split(flat, np.cumsum([v.size for v in w.values()])[:-1]), strict=True)}


#: Rows that go through the network at once: their layers stay in a core's cache, and nothing but the rows themselves grows with them.
BLOCK = 256


class Room:
    """The layers of one block, their slopes and what goes back through them: memory that every block uses again."""

    def __init__(self, w: Weights):
        wide, half = w["g0"].shape
        self.layers, self.slopes = ({name: np.empty((BLOCK, n)) for name, n in (("w1", wide), ("w2", wide), ("g", half))} for _ in range(2))
        self.back, self.more = np.empty((BLOCK, wide)), np.empty((BLOCK, wide))
        self.zero = np.zeros((BLOCK, wide))  # numpy is slower with a number in its place
        self.products = {name: np.empty(v.shape) for name, v in w.items()}
        self.flat = np.empty(sum(v.size for v in w.values()))
        self.sums = shaped(self.flat, w)

    def layer(self, w: Weights, name: str, below: np.ndarray, at: slice, place: str) -> np.ndarray:
        z, s = self.layers[place][at], self.slopes[place][at]
        np.matmul(below, w[name], out=z)
        z += w[f"{name}b"]
        z -= np.minimum(z, self.zero[at, : z.shape[1]], out=s)
        z += np.expm1(s, out=s)
        s += 1  # the derivative of elu
        return z

    def logits(self, w: Weights, x: np.ndarray, arms: list[slice]) -> tuple[np.ndarray, np.ndarray]:
        """Each row's logit by the head of its own arm, as the other has no part in its loss, and that of the treatment."""
        every = slice(0, len(x))
        top = self.layer(w, "w2", self.layer(w, "w1", x, every, "w1"), every, "w2")
        own = [(self.layer(w, f"g{a}", top[at], at, "g") @ w[f"v{a}"])[:, 0] + w[f"v{a}b"] for a, at in enumerate(arms)]
        return np.concatenate(own), (top @ w["e"])[:, 0] + w["eb"]

    def add(self, g: Weights, name: str, below: np.ndarray, error: np.ndarray) -> None:
        g[name] += np.matmul(below.T, error, out=self.products[name])
        g[f"{name}b"] += error.sum(0)


def blocks(x: np.ndarray, t: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[slice]]]:
    """x, t, y of at most BLOCK rows, control before treated, and where either arm is."""
    order, control = np.argsort(t > 0.5, kind="stable"), np.count_nonzero(t <= 0.5)
    for i in range(0, len(order), BLOCK):
        some = order[i : i + BLOCK]
        n0 = min(max(control - i, 0), len(some))
        yield x[some], t[some], y[some], [slice(0, n0), slice(n0, len(some))]


def total_loss(w: Weights, x: np.ndarray, t: np.ndarray, y: np.ndarray, room: Room | None = None) -> float:
    room = room or Room(w)
    return sum((loss_of(*room.logits(w, xs, arms), ts, ys) for xs, ts, ys, arms in blocks(x, t, y)), 0.0)


def gradients(w: Weights, x: np.ndarray, t: np.ndarray, y: np.ndarray, room: Room | None = None) -> Weights:
    """Of the summed loss. What is returned lies in `room`, until its next use."""
    room = room or Room(w)
    room.flat[:], g = 0, room.sums
    for xs, ts, ys, arms in blocks(x, t, y):
        own, e = room.logits(w, xs, arms)
        first, top, inner = (room.layers[k][: len(xs)] for k in ("w1", "w2", "g"))
        back, more = room.back[: len(xs)], room.more[: len(xs)]
        error = (sigmoid(own) - ys)[:, None]
        for a, at in enumerate(arms):
            room.add(g, f"v{a}", inner[at], error[at])
            below = room.slopes["g"][at]
            below *= error[at]
            below *= w[f"v{a}"][:, 0]
            room.add(g, f"g{a}", top[at], below)
            np.matmul(below, w[f"g{a}"].T, out=back[at])
        error = (sigmoid(e) - ts)[:, None]
        room.add(g, "e", top, error)
        back += np.multiply(error, w["e"][:, 0], out=more)
        back *= room.slopes["w2"][: len(xs)]
        room.add(g, "w2", first, back)
        np.matmul(back, w["w2"].T, out=more)
        more *= room.slopes["w1"][: len(xs)]
        room.add(g, "w1", xs, more)
    return g


def adam(flat: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, nth: int, net: Net) -> None:
    """The `nth` step of AdamW, in place."""
    first *= 0.9
    first += 0.1 * g
    second *= 0.999
    second += np.multiply(0.001 * g, g, out=g)
    np.sqrt(np.divide(second, 1 - 0.999**nth, out=g), out=g)
    g += 1e-8
    np.divide(first / (1 - 0.9**nth), g, out=g)
    g += net.decay * flat
    g *= net.step
    flat -= g


def batches_of(u: np.ndarray, epoch: int, n: int) -> np.ndarray:
    """The batch of each row in an epoch, from its uniform."""
    turn = (u * 2**48).astype(np.uint64) * np.uint64(2654435761) + np.uint64(epoch * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    turn = (turn ^ (turn >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((turn ^ (turn >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def train(x: np.ndarray, t: np.ndarray, y: np.ndarray, u: np.ndarray, hold: np.ndarray, net: Net, peers: Peers) -> Weights:
    """The best weights, with centre and spread of the features; every task holds some of the rows."""
    sums = peers.total(np.concatenate([[(~hold).sum()], x[~hold].sum(0), [hold.sum()]]))
    n, centre, n_hold = sums[0], sums[1:-1] / sums[0], sums[-1]
    spread = np.sqrt(peers.total(((x[~hold] - centre) ** 2).sum(0)) / n)
    spread = np.where(spread > 1e-9, spread, 1.0)
    x = (x - centre) / spread
    w = first_weights(x.shape[1], net)
    flat = np.concatenate([v.ravel() for v in w.values()])
    first, second, now = np.zeros_like(flat), np.zeros_like(flat), shaped(flat, w)

    steps = int(max(1, min(net.most_steps, n // net.batch)))
    held, x, t, y, u = (x[hold], t[hold], y[hold]), x[~hold], t[~hold], y[~hold], u[~hold]
    best, stale, nth, room = (np.inf, flat.copy()), 0, 0, Room(w)
    for epoch in range(net.epochs):
        batch = batches_of(u, epoch, steps).astype(np.min_scalar_type(steps))  # numbers of 16 bits are sorted by counting
        order = np.argsort(batch, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(batch, minlength=steps))])
        for b in range(steps):
            some = order[edges[b] : edges[b + 1]]
            gradients(now, x[some], t[some], y[some], room)
            g = peers.total(np.append(room.flat, len(some)))
            if not g[-1]:
                continue
            nth += 1
            adam(flat, g[:-1] / g[-1], first, second, nth, net)
        loss = peers.total(np.array([total_loss(now, *held, room)]))[0] / n_hold
        best, stale = ((loss, flat.copy()), 0) if loss < best[0] - 1e-6 else (best, stale + 1)
        if stale >= net.patience:
            break
    require(np.isfinite(best[0]), "the network found no weights of finite loss")
    return shaped(best[1], w) | {"centre": centre, "spread": spread, "loss": np.array([best[0]]), "epochs": np.array([epoch + 1])}


def fit(rows: DataFrame, columns: list[str], net: Net = Net(), validation: DataFrame | None = None, ident: str = "epk_id", tasks: int | None = None) -> Weights:
    """The weights after training on all `rows` (ident, t, y, columns)."""
    net.check()
    ship(rows.sparkSession)
    u = uniform(ident, f"net{net.seed}")

    def plain(df: DataFrame, hold) -> DataFrame:
        return df.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"), u.alias("u"), hold.alias("hold"))

    table = plain(rows, F.lit(False) if validation is not None else uniform(ident, f"hold{net.seed}") < 0.15)
    table = settled(table if validation is None else table.unionByName(plain(validation, F.lit(True))), "network_rows")
    facts = table.agg(F.count(F.lit(1)).alias("n"), F.count_if("hold").alias("held"), F.count_distinct(F.when(~F.col("hold"), F.col("t"))).alias("arms")).first()
    require(facts["arms"] == 2, "the network needs training rows of both arms")
    require(facts["held"] > 0, "the network needs validation rows")
    d = len(columns)

    def work(peers: Peers, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.zeros((0, d))], [np.zeros(0)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0, bool)]]
        for batch in batches:
            parts[0].append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            for part, name in zip(parts[1:], ("t", "y", "u", "hold"), strict=True):
                part.append(batch.column(name).to_numpy(zero_copy_only=False))
        found = train(*map(np.concatenate, parts), net, peers)
        if peers.rank == 0:  # every task has the same weights
            yield pa.RecordBatch.from_pydict({"weights": [pickle.dumps(found)]})

    return pickle.loads(in_tasks(table, facts["n"], work, "weights binary", tasks).collect()[0][0])


def effect(w: Weights, x: np.ndarray) -> tuple[np.ndarray, ...]:
    a = forward(w, (x - w["centre"]) / w["spread"])
    return (sigmoid(a["v1"]) - sigmoid(a["v0"]),)
