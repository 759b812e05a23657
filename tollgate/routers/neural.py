"""Neural policies, trained data-parallel with averaged weights.

The train rows are packed once into shards, by a hash of their contents, so that the
result does not hang on the partitioning. Their number is fixed until a shard would hold
more than ``SHARD_VALUES`` values; larger tables get more shards, not larger ones.
In every round each shard continues from the common weights with its own minibatches;
the weights (and the optimiser's moments) are then averaged over the rows of the shards.
One shard makes this plain minibatch training. The net itself is a few numpy
lines; Spark spreads the shards and adds the weights up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tollgate.routers.linear import with_predictions
from tollgate.session import fits_broadcast, written

# Shards of the train rows unless a training says otherwise.
SHARDS = 8

# Features and targets that one task holds at a time; more shards are made beyond.
SHARD_VALUES = 1 << 23

# Weights travel in pieces of this length, so that many tasks add them up.
_PIECE = 16_384

# Fixed values of the Adam optimiser.
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Net:
    """Layer widths; ``relu[i]`` tells whether layer i ends in a ReLU.

    The output holds ``heads`` groups of equal width; the loss adds up the mean
    squared error of each group over its known targets.
    """

    widths: tuple[int, ...]
    relu: tuple[bool, ...]
    heads: int = 1
    small_last: bool = False

    @property
    def shapes(self) -> list[tuple[int, int]]:
        return list(zip(self.widths, self.widths[1:]))

    @property
    def size(self) -> int:
        return sum(a * b + b for a, b in self.shapes)

    def initial(self, rng: np.random.Generator) -> np.ndarray:
        parts = []
        for i, (a, b) in enumerate(self.shapes):
            if self.small_last and i == len(self.shapes) - 1:
                parts += [rng.normal(0.0, 0.01, a * b), np.zeros(b)]
            else:
                bound = 1.0 / math.sqrt(a)
                parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return np.concatenate(parts)

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Values after every layer, the input first."""
        values = [x]
        for (w, b), relu in zip(self.layers(flat), self.relu):
            z = values[-1] @ w + b
            values.append(np.maximum(z, 0.0) if relu else z)
        return values

    def loss_gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        values = self.forward(flat, x)
        known = ~np.isnan(y)
        diff = np.where(known, values[-1] - np.where(known, y, 0.0), 0.0)
        width = y.shape[1] // self.heads
        counts = known.reshape(len(y), self.heads, width).sum(axis=(0, 2))
        weight = np.repeat(np.where(counts > 0, 1.0 / np.maximum(counts, 1), 0.0), width)
        loss = float((diff**2 * weight).sum())
        grad = 2.0 * diff * weight
        out = np.empty(self.size)
        layers, into = self.layers(flat), self.layers(out)
        for i in range(len(layers) - 1, -1, -1):
            if self.relu[i]:
                grad = grad * (values[i + 1] > 0)
            np.matmul(values[i].T, grad, out=into[i][0])
            grad.sum(axis=0, out=into[i][1])
            if i:  # nothing asks for the input's gradient
                grad = grad @ layers[i][0].T
        return loss, out


@dataclass(frozen=True)
class Training:
    epochs: int = 100
    rounds: int = 10
    batch_size: int = 32
    lr: float = 1e-3
    weight_decay: float = 0.0
    seed: int = 42
    shards: int = SHARDS


def _local_epochs(net: Net, state: np.ndarray, x, y, how: Training, epochs: range, shard: int) -> np.ndarray:
    """Adam on one shard; the state holds weights, both moments and the step count."""
    p = net.size
    w, m1, m2, step = state[:p].copy(), state[p : 2 * p].copy(), state[2 * p : 3 * p].copy(), state[-1]
    a, b = np.empty(p), np.empty(p)  # every step works in these: new arrays of this size cost more than the sums
    for epoch in epochs:
        order = np.random.default_rng((how.seed, shard, epoch)).permutation(len(x))
        for start in range(0, len(x), how.batch_size):
            pick = order[start : start + how.batch_size]
            if np.isnan(y[pick]).all():
                continue
            _, grad = net.loss_gradient(w, x[pick], y[pick])
            step += 1
            np.subtract(grad, m1, out=a)
            a *= 1 - BETA1
            m1 += a
            np.multiply(grad, grad, out=a)
            a -= m2
            a *= 1 - BETA2
            m2 += a
            if how.weight_decay:
                np.multiply(w, how.lr * how.weight_decay, out=a)
                w -= a
            np.divide(m2, 1 - BETA2**step, out=b)
            np.sqrt(b, out=b)
            b += ADAM_EPS
            np.divide(m1, 1 - BETA1**step, out=a)
            a *= how.lr
            a /= b
            w -= a
    return np.concatenate([w, m1, m2, [step]])


def pack_shards(train: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """``(shard, rows, x, y)`` with one row per shard, the matrices as bytes.

    Rows are spread by a hash of id, features and targets, not by the item alone, so
    that several rows of one item do not fill a shard. Equal rows are counted first and
    dealt to the shards in turn from there. ``shards`` is the least number; no shard is
    planned for more than ``SHARD_VALUES`` values.
    """
    rows = written(
        train.select(
            F.xxhash64("item_id", "x", "perf", "cost").alias("_row"),
            "item_id",
            F.col("x").cast("array<float>").alias("x"),
            F.concat(
                F.col("perf").cast("array<double>"), F.col("cost").cast("array<double>")
            ).alias("y"),
        ).groupBy("_row", "item_id", "x", "y").agg(F.count(F.lit(1)).alias("_copies")),
        "net-rows",
    )
    n, width = rows.agg(F.sum("_copies"), F.max(F.size("x") + F.size("y"))).first()
    if not n:
        raise ValueError("no train rows")
    shards = max(shards, -(-n * width // SHARD_VALUES))
    turns = F.least("_copies", F.lit(shards))
    dealt = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)))
    dealt = dealt.select(
        "_row", "item_id", "x", "y",
        F.pmod(F.pmod("_row", F.lit(shards)) + F.col("_turn"), F.lit(shards)).cast("int").alias("shard"),
        (F.floor(F.col("_copies") / shards) + (F.col("_turn") < F.col("_copies") % shards).cast("long")).alias("_times"),
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "_row"])
        times = pdf["_times"].to_numpy()
        x = np.repeat(np.vstack(pdf["x"].to_numpy()).astype("<f4"), times, axis=0)
        y = np.repeat(np.array(pdf["y"].tolist(), dtype="<f8"), times, axis=0)
        return pd.DataFrame(
            {"shard": [pdf["shard"].iloc[0]], "rows": [len(x)], "x": [x.tobytes()], "y": [y.tobytes()]}
        )

    packed = (
        dealt.repartition(shards, "shard")
        .groupBy("shard")
        .applyInPandas(pack, "shard int, rows bigint, x binary, y binary")
    )
    return written(packed, "net-shards"), n


def train_net(
    net: Net, shards: DataFrame, rows: int, how: Training, part: slice, shift: np.ndarray, scale: np.ndarray
) -> np.ndarray:
    """Weights after all rounds. ``part`` picks the target columns of this net."""
    if not fits_broadcast(3 * net.size, 8):
        raise ValueError("the net is too large to be sent to every worker")
    sc = shards.sparkSession.sparkContext
    state = np.concatenate(
        [net.initial(np.random.default_rng(how.seed)), np.zeros(2 * net.size), [0.0]]
    )
    rounds = max(1, min(how.rounds, how.epochs))
    bounds = np.linspace(0, how.epochs, rounds + 1).astype(int)
    for first, last in zip(bounds, bounds[1:]):
        shared = sc.broadcast(state)
        epochs = range(int(first), int(last))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    x = np.frombuffer(r.x, "<f4").reshape(r.rows, -1).astype(float)
                    y = np.frombuffer(r.y, "<f8").reshape(r.rows, -1)[:, part]
                    done = _local_epochs(net, shared.value, x, (y - shift) / scale, how, epochs, r.shard)
                    done = done * (r.rows / rows)
                    pieces = [done[i : i + _PIECE] for i in range(0, len(done), _PIECE)]
                    yield pd.DataFrame({"piece": range(len(pieces)), "part": pieces})

        summed = (
            shards.mapInPandas(work, "piece int, part array<double>")
            .groupBy("piece")
            .agg(Summarizer.sum(array_to_vector("part")).alias("part"))
            .collect()
        )
        state = np.concatenate([r["part"].toArray() for r in sorted(summed, key=lambda r: r["piece"])])
        shared.unpersist()
    return state[: net.size]


def target_spread(train: DataFrame, targets: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every target, for training on one scale."""
    y = F.concat(F.col("perf").cast("array<double>"), F.col("cost").cast("array<double>"))
    column = [F.get(y, F.lit(j)) for j in range(targets)]
    known = [F.when(~F.isnan(c), c) for c in column]
    row = train.agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)) for c in known],
        *[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in known],
    ).first()
    mean, std = np.array(row[:targets]), np.array(row[targets:])
    return mean, np.where(std > 0, std, 1.0)


@dataclass
class FittedNets:
    """Nets side by side; their outputs are performances first, then costs."""

    nets: list[tuple[Net, np.ndarray]]
    shift: np.ndarray
    scale: np.ndarray
    width: int = field(init=False)

    def __post_init__(self) -> None:
        self.width = len(self.shift)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.hstack([net.forward(weights, x)[-1] for net, weights in self.nets])
        return out * self.scale + self.shift

    def predict(self, test: DataFrame) -> DataFrame:
        return with_predictions(test, self)


def _dims(train: DataFrame) -> tuple[int, int]:
    row = train.select(F.size("x"), F.size("perf")).first()
    if row is None:
        raise ValueError("no train rows")
    return row[0], row[1]


def _fit(train: DataFrame, nets: list[tuple[Net, slice]], how: Training, models: int) -> FittedNets:
    shift, scale = target_spread(train, 2 * models)
    shards, rows = pack_shards(train, how.shards)
    fitted = [
        (net, train_net(net, shards, rows, how, part, shift[part], scale[part])) for net, part in nets
    ]
    return FittedNets(fitted, shift, scale)


def _halves(models: int) -> list[slice]:
    return [slice(0, models), slice(models, 2 * models)]


@dataclass
class NetPolicy:
    """One ReLU net for the performances and one for the costs; missing targets are zero."""

    hidden: tuple[int, ...] = (256, 128)
    training: Training = Training()

    def fit(self, train: DataFrame) -> FittedNets:
        dim, models = _dims(train)
        zero = {
            c: F.transform(F.col(c).cast("array<double>"), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
            for c in ("perf", "cost")
        }
        net = Net((dim, *self.hidden, models), (True,) * len(self.hidden) + (False,))
        return _fit(train.withColumns(zero), [(net, h) for h in _halves(models)], self.training, models)


@dataclass
class NetFactorPolicy:
    """A net to a latent vector, times one factor per model; missing targets are masked."""

    hidden: tuple[int, ...] = (256, 128)
    latent: int = 64
    training: Training = Training()

    def fit(self, train: DataFrame) -> FittedNets:
        dim, models = _dims(train)
        net = Net(
            (dim, *self.hidden, self.latent, models),
            (True,) * len(self.hidden) + (False, False),
            small_last=True,
        )
        return _fit(train, [(net, h) for h in _halves(models)], self.training, models)


@dataclass
class CrossModalPolicy:
    """One trunk over interacting text and image features, two heads, one joint masked loss."""

    hidden: tuple[int, ...] = (256, 128)
    training: Training = Training(weight_decay=1e-4)

    def fit(self, train: DataFrame) -> FittedNets:
        dim, models = _dims(train)
        net = Net(
            (dim, *self.hidden, 2 * models), (True,) * len(self.hidden) + (False,), heads=2
        )
        return _fit(train, [(net, slice(0, 2 * models))], self.training, models)
