"""Quality: a byte-level convolutional network in numpy.

The UTF-8 bytes of a whole text are cut into overlapping chunks.  Learned filters slide over each chunk; their mean
and largest responses describe it, a small layer turns them into chunk features, the features are max-pooled over
all chunks and combined into one probability.

Defined cases: null and empty texts are one empty chunk; repeated rows score alike (to the five places that
scores are rounded to, single precision products depending on their batch); texts of any length are read
whole in slices of bounded memory; a label table without both classes gives the constant prior; the held-out fold
never teaches; fitting uses at most ``per_class`` rows of each class and ``max_chars`` characters, both parameters; of windows that tie
for the largest response the first is learned from; an empty table gives no rows; ``keep_good`` hands on all columns,
also ones named like the scores, and no other column is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import class_share, held_out, labelled_sample, map_batches, slices, table

#: Half a chunk; a chunk is two halves and shares each of them with a neighbour.
HALF = 256
WIDTH, STRIDE = 8, 4
WINDOWS = (HALF - WIDTH) // STRIDE + 1
THRESHOLD = 0.7
_LEFT = np.arange(WINDOWS)[:, None] * STRIDE + np.arange(WIDTH)[None, :]


def halves(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by half chunk, windows of each half that hold text, where each document's halves start)."""
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = np.maximum(1, -(-sizes // HALF))
    starts = np.concatenate([[0], np.cumsum(counts)])
    data = np.zeros(int(starts[-1]) * HALF, np.uint8)
    for r, s in zip(raw, starts):
        data[s * HALF:s * HALF + len(r)] = np.frombuffer(r, np.uint8)
    left = np.repeat(sizes, counts) - (np.arange(starts[-1]) - np.repeat(starts[:-1], counts)) * HALF
    valid = np.clip(-(-(np.minimum(left, HALF) - WIDTH) // STRIDE) + 1, 1, WINDOWS)
    return data.reshape(-1, HALF), valid.astype(np.float32), starts


def pairs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second half of every chunk, and where each document's chunks start."""
    counts = np.diff(starts)
    chunks = np.maximum(1, counts - 1)
    at = np.concatenate([[0], np.cumsum(chunks)])
    first = np.repeat(starts[:-1], chunks) + np.arange(at[-1]) - np.repeat(at[:-1], chunks)
    return first, first + (np.repeat(counts, chunks) > 1), at


@dataclass
class Network:
    embed: np.ndarray  # 256 x d
    filters: np.ndarray  # WIDTH*d x k
    shift: np.ndarray  # k
    mix: np.ndarray  # 2k x m
    mix_shift: np.ndarray  # m
    out: np.ndarray  # m
    bias: float

    @staticmethod
    def fresh(seed: int = 7, d: int = 8, k: int = 24, m: int = 24) -> Network:
        g = np.random.default_rng(seed)
        f = lambda *s: g.normal(0, 1, s).astype(np.float32)
        return Network(f(256, d) * 0.5, f(WIDTH * d, k) / np.float32((WIDTH * d) ** 0.5), np.zeros(k, np.float32),
                       f(2 * k, m) / np.float32((2 * k) ** 0.5), np.zeros(m, np.float32), f(m) * np.float32(0.3), 0.0)

    def respond(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and rectified filter responses of half chunks."""
        x = self.embed[rows][:, _LEFT].reshape(len(rows), WINDOWS, -1)
        return x, np.maximum(x @ self.filters + self.shift, 0)

    def pool(self, rows: np.ndarray, valid: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Mean response over the windows that hold text, and the largest response, of each half chunk."""
        k = len(self.shift)
        mean, top = np.empty((len(rows), k), np.float32), np.empty((len(rows), k), np.float32)
        inside = np.arange(WINDOWS)
        for at in range(0, len(rows), step):
            _, a = self.respond(rows[at:at + step])
            v = valid[at:at + step]
            if (v < WINDOWS).any():
                a[inside[None, :] >= v[:, None]] = 0
            mean[at:at + step] = a.sum(1) / v[:, None]
            top[at:at + step] = a.max(1)
        return mean, top

    def logits(self, raw: list[bytes]) -> np.ndarray:
        rows, valid, starts = halves(raw)
        mean, top = self.pool(rows, valid)
        first, second, at = pairs(starts)
        f = np.concatenate([(mean[first] + mean[second]) / 2, np.maximum(top[first], top[second])], 1)
        u = np.tanh(f @ self.mix + self.mix_shift)
        return np.maximum.reduceat(u, at[:-1]) @ self.out + self.bias

    def scores(self, raw: list[bytes]) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(raw).astype(np.float64), -40, 40))), 5)


def _gradients(net: Network, raw: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    rows, valid, starts = halves(raw)
    k, m, d = len(net.shift), len(net.out), net.embed.shape[1]
    x, a = net.respond(rows)
    outside = np.arange(WINDOWS)[None, :] >= valid[:, None]
    a[outside] = 0
    mean, peak = a.sum(1) / valid[:, None], a.argmax(1)
    top = np.take_along_axis(a, peak[:, None, :], 1)[:, 0]
    first, second, at = pairs(starts)
    f = np.concatenate([(mean[first] + mean[second]) / 2, np.maximum(top[first], top[second])], 1)
    u = np.tanh(f @ net.mix + net.mix_shift)
    pooled = np.maximum.reduceat(u, at[:-1])
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -40, 40)))
    dz = ((p - y) * weight).astype(np.float32)
    g = {"out": pooled.T @ dz, "bias": np.array(dz.sum())}
    doc = np.repeat(np.arange(len(raw)), np.diff(at))
    du = np.where(u == pooled[doc], (dz[:, None] * net.out)[doc], 0) * (1 - u * u)
    live = np.flatnonzero(np.abs(du).sum(1))
    du, fl = du[live], f[live]
    g["mix"], g["mix_shift"] = fl.T @ du, du.sum(0)
    df = du @ net.mix.T
    dmean, dtop = np.zeros_like(mean), np.zeros_like(top)
    i, j = first[live], second[live]
    np.add.at(dmean, i, df[:, :k] / 2)
    np.add.at(dmean, j, df[:, :k] / 2)
    left = top[i] >= top[j]
    np.add.at(dtop, i, df[:, k:] * left)
    np.add.at(dtop, j, df[:, k:] * ~left)
    used = np.flatnonzero(np.abs(dmean).sum(1) + np.abs(dtop).sum(1))
    da = np.repeat((dmean[used] / valid[used, None])[:, None, :], WINDOWS, 1)
    np.put_along_axis(da, peak[used][:, None, :], np.take_along_axis(da, peak[used][:, None, :], 1) + dtop[used][:, None, :], 1)
    da *= a[used] > 0
    da = da.reshape(-1, k)
    g["filters"], g["shift"] = x[used].reshape(-1, WIDTH * d).T @ da, da.sum(0)
    dx = (da @ net.filters.T).reshape(-1, d)
    which = rows[used][:, _LEFT].reshape(-1)
    g["embed"] = np.stack([np.bincount(which, weights=dx[:, c], minlength=256) for c in range(d)], 1).astype(np.float32)
    return g


def fit(sample: list[tuple[str, int]], prior: float, epochs: int = 10, batch_bytes: int = 160_000, rate: float = 6e-3, seed: int = 7) -> Network:
    """Adam over the sample, classes balanced, the bias then moved to the ``prior`` share of class 1."""
    y = np.array([l for _, l in sample], np.float32)
    net = Network.fresh(seed)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.bias = float(np.log(prior / (1 - prior)))
        return net
    raw = [t.encode("utf-8", "replace") for t, _ in sample]
    share = float(y.mean())
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    g = np.random.default_rng(seed)
    names = ("embed", "filters", "shift", "mix", "mix_shift", "out", "bias")
    first, second, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    batch_bytes = min(batch_bytes, max(4096, sum(map(len, raw)) // 24))  # a small sample still makes steps enough
    steps = max(1, epochs * (1 + sum(map(len, raw)) // batch_bytes))
    for _ in range(epochs):
        order, at = g.permutation(len(raw)), 0
        while at < len(order):
            own, size = [], 0
            while at < len(order) and (not own or size + len(raw[order[at]]) <= batch_bytes):
                own.append(order[at])
                size += len(raw[order[at]])
                at += 1
            grads = _gradients(net, [raw[i] for i in own], y[own], weight[own] / len(own))
            t += 1
            lr = rate * max(0.05, 1 - t / (steps * 1.05))
            for n in names:
                d = np.clip(grads[n], -5, 5)
                first[n] = 0.9 * first[n] + 0.1 * d
                second[n] = 0.99 * second[n] + 0.01 * d * d
                move = lr * (first[n] / (1 - 0.9 ** t)) / (np.sqrt(second[n] / (1 - 0.99 ** t)) + 1e-8)
                old = getattr(net, n)
                setattr(net, n, float(old - move) if n == "bias" else (old - move).astype(np.float32))
    net.bias += float(np.log(prior / (1 - prior)))
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 6_000_000, **options) -> Network:
    return fit(labelled_sample(docs, labels, "quality", per_class, max_chars), class_share(labels, "quality"), **options)


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default), held_out, score and predicted for every row; nothing is shuffled."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", held_out boolean, score double, predicted int"
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "_text", 2 << 20):
            raw = [t.encode("utf-8", "replace") for t in part.column("_text").to_pylist()]
            p = shared.value.scores(raw) if raw else np.zeros(0)
            folds = [held_out(i) if i is not None else False for i in part.column("_id").to_pylist()]
            yield pa.table([*(part.column(c) for c in keep), pa.array(folds, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                           names=[*keep, "held_out", "score", "predicted"])

    return map_batches(source, run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's quality, learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier accepts, with their own columns."""
    taken = {"held_out", "score", "predicted"} & set(docs.columns)
    renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in taken})
    out = score(renamed, net, threshold, renamed.columns).where("predicted = 1").select(*renamed.columns)
    return out.withColumnsRenamed({f"_own_{c}": c for c in taken}).select(*docs.columns)
