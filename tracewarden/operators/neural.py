"""Trained models in numpy: a variational autoencoder, scores from graph neighbourhoods, root ranks, a forecaster of latents, and text vectors.

Every model is fitted on the driver to a sample whose size is a parameter; rows are taken by a hash of
their key, so the same rows are taken in every run. It is then applied to all rows in Arrow
batches. What goes to the driver is the sample, what is broadcast are the weights; neither grows with
the table. Neighbourhoods are aggregated by joins before a model sees them, in place of
multiplying a whole adjacency matrix in every epoch: a model of two such rounds has the reach
of a graph network of two layers, and no graph has to fit into a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracewarden.operators import graph
from tracewarden.session import settled

#: Rows that a model is fitted to.
SAMPLE = 20_000


class Network:
    """Dense layers with a rectifier between them and a linear end, with Adam's moments."""

    def __init__(self, sizes: tuple[int, ...], seed: int) -> None:
        r = np.random.default_rng(seed)
        self.weights = [r.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.biases = [np.zeros(b) for b in sizes[1:]]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (*self.weights, *self.biases)]
        self.steps = 0

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        """The input and what every layer makes of it."""
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w + b
            if i + 1 < len(self.weights):
                x = np.maximum(x, 0)
            out.append(x)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.layers(x)[-1]

    def learn(self, layers: list[np.ndarray], slope: np.ndarray, rate: float, decay: float = 0.0) -> np.ndarray:
        """One step against the slope of the loss by the output; returns the slope by the input."""
        by_weight, by_bias = [], []
        for i in range(len(self.weights) - 1, -1, -1):
            by_weight.insert(0, layers[i].T @ slope + decay * self.weights[i])
            by_bias.insert(0, slope.sum(axis=0))
            slope = slope @ self.weights[i].T
            if i:
                slope = slope * (layers[i] > 0)
        self.steps += 1
        size = np.sqrt(sum(float((g**2).sum()) for g in (*by_weight, *by_bias)))
        for p, g, (m, v) in zip((*self.weights, *self.biases), (*by_weight, *by_bias), self.moments):
            g = g * min(1.0, 5.0 / max(size, 1e-12))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        return slope


class Scale(NamedTuple):
    middle: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((np.where(np.isfinite(x), x, self.middle) - self.mean) / self.deviation, -10, 10)


def scale_of(x: np.ndarray) -> Scale:
    """Medians for what is missing, then mean 0 and deviation 1."""
    x = np.where(np.isfinite(x), x, np.nan)
    middle = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    full = np.where(np.isnan(x), middle, x)
    deviation = full.std(axis=0)
    return Scale(middle, full.mean(axis=0), np.where(deviation > 0, deviation, 1.0))


def sampled(df: DataFrame, key: str, columns: list[str], most: int, seed: int) -> pd.DataFrame:
    """At most ``most`` rows, those with the least hashes of their key: a top-k, no sort of the whole."""
    return df.select(key, *columns).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most).toPandas()


def batches_of(n: int, size: int, epochs: int, seed: int) -> Iterator[np.ndarray]:
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        order = r.permutation(n)
        yield from (order[a : a + size] for a in range(0, n, size))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def scored(df: DataFrame, columns: list[str], out: str, of) -> DataFrame:
    """``df`` with ``of``, a function of a matrix of the columns, as a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(**{out: of(rows[columns].to_numpy(float)) if len(rows) else np.zeros(0)})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def autoencoder_error(df: DataFrame, columns: list[str], key: str, weight: str | None = None, hidden: int = 64, latent: int = 8, epochs: int = 20, batch: int = 512, rate: float = 1e-3, beta: float = 5e-4, seed: int = 42, sample: int = SAMPLE, out: str = "recon_error") -> DataFrame:
    """``df`` with the mean squared error of a variational autoencoder; ``weight`` names the column that a row's loss is multiplied with.

    Rows are rebuilt from the mean of their latent. Nulls count as the sample's median. Rows of weight 0 teach nothing.
    """
    d = len(columns)
    rows = sampled(df if weight is None else df.where(F.col(weight) > 0), key, [*columns, *([weight] if weight else [])], sample, seed)
    if not len(rows):
        return df.withColumn(out, F.lit(0.0))
    scale = scale_of(rows[columns].to_numpy(float))
    x, w = scale(rows[columns].to_numpy(float)), rows[weight].to_numpy(float) if weight else np.ones(len(rows))
    encoder, decoder, r = Network((d, hidden, hidden, 2 * latent), seed), Network((latent, hidden, hidden, d), seed + 1), np.random.default_rng(seed)
    for at in batches_of(len(x), batch, epochs, seed):
        own, share = x[at], (w[at] / max(w[at].sum(), 1e-12))[:, None]
        coded = encoder.layers(own)
        mean, spread = coded[-1][:, :latent], np.clip(coded[-1][:, latent:], -10, 10)
        noise = r.normal(size=mean.shape)
        drawn = decoder.layers(mean + noise * np.exp(spread / 2))
        back = decoder.learn(drawn, 2 * (drawn[-1] - own) / d * share, rate)
        by_spread = back * noise * np.exp(spread / 2) / 2 + beta * share * (np.exp(spread) - 1) / 2
        encoder.learn(coded, np.hstack([back + beta * share * mean, by_spread]), rate)

    def error(m: np.ndarray) -> np.ndarray:
        own = scale(m)
        return ((decoder(encoder(own)[:, :latent]) - own) ** 2).mean(axis=1)

    return scored(df, columns, out, error)


def second_stage_weight(score: Column, mode: str, alpha: float = 1.0, threshold: float = 0.7) -> Column:
    """A row's weight in a second model by its first score: 1 less alpha times the score, not below 0, or 1 up to the threshold and 0 above."""
    return F.greatest(F.lit(0.0), 1 - alpha * score) if mode == "weighted" else F.when(score > threshold, 0.0).otherwise(1.0)


def propagated(nodes: DataFrame, edges: DataFrame, columns: list[str], rounds: int = 2) -> DataFrame:
    """(node, columns, and each after every round, c_1, c_2, ...): features summed over neighbours and the node itself, with the weights of the normalised adjacency. Nodes without edges keep theirs.

    One join and one grouping for each round; minima of work per edge, and heavy nodes are combined before the shuffle.
    """
    links = settled(graph.normalised(edges).withColumnRenamed("src", "node"), "links")
    now = nodes.select("node", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    whole = now
    for i in range(1, rounds + 1):
        near = links.join(now.withColumnRenamed("node", "dst"), "dst").groupBy("node").agg(*(F.sum(F.col("weight") * F.col(c)).alias(f"__{c}") for c in columns))
        now = settled(now.join(near, "node", "left").select("node", *(F.coalesce(f"__{c}", c).alias(c) for c in columns)), "features")
        whole = whole.join(now.select("node", *(F.col(c).alias(f"{c}_{i}") for c in columns)), "node")
    return whole


def graph_normal_score(nodes: DataFrame, edges: DataFrame, columns: list[str], hidden: int = 64, epochs: int = 60, batch: int = 512, rate: float = 5e-3, pull: float = 0.3, blend: float = 0.85, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """(node, normal_score): how normal a node is by its features and those of two rounds of neighbours.

    ``nodes``: node, columns, label (1 normal, 0 not, null unknown) and score (0 to 1, how normal it seemed).
    The loss is the cross entropy of labelled nodes, rarer ones weighted up, and ``pull`` times the squared distance to
    the score; the result is blended with the score. Without labels, nodes at or above the median score count as normal.
    """
    wide = propagated(nodes, edges, columns)
    inputs = [c for c in wide.columns if c != "node"]
    known = settled(wide.join(nodes.select("node", "label", F.col("score").cast("double").alias("score")), "node"), "known")
    rows = sampled(known, "node", [*inputs, "label", "score"], sample, seed)
    if not len(rows):
        return known.select("node", F.col("score").alias("normal_score"))
    scale, score, label = scale_of(rows[inputs].to_numpy(float)), np.clip(rows["score"].fillna(0.5).to_numpy(float), 0, 1), rows["label"].to_numpy(float)
    if np.isnan(label).all():
        label = (score >= np.median(score)).astype(float)
    x, told = scale(rows[inputs].to_numpy(float)), ~np.isnan(label)
    up = max(1.0, float((label == 0).sum()) / max(1.0, float((label == 1).sum())))
    net = Network((len(inputs), hidden, 1), seed)
    for at in batches_of(len(x), batch, epochs, seed):
        layers = net.layers(x[at])
        p, y = sigmoid(layers[-1][:, 0]), np.nan_to_num(label[at])
        by_label = np.where(told[at], (p - y) * np.where(y == 1, up, 1.0), 0.0) / max(1, told[at].sum())
        net.learn(layers, (by_label + pull * 2 * (p - score[at]) * p * (1 - p) / len(at))[:, None], rate, 1e-4)
    mixed = blend * F.col("__p") + (1 - blend) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.5))))
    return scored(known, inputs, "__p", lambda m: sigmoid(net(scale(m))[:, 0])).select("node", mixed.alias("normal_score"))


def root_scores(rows: DataFrame, columns: list[str], key: str, incident: str, target: str, category: str | None = None, hidden: int = 64, epochs: int = 60, rate: float = 5e-3, ranking: float = 0.5, of_category: float = 0.2, incidents: int = 2_000, members: int = 50, seed: int = 42) -> DataFrame:
    """``rows`` with root_score, from a network with two heads: how much of a cause a row is, and, with ``category`` (whole numbers from 0), its incident's category.

    The loss is the cross entropy to ``target`` (0 to 1), ``ranking`` times the pairwise loss within an incident, and
    ``of_category`` times the categories' cross entropy. Fitted to at most ``incidents`` incidents by hash, and to
    ``members`` rows of each; applied to all rows.
    """
    named = [*columns, target, *([category] if category else [])]
    some = rows.select(incident).distinct().orderBy(F.xxhash64(F.col(incident), F.lit(seed)), incident).limit(incidents)
    place = F.row_number().over(Window.partitionBy(incident).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    held = rows.select(key, incident, *named).join(some, incident, "left_semi").withColumn("__n", place).where(F.col("__n") <= members).toPandas()
    if not len(held):
        return rows.withColumn("root_score", F.lit(0.0))
    scale, y = scale_of(held[columns].to_numpy(float)), np.clip(held[target].fillna(0).to_numpy(float), 0, 1)
    x, group = scale(held[columns].to_numpy(float)), held[incident].astype("category").cat.codes.to_numpy()
    kinds = int(held[category].max()) + 1 if category else 0
    cls = held[category].to_numpy(int) if category else None
    order = np.argsort(group, kind="stable")
    runs = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
    net, r = Network((len(columns), hidden, hidden, 1 + kinds), seed), np.random.default_rng(seed)
    for _ in range(epochs):
        for a in range(0, len(runs), 32):
            own = [runs[i] for i in r.permutation(len(runs))[a : a + 32]]
            at = np.concatenate(own)
            layers = net.layers(x[at])
            slope = np.zeros_like(layers[-1])
            p = sigmoid(layers[-1][:, 0])
            slope[:, 0] = (p - y[at]) / len(at)
            low = 0
            for run in own:
                z, t = layers[-1][low : low + len(run), 0], y[run]
                over = t[:, None] > t[None, :]
                if over.any():
                    pull = np.where(over, -sigmoid(z[None, :] - z[:, None]), 0.0) / over.sum()
                    slope[low : low + len(run), 0] += ranking * (pull.sum(axis=1) - pull.sum(axis=0)) / len(own)
                low += len(run)
            if kinds:
                e = np.exp(layers[-1][:, 1:] - layers[-1][:, 1:].max(axis=1, keepdims=True))
                q = e / e.sum(axis=1, keepdims=True)
                q[np.arange(len(at)), cls[at]] -= 1
                slope[:, 1:] = of_category * q / len(at)
            net.learn(layers, slope, rate, 1e-4)
    return scored(rows, columns, "root_score", lambda m: sigmoid(net(scale(m))[:, 0]))


def forecast_error(df: DataFrame, by: list[str], order: str, columns: list[str], context: int = 12, ahead: int = 4, stride: int = 1, latent: int = 16, hidden: int = 64, epochs: int = 20, batch: int = 256, rate: float = 1e-3, keep: float = 0.99, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """(by, order, forecast_error): the mean error of the windows that look ahead at a row; rows that no window looks at get 0.

    A window has ``context`` rows of a group and the ``ahead`` rows after them; a new one starts every ``stride`` rows.
    An encoder and a predictor learn to foretell the latent of what comes next, which a slow copy of the encoder gives
    (a moving average with ``keep``), both of unit length. No labels are used. ``order`` tells the rows of a group apart.
    """
    w = Window.partitionBy(*by).orderBy(order)
    rows = settled(df.select(*by, order, *columns).withColumn("__i", F.row_number().over(w) - 1), "steps")
    packed = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns))
    past, next_ = F.collect_list(packed).over(w.rowsBetween(0, context - 1)), F.collect_list(packed).over(w.rowsBetween(context, context + ahead - 1))
    cut = rows.select(*by, "__i", F.flatten(past).alias("__past"), F.flatten(next_).alias("__next"))
    d = len(columns)
    windows = settled(cut.where((F.size("__next") == ahead * d) & (F.col("__i") % stride == 0)).withColumn("__key", F.xxhash64(*by, "__i")), "windows")
    held = sampled(windows, "__key", ["__past", "__next"], sample, seed)
    zero = rows.select(*by, order, F.lit(0.0).alias("forecast_error"))
    if not len(held):
        return zero
    a, b = (np.array(held[c].tolist(), dtype=float) for c in ("__past", "__next"))
    scale = scale_of(np.vstack([a.reshape(-1, d), b.reshape(-1, d)]))
    flat = lambda m: scale(m.reshape(-1, d)).reshape(len(m), -1)
    last = min(ahead, context)

    def shape(m: np.ndarray) -> np.ndarray:
        """The mean of a window's steps, and its last steps."""
        steps = flat(m).reshape(len(m), -1, d)
        return np.hstack([steps.mean(axis=1), steps[:, -last:, :].reshape(len(m), -1)])

    wide = d * (1 + last)
    encoder, slow, predictor = Network((wide, hidden, latent), seed), Network((wide, hidden, latent), seed), Network((latent, hidden, latent), seed + 1)
    unit = lambda z: z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    x, y = shape(a), shape(b)
    for at in batches_of(len(x), batch, epochs, seed):
        coded = encoder.layers(x[at])
        told = predictor.layers(coded[-1])
        size = np.maximum(np.linalg.norm(told[-1], axis=1, keepdims=True), 1e-9)
        near = told[-1] / size
        off = np.clip(near - unit(slow(y[at])), -1, 1) / len(at)
        slope = (off - near * (off * near).sum(axis=1, keepdims=True)) / size
        encoder.learn(coded, predictor.learn(told, slope, rate), rate, 1e-4)
        for mine, theirs in zip((*slow.weights, *slow.biases), (*encoder.weights, *encoder.biases)):
            mine += (1 - keep) * (theirs - mine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            error = np.zeros(0)
            if len(part):
                p, n = (np.array(part[c].tolist(), dtype=float) for c in ("__past", "__next"))
                error = np.linalg.norm(unit(predictor(encoder(shape(p)))) - unit(slow(shape(n))), axis=1)
            yield part[[*by, "__i"]].assign(error=error)

    schema = StructType([*windows.select(*by, "__i").schema.fields, StructField("error", DoubleType())])
    errors = windows.mapInPandas(run, schema)
    seen = errors.select(*by, F.explode(F.sequence(F.col("__i") + context, F.col("__i") + context + ahead - 1)).alias("__i"), "error").groupBy(*by, "__i").agg(F.avg("error").alias("error"))
    return rows.join(seen, [*by, "__i"], "left").select(*by, order, F.coalesce("error", F.lit(0.0)).alias("forecast_error"))


def text_vectors(df: DataFrame, text: str, size: int = 64, out: str = "vector") -> DataFrame:
    """``df`` with a vector of unit length for each text: the mean of its words' vectors, which a hash of the word fixes. No words give zeros."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def of(word: str) -> np.ndarray:
            if word not in known:
                if len(known) > 100_000:
                    known.clear()
                known[word] = np.random.default_rng(zlib.crc32(word.encode())).normal(size=size)
            return known[word]

        def one(t: str | None) -> list[float]:
            words = (t or "").lower().split()
            v = sum((of(w) for w in words), np.zeros(size))
            n = float(np.linalg.norm(v))
            return (v / n if n > 0 else v).tolist()

        return texts.map(one)

    return df.withColumn(out, vectors(F.col(text)))
