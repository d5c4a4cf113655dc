"""Quality classifier by pairwise ranking: a Bradley-Terry model over document features.

A good document is preferred to a bad one with probability sigmoid(w . (features difference)). The
weights have the least logistic loss over all pairs of a good and a bad document of the training fold; scores are then cut
at the quantile that leaves the training fold's share of bad documents below, and mapped so that the cut is 0.5.

No pair is listed. A pair's loss depends on the difference of two scores alone, and is smooth: within a cell of ``WIDTH`` it
is a polynomial in either score, to 1e-10. So each score is dealt over ``NODES`` points of its cell by Lagrange's
weights; sums over all pairs are sums over pairs of points, which only the weights at the points are needed for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from numpy.polynomial import chebyshev
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import fold, labelled_texts, read, small_batches, tasks_for, written
from quarrylens.sources.shared import scratch

#: Cells of scores, and points in each.
WIDTH, NODES = 0.5, 8
POINTS = chebyshev.chebpts1(NODES)
SPREAD = np.linalg.inv(chebyshev.chebvander(POINTS, NODES - 1))
#: The cut is the middle of the widest gap between two scores within 1 / NEAR of all rows from the quantile.
NEAR = 200
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS, MARKS = bytes(range(48, 58)), b".,;:!?'\"()-"
SYMBOLS = b"#*$%&|<>{}[]=_~^\\/@+"
FEATURES = ["log_words", "upper", "digits", "marks", "symbols", "exclaims", "bars", "non_ascii", "word_length", "distinct", "adjacent", "pairs", "lines", "repeated_lines", "stops_per_word", "long_words", "capital_words", "longest_run"]


def features(text: str | None) -> list[float]:
    """Shares and means over the whole text; all zero for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(raw)
    share = lambda letters: (size - len(raw.translate(None, letters))) / size
    body = sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n),
        share(UPPER),
        share(DIGITS),
        share(MARKS),
        share(SYMBOLS),
        raw.count(b"!!") / n,
        raw.count(b" | ") / n,
        share(bytes(range(128, 256))),
        min(body / n, 30.0) / 10,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        min(len(lines) / n, 1.0),
        1 - len(set(lines)) / max(1, len(lines)),
        (raw.count(b".") + raw.count(b"?")) / n,
        sum(map((18).__lt__, map(len, words))) / n,
        sum(map(bytes.istitle, words)) / n,
        min(n, max(map(len, raw.split(b".")))) / 1000,
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """Features with their square roots, so small shares count too."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Within 8 deviations of the mean, in training and in scoring alike: outliers weigh no more than that."""
    return np.clip((expanded(x) - mean) / scale, -8, 8)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The weighted sums, row by row, so that equal rows are equal to the last bit wherever they stand in a batch."""
        return (standardised(x, self.mean, self.scale) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, 0.5 at the cut."""
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.slope, -40, 40)))


# --- sums over all pairs


def dealt(s: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Each score's cell, counted from ``low``, and its weights at the cell's points."""
    cell = np.clip(np.floor(s / WIDTH), low, high)
    return (cell - low).astype(np.int64), chebyshev.chebvander(2 * (s / WIDTH - cell) - 1, NODES - 1) @ SPREAD


def moments(z: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Numbers of bad and good rows, means and sums of squared deviations."""
    return np.concatenate([[(~good).sum(), good.sum()], z.mean(axis=0), ((z - z.mean(axis=0)) ** 2).sum(axis=0)])


def joined_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (len(a) - 2) // 2
    m, n = a[:2].sum(), b[:2].sum()
    apart = b[2 : 2 + d] - a[2 : 2 + d]
    return np.concatenate([a[:2] + b[:2], a[2 : 2 + d] + apart * n / (m + n), a[2 + d :] + b[2 + d :] + apart**2 * m * n / (m + n)])


def spread(s: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The first cell, then the weights of bad and good rows at the points of it and the cells that follow."""
    low, high = (int(f(np.floor(s / WIDTH))) for f in (np.min, np.max))
    at, share = dealt(s, low, high)
    out = np.zeros((high - low + 1, 2, NODES))
    np.add.at(out, (at, good.astype(np.int64)), share)
    return np.concatenate([[low], out.ravel()])


def joined_spreads(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = 2 * NODES
    low = min(a[0], b[0])
    out = np.zeros(int(max(x[0] - low + (len(x) - 1) // size for x in (a, b))) * size)
    for x in (a, b):
        at = int(x[0] - low) * size
        out[at : at + len(x) - 1] += x[1:]
    return np.concatenate([[low], out])


@dataclass
class Pairs:
    """What all pairs say of a score at each point: mean loss, its slope in the score of a bad and of a good row at the
    points, and its curvature, with scores moved to the middles of their cells."""

    low: int
    loss: float
    slope: np.ndarray
    curve: np.ndarray
    between: np.ndarray

    @classmethod
    def of(cls, found: np.ndarray) -> Pairs:
        low, at = int(found[0]), found[1:].reshape(-1, 2, NODES)
        bad, good, n = at[:, 0], at[:, 1], len(at)
        pairs = bad.sum() * good.sum()
        loss, slope = 0.0, np.zeros_like(at)
        for lag in range(1 - n, n):  # cells from the good row's to the bad one's
            g, b = slice(max(0, -lag), min(n, n - lag)), slice(max(0, lag), min(n, n + lag))
            x = WIDTH * (lag + (POINTS[None, :] - POINTS[:, None]) / 2)  # how far the bad row is above the good one
            wrong = np.exp(-np.logaddexp(0, -x))
            loss += ((good[g] @ np.logaddexp(0, x)) * bad[b]).sum()
            slope[g, 1] -= bad[b] @ wrong.T
            slope[b, 0] += good[g] @ wrong
        far = WIDTH * (np.arange(n)[None, :] - np.arange(n)[:, None])
        between = np.exp(-np.logaddexp(0, far) - np.logaddexp(0, -far)) / pairs
        curve = np.stack([between @ good.sum(axis=1), between @ bad.sum(axis=1)], axis=1)
        return cls(low, loss / pairs, slope / pairs, curve, between)

    def sums(self, z: np.ndarray, good: np.ndarray, s: np.ndarray) -> np.ndarray:
        """What rows add to the gradient and, by themselves and by their cells, to the second derivatives."""
        at, share = dealt(s, self.low, self.low + len(self.slope) - 1)
        side = good.astype(np.int64)
        cells = np.zeros((len(self.slope), 2, z.shape[1]))
        np.add.at(cells, (at, side), z)
        return np.concatenate([(self.slope[at, side] * share).sum(axis=1) @ z, ((z * self.curve[at, side][:, None]).T @ z).ravel(), cells.ravel()])

    def step(self, sums: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
        d = len(w)
        bad, good = sums[d + d * d :].reshape(-1, 2, d).transpose(1, 0, 2)
        cross = good.T @ (self.between @ bad)
        return np.linalg.solve(sums[d : d + d * d].reshape(d, d) - cross - cross.T + penalty * np.eye(d), sums[:d] + penalty * w)


#: Features and classes of rows to an array of sums, and how two such arrays are joined: what a pass over all rows is.
Pass = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def fitted(over: Pass, penalty: float) -> tuple[Ranking, int, int] | None:
    """The least penalised loss over all pairs, by Newton's method with exact slopes and steps that never raise the loss; no cut
    yet. Also the numbers of bad and good rows. None without rows."""
    found = over(lambda x, good: moments(expanded(x), good), joined_moments)
    if not len(found):
        return None
    d = (len(found) - 2) // 2
    bad, good = map(int, found[:2])
    mean, scale = found[2 : 2 + d], np.sqrt(found[2 + d :] / (bad + good)) + 1e-6
    w = np.zeros(d)
    if not bad or not good:
        return Ranking(mean, scale, w, -1.0 if good else 1.0, 1.0), bad, good

    def at(w):
        found = over(lambda x, good: spread(standardised(x, mean, scale) @ w, good), joined_spreads)
        return found, (pairs := Pairs.of(found)), pairs.loss + penalty / 2 * (w @ w)

    found, pairs, loss = at(w)
    for _ in range(60):

        def sums(x, good, w=w, pairs=pairs):
            z = standardised(x, mean, scale)
            return pairs.sums(z, good, z @ w)

        step = pairs.step(over(sums, np.add), w, penalty)
        while True:
            further = at(w - step)
            if further[2] <= loss + 1e-9 or np.abs(step).max() < 1e-9:
                break
            step = step / 2
        w = w - step
        found, pairs, loss = further
        if np.abs(step).max() < 1e-6:
            break
    weight = found[1:].reshape(-1, 2, NODES).sum(axis=1)
    s = WIDTH * (found[0] + np.arange(len(weight))[:, None] + (1 + POINTS) / 2)
    middle = (weight * s).sum() / (bad + good)
    return Ranking(mean, scale, w, 0.0, float(max(np.sqrt(max((weight * (s - middle) ** 2).sum(), 0) / (bad + good)) / 4, 1e-6))), bad, good


def learn(x: np.ndarray, good: np.ndarray, bad_share: float, pairs: int | None = None, penalty: float = 1e-3, seed: int = 7) -> Ranking:
    """Bradley-Terry weights of rows in memory, from all pairs (good, bad); with ``pairs``, from so many drawn ones (no query does).

    With one class missing there is no pair: all scores are 0.5 plus what the sign of the class says."""
    if not len(x):
        return Ranking(np.zeros(2 * len(FEATURES)), np.ones(2 * len(FEATURES)), np.zeros(2 * len(FEATURES)), 0.0, 1.0)
    if pairs is None or good.all() or not good.any():
        model = fitted(lambda part, join: part(x, good), penalty)[0]
    else:
        z = expanded(x)
        model = Ranking(z.mean(axis=0), z.std(axis=0) + 1e-6, np.zeros(z.shape[1]), 0.0, 1.0)
        z = standardised(x, model.mean, model.scale)
        rng = np.random.default_rng(seed)
        d = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
        w = model.weights
        for _ in range(25):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the pair is ordered wrongly
            gradient = -(d * p[:, None]).mean(axis=0) + penalty * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        model.slope = float(max(np.std(z @ w) / 4, 1e-6))
    if good.any() and not good.all():
        values, number = np.unique(model.raw(x), return_counts=True)
        upto, below = np.cumsum(number), bad_share * len(x)
        near = np.flatnonzero(np.abs(upto[:-1] - below) * NEAR <= len(x))
        if len(near):
            at = near[np.argmax(values[near + 1] - values[near])]
            model.cut = float((values[at] + values[at + 1]) / 2)
        else:
            model.cut = float(values[min(np.searchsorted(upto, below - 1e-9), len(values) - 1)])
    return model


# --- on tables


def _features(batches):
    for b in batches:
        x = np.array([features(t) for t in b.column(0).to_pylist()], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "good"])


def _arrays(batches):
    for b in batches:
        if b.num_rows:
            yield b.column(0).flatten().to_numpy().reshape(-1, len(FEATURES)), b.column(1).to_numpy(zero_copy_only=False)


def over_tasks(rows: DataFrame) -> Pass:
    """Passes over a table (x, good): each task sends one array of sums, which are joined in the order of the tasks."""

    def over(part, join):
        def task(batches):
            parts = (part(x, good) for x, good in _arrays(batches))
            for first in parts:
                yield pa.RecordBatch.from_pydict({"sums": [reduce(join, parts, first).tobytes()]})

        found = [np.frombuffer(r.sums) for r in rows.mapInArrow(task, "sums binary").collect()]
        return reduce(join, found) if found else np.zeros(0)

    return over


def cut_of(rows: DataFrame, model: Ranking, bad: int, n: int) -> float:
    """The middle of the widest gap between two neighbouring scores that leaves about ``bad`` of all ``n`` rows below. Ranks are
    running counts of different scores in parts by range; where one score covers all ranks near it, that score."""

    def score(batches):
        for x, _ in _arrays(batches):
            yield pa.RecordBatch.from_pydict({"s": model.raw(x)})

    counts = rows.mapInArrow(score, "s double").groupBy("s").agg(F.count("*").alias("n"))
    counts = written(counts.repartitionByRange(tasks_for(rows.sparkSession), "s").select(F.spark_partition_id().alias("part"), "s", "n"), "scores")
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"), F.min("s").alias("first")).orderBy("part").collect()  # one for each task
    above, starts = 0, []
    for k, p in enumerate(parts):
        starts.append((p.part, above, parts[k + 1].first if k + 1 < len(parts) else None))
        above += p.n
    inside = Window.partitionBy("part").orderBy("s")
    ranked = counts.join(F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, above long, following double")), "part")
    ranked = ranked.select("s", (F.col("above") + F.sum("n").over(inside)).alias("upto"), F.coalesce(F.lead("s").over(inside), "following").alias("next"))
    near = ranked.where((F.abs(F.col("upto") - bad) * NEAR <= n) & F.col("next").isNotNull())
    widest = near.orderBy(F.desc(F.col("next") - F.col("s")), "s").first()
    return float((widest.s + widest.next) / 2 if widest else ranked.where(F.col("upto") >= bad).agg(F.min("s")).first()[0])


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Learn from all labelled rows whose crc32(doc_id as text) mod 3 is not 1: their features are written once."""
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark):
        training = fold("doc_id", 3) != 1
        known = labelled_texts(docs.where(training), labels, "quality", training).select("text", (F.col("label") == 1).alias("good"))
        rows = written(known.mapInArrow(_features, "x array<double>, good boolean"), "training")
        found = fitted(over_tasks(rows), 1e-3)
        if found is None:
            return learn(np.zeros((0, len(FEATURES))), np.zeros(0, bool), 0.5)
        model, bad, good = found
        if bad and good:
            model.cut = cut_of(rows, model, bad, bad + good)
    return model


def scored(docs: DataFrame, model: Ranking, column: str = "score") -> DataFrame:
    """``docs`` with the score of the whole text. Null and empty texts are scored by their zero features;
    very long ones whole; equal texts get equal scores; an input column of the same name is replaced, all others stay; an
    empty table gives no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen numbers

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        x = np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(shared.value.score(x))

    return docs.withColumn(column, score(F.col("text").cast("string")))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """A score for every whole text. Null and empty texts are scored by their zero features, very long ones whole; equal texts get
    equal scores, repeated rows a row each; null ids are in the fold of the empty text; an empty table gives no rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
