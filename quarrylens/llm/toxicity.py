"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Every word enters with two inputs. The word input is how strongly the word goes with toxic documents of
the training fold, and a learnt vector; the character input is the same for its character n-grams, the strongest short and long one, and
the mean of their learnt vectors, so inflected and unseen forms are read by their letters. A document
is cut into overlapping windows that cover it whole; its score is that of its worst window. Labels are of
documents, so training picks the worst window of each document by the model so far and learns from those.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import fold, labelled_texts, read, small_batches

WINDOW, STRIDE = 48, 36
HIDDEN, LEARNT = 8, 4
INPUTS = 3 + 2 * LEARNT
#: Parameters of the model: labelled documents used of each class; words and n-grams with inputs of their own, the strongest
#: first; toxic documents that a word or n-gram must be in to have them.
LABELLED = 2000
WORDS, GRAMS = 20_000, 60_000
EVIDENCE = 3
SIZES = (3, 4, 5, 6)
REMEMBERED = 350_000
EDGE = ".,;:!?\"'()[]{}#*$%&|<>-_=~^\\/@+"
THRESHOLD = 0.3


def grams_of(word: str) -> list[str]:
    """Character n-grams of the whole word between its edges."""
    s = f"<{word}>"
    n = len(s)
    return [s[i : i + k] for k in SIZES for i in range(n - k + 1)]


def _grams_in(words: list[str]) -> set[str]:
    return set().union(*map(grams_of, set(words)))


def _strength(with_it: np.ndarray, without: np.ndarray, n_with: int, n_without: int) -> np.ndarray:
    """Signed strength of the difference between two document shares: log of its z-value beyond 2, 2 at most."""
    p = (with_it + without + 1) / (n_with + n_without + 2)
    z = (with_it / max(n_with, 1) - without / max(n_without, 1)) / np.sqrt(p * (1 - p) * (1 / max(n_with, 1) + 1 / max(n_without, 1)))
    return np.sign(z) * np.minimum(np.log1p(np.maximum(np.abs(z) - 2, 0)), 2.0)


@dataclass
class Parts:
    """What words are made of: the row of each word, and the rows of its n-grams, start[i] to start[i + 1]."""

    word: np.ndarray
    gram: np.ndarray
    start: np.ndarray

    def take(self, at: np.ndarray) -> Parts:
        count = self.start[at + 1] - self.start[at]
        start = np.r_[0, np.cumsum(count)]
        flat = np.repeat(self.start[at] - start[:-1], count) + np.arange(start[-1])
        return Parts(self.word[at], self.gram[flat], start)


@dataclass
class Model:
    words: dict = field(default_factory=dict)  # word -> row; row 0 is any other word
    grams: dict = field(default_factory=dict)
    word_strength: np.ndarray = None
    gram_strength: np.ndarray = None
    gram_long: np.ndarray = None  # of 5 letters or more
    word_vectors: np.ndarray = None
    gram_vectors: np.ndarray = None
    net: dict = field(default_factory=dict)
    cut: float = 0.0
    slope: float = 1.0

    def parts(self, words: list[str]) -> Parts:
        get = self.grams.get
        grams = [[g for g in map(get, grams_of(w)) if g is not None] for w in words]
        count = np.fromiter(map(len, grams), np.int64, len(words))
        return Parts(np.array([self.words.get(w, 0) for w in words], np.int64), np.array([g for x in grams for g in x], np.int64), np.r_[0, np.cumsum(count)])

    def inputs(self, parts: Parts) -> np.ndarray:
        out = np.zeros((len(parts.word), INPUTS), np.float32)
        out[:, 0] = self.word_strength[parts.word]
        out[:, 3 : 3 + LEARNT] = self.word_vectors[parts.word]
        count = np.diff(parts.start)
        some = count > 0
        if some.any():
            at, many = parts.start[:-1][some], count[some, None]
            s = self.gram_strength[parts.gram]
            long = self.gram_long[parts.gram]
            out[some, 1] = np.maximum.reduceat(np.where(long, 0, s), at)
            out[some, 2] = np.maximum.reduceat(np.where(long, s, 0), at)
            out[some, 3 + LEARNT :] = np.add.reduceat(self.gram_vectors[parts.gram], at, axis=0) / many
        return out


def _new_net(rng) -> dict:
    h = HIDDEN
    net = {"q": rng.normal(0, 0.3, 2 * h), "w": rng.normal(0, 0.3, 2 * h), "b": np.zeros(1)}
    for d in "fb":
        net |= {f"W{d}": rng.normal(0, 0.4, (INPUTS, 3 * h)), f"U{d}": rng.normal(0, 0.3, (h, 3 * h)), f"c{d}": np.zeros(3 * h)}
    return {k: v.astype(np.float32) for k, v in net.items()}


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(net: dict, direction: str, a: np.ndarray, mask: np.ndarray, keep: bool):
    """States of one direction. a: (steps, batch, 3 hidden) projected inputs; mask: (steps, batch, 1)."""
    steps, batch, _ = a.shape
    n, u = HIDDEN, net[f"U{direction}"]
    h, states, kept = np.zeros((batch, n), np.float32), np.empty((steps, batch, n), np.float32), [None] * steps
    for t in range(steps) if direction == "f" else range(steps - 1, -1, -1):
        g = h @ u
        zr = _sigmoid(a[t, :, : 2 * n] + g[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(a[t, :, 2 * n :] + r * g[:, 2 * n :])
        if keep:
            kept[t] = (h, z, r, c, g[:, 2 * n :])
        h = h + mask[t] * (1 - z) * (c - h)
        states[t] = h
    return states, kept


def _attend(net: dict, states: np.ndarray, mask: np.ndarray):
    s = states @ net["q"]
    s = np.where(mask[:, :, 0] > 0, s, -1e9)
    alpha = np.exp(s - s.max(axis=0))
    alpha /= alpha.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", alpha, states)
    return alpha, pooled, pooled @ net["w"] + net["b"][0]


def logits(net: dict, projected_f: np.ndarray, projected_b: np.ndarray, index: np.ndarray, lengths: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Logit of each window. index: (windows, WINDOW) rows of the projected word inputs."""
    out = np.empty(len(index), np.float32)
    order = np.argsort(lengths, kind="stable")  # windows of like length together: few padded steps
    for i in range(0, len(index), batch):
        at = order[i : i + batch]
        steps = max(1, int(lengths[at[-1]]))
        idx = index[at, :steps].T
        mask = (np.arange(steps)[:, None] < lengths[at])[:, :, None].astype(np.float32)
        f, _ = _run(net, "f", projected_f[idx], mask, False)
        b, _ = _run(net, "b", projected_b[idx], mask, False)
        out[at] = _attend(net, np.concatenate([f, b], axis=2), mask)[2]
    return out


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover n words; at least one."""
    count = 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STRIDE)
    return [(i * STRIDE, min(i * STRIDE + WINDOW, n)) for i in range(count)]


class Scorer:
    """Scores texts with a model. Words are remembered with their projected inputs."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.f = np.zeros((1024, 3 * HIDDEN), np.float32)
        self.b = np.zeros((1024, 3 * HIDDEN), np.float32)
        self.used = 0

    def _learn(self, fresh: list[str]) -> None:
        net, x = self.model.net, self.model.inputs(self.model.parts([w.lower().strip(EDGE) for w in fresh]))
        need = self.used + len(fresh)
        if need > len(self.f):
            grow = max(need, 2 * len(self.f)) - len(self.f)
            self.f, self.b = (np.concatenate([m, np.zeros((grow, 3 * HIDDEN), np.float32)]) for m in (self.f, self.b))
        self.f[self.used : need] = x @ net["Wf"] + net["cf"]
        self.b[self.used : need] = x @ net["Wb"] + net["cb"]
        self.known.update(zip(fresh, range(self.used, need), strict=True))
        self.used = need

    def document_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The highest window logit of each text, and the first word of that window."""
        if len(self.known) > REMEMBERED:
            self._forget()
        split = [(t or "").split() for t in texts]
        fresh = list(set().union(*split).difference(self.known)) if split else []
        if fresh:
            self._learn(fresh)
        spans, owner, rows = [], [], []
        for d, words in enumerate(split):
            ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            for s, e in windows(len(words)):
                row = np.zeros(WINDOW, np.int64)
                row[: e - s] = ids[s:e]
                rows.append(row)
                owner.append(d)
                spans.append((s, e))
        if not rows:
            return np.zeros(0), np.zeros(0, np.int64)
        lengths = np.array([e - s for s, e in spans])
        found = logits(self.model.net, self.f, self.b, np.array(rows), lengths)
        found[lengths == 0] = -20.0  # a text without words
        owner = np.array(owner)
        order = np.lexsort((-found, owner))
        first = order[np.r_[True, np.diff(owner[order]) > 0]]
        return found[first].astype(np.float64), np.array([spans[i][0] for i in first])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x, _ = self.document_logits(texts)
        base = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((x - self.model.cut) * self.model.slope + base, -40, 40)))


def _gradients(net: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Gradients of the logistic loss for windows x (steps, batch, inputs); also with respect to x."""
    n, grad, dx = HIDDEN, {}, np.zeros_like(x)
    runs = {d: _run(net, d, x @ net[f"W{d}"] + net[f"c{d}"], mask, True) for d in "fb"}
    states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    alpha, pooled, logit = _attend(net, states, mask)
    p = _sigmoid(logit)
    dl = ((p - y) * weight / weight.sum()).astype(np.float32)
    dc = dl[:, None] * net["w"]
    grad["w"], grad["b"] = pooled.T @ dl, dl.sum(keepdims=True)
    da = np.einsum("bh,tbh->tb", dc, states)
    ds = alpha * (da - (alpha * da).sum(axis=0))
    grad["q"] = np.einsum("tb,tbh->h", ds, states)
    dstates = alpha[:, :, None] * dc + ds[:, :, None] * net["q"]
    for k, d in enumerate("fb"):
        kept, u, w = runs[d][1], net[f"U{d}"], net[f"W{d}"]
        du, dw, dcb = np.zeros_like(u), np.zeros_like(w), np.zeros_like(net[f"c{d}"])
        dh = np.zeros((x.shape[1], n), np.float32)
        steps = range(len(x) - 1, -1, -1) if d == "f" else range(len(x))
        for t in steps:
            h, z, r, c, g = kept[t]
            dh = dh + dstates[t, :, k * n : (k + 1) * n]
            now = dh * mask[t]
            dan = now * (1 - z) * (1 - c * c)
            daz = now * (h - c) * z * (1 - z)
            dar = dan * g * r * (1 - r)
            into, back = np.concatenate([daz, dar, dan], axis=1), np.concatenate([daz, dar, dan * r], axis=1)
            du += h.T @ back
            dw += x[t].T @ into
            dcb += into.sum(axis=0)
            dx[t] += into @ w.T
            dh = now * z + dh * (1 - mask[t]) + back @ u.T
        grad[f"U{d}"], grad[f"W{d}"], grad[f"c{d}"] = du, dw, dcb
    return grad, dx, logit


def _fit(model: Model, samples: list[list[str]], y: np.ndarray, epochs: int, rng, rate: float = 0.01, batch: int = 256) -> None:
    """Adam on the network and AdaGrad on the learnt vectors, over windows of words."""
    distinct = {w: i for i, w in enumerate(dict.fromkeys(w for s in samples for w in s))}
    parts = model.parts(list(distinct))
    index = np.zeros((len(samples), WINDOW), np.int64)
    lengths = np.array([len(s) for s in samples])
    for i, s in enumerate(samples):
        index[i, : len(s)] = [distinct[w] for w in s]
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    m1, m2, step = {k: np.zeros_like(v) for k, v in model.net.items()}, {k: np.zeros_like(v) for k, v in model.net.items()}, 0
    seen_w, seen_g = np.full(len(model.word_vectors), 1e-4), np.full(len(model.gram_vectors), 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            used, local = np.unique(index[at], return_inverse=True)
            local = local.reshape(len(at), WINDOW).T
            own = parts.take(used)
            x = model.inputs(own)[local]
            mask = (np.arange(WINDOW)[:, None] < lengths[at])[:, :, None].astype(np.float32)
            grad, dx, _ = _gradients(model.net, x, mask, y[at], weight[at])
            step += 1
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                model.net[k] = (model.net[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            per_word = np.zeros((len(used), INPUTS))
            np.add.at(per_word, local.ravel(), (dx * mask).reshape(-1, INPUTS))
            _descend(model.word_vectors, seen_w, own.word, per_word[:, 3 : 3 + LEARNT] * (own.word > 0)[:, None])
            count = np.diff(own.start)
            shared = per_word[:, 3 + LEARNT :] / np.maximum(count, 1)[:, None]
            _descend(model.gram_vectors, seen_g, own.gram, np.repeat(shared, count, axis=0))


def _descend(vectors: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float = 0.02) -> None:
    """AdaGrad on the rows that a batch touches; a row met several times gets the sum."""
    used, local = np.unique(rows, return_inverse=True)
    total = np.zeros((len(used), vectors.shape[1]))
    np.add.at(total, local, gradient)
    seen[used] += (total * total).sum(axis=1)
    vectors[used] -= (rate * total / np.sqrt(seen[used])[:, None]).astype(np.float32)


def learn(texts: list[str | None], toxic: np.ndarray, seed: int = 11, rounds: int = 2, epochs: int = 8, words_kept: int = WORDS, grams_kept: int = GRAMS, evidence: int = EVIDENCE) -> Model:
    """A model from documents with labels. Without both classes, a model that scores all alike."""
    rng = np.random.default_rng(seed)
    split = [(t or "").split() for t in texts]
    split = [[w.lower().strip(EDGE) for w in s] for s in split]
    y = toxic.astype(np.int64)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    tables = []
    for units, limit in ((set, words_kept), (_grams_in, grams_kept)):
        # what fewer toxic documents hold is no evidence; only the rest is counted in the clean ones
        with_it = Counter(u for s, k in zip(split, y, strict=True) if k for u in units(s))
        names = sorted(u for u, n in with_it.items() if n >= evidence)
        known = set(names)
        without = Counter(u for s, k in zip(split, y, strict=True) if not k for u in known.intersection(units(s)))
        z = _strength(np.array([with_it[u] for u in names], float), np.array([without[u] for u in names], float), n1, n0)
        top = [i for i in np.argsort(-z, kind="stable")[:limit] if z[i] > 0]
        tables.append(({names[i]: r + 1 for r, i in enumerate(top)}, np.r_[0.0, z[top]].astype(np.float32)))
        del with_it, without, known
    (words, word_strength), (grams, gram_strength) = tables
    long = np.zeros(len(grams) + 1, bool)
    long[[r for g, r in grams.items() if len(g) > 4]] = True
    model = Model(words, grams, word_strength, gram_strength, long, rng.normal(0, 0.05, (len(words) + 1, LEARNT)).astype(np.float32), rng.normal(0, 0.05, (len(grams) + 1, LEARNT)).astype(np.float32), _new_net(rng))
    if not n1 or not n0:
        model.net["w"][:] = 0
        return model
    model.word_vectors[0] = 0
    distinct = list(set().union(*split))
    strong = dict(zip(distinct, model.inputs(model.parts(distinct))[:, [0, 2]].max(axis=1).tolist(), strict=True))

    def worst_by_strength(s):
        best = max(windows(len(s)), key=lambda se: sum(sorted((strong[w] for w in s[se[0] : se[1]]), reverse=True)[:2]))
        return best[0]

    starts = [worst_by_strength(s) for s in split]
    strong.clear()
    for _ in range(rounds):
        samples, labels = [], []
        for s, k, at in zip(split, y, starts, strict=True):
            picked = {at} if k else {at, windows(len(s))[rng.integers(len(windows(len(s))))][0]}
            for p in sorted(picked):
                if s[p : p + WINDOW]:
                    samples.append(s[p : p + WINDOW])
                    labels.append(k)
        _fit(model, samples, np.array(labels), epochs, rng)
        scorer, found, starts = Scorer(model), [], []
        for i in range(0, len(texts), 500):
            x, at = scorer.document_logits(texts[i : i + 500])
            found.extend(x)
            starts.extend(at)
    model.cut, model.slope = _cut(np.array(found), y)
    return model


def _cut(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The logit that parts the classes best, in the middle of its gap; an error on a clean document counts twice."""
    order = np.argsort(x, kind="stable")
    s, k = x[order], y[order]
    wrong = np.r_[2 * np.sum(k == 0), 2 * np.sum(k == 0) - np.cumsum(np.where(k == 0, 2, -1))]
    edges = np.r_[s[0] - 1, (s[:-1] + s[1:]) / 2, s[-1] + 1]
    best = np.flatnonzero(wrong <= wrong.min())
    return float(np.median(edges[best])), 1.0


def train(docs: DataFrame, labels: DataFrame, each: int = LABELLED) -> Model:
    """Learn from at most ``each`` documents of a class whose crc32(doc_id as text) mod 4 is not 2: so many texts come to the driver."""
    small_batches(docs.sparkSession)
    rows = labelled_texts(docs, labels, "toxic", fold("doc_id", 4) != 2, each).collect()
    rows.sort(key=lambda r: r.doc_id)
    return learn([r.text for r in rows], np.array([r.label for r in rows], bool))


_scorers: dict[int, Scorer] = {}


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of the whole text: its worst window's. Null and empty texts have no words and
    score near 0; a very long text has as many windows as it takes; equal texts get equal scores; an input column of
    the same name is replaced, all others stay; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two bounded vocabularies

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        own = shared.value
        if id(own) not in _scorers:
            _scorers.clear()
            _scorers[id(own)] = Scorer(own)
        return pd.Series(_scorers[id(own)].scores([t if isinstance(t, str) else None for t in texts]))

    return docs.withColumn(column, score(F.col("text").cast("string")))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score for every whole text. Null and empty texts score near 0; a very long text has more windows, of which the worst
    counts; equal texts get equal scores, repeated rows a row each; null ids are in the fold of the empty text; an empty
    table gives no rows; other columns are not read."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
