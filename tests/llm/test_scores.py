"""Scores of operators 1 and 5 against a plain reading of their models: loops over letters, words and windows."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import quality, toxicity

from ..conftest import SF

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    """Words between any white space, as Python's own reading of a text has them."""
    return [w for w in re.split(r"\s+", text or "") if w]


# --- 1: toxicity


def word_inputs(model, word):
    word = word.lower().strip(toxicity.EDGE)
    row = model.words.get(word, 0)
    framed = "<" + word + ">"
    found = []
    for size in toxicity.SIZES:
        for at in range(len(framed) - size + 1):
            if framed[at : at + size] in model.grams:
                found.append(model.grams[framed[at : at + size]])
    short, long, mean = 0.0, 0.0, [0.0] * toxicity.LEARNT
    for g in found:
        if model.gram_long[g]:
            long = max(long, float(model.gram_strength[g]))
        else:
            short = max(short, float(model.gram_strength[g]))
        mean = [m + float(v) / len(found) for m, v in zip(mean, model.gram_vectors[g], strict=True)]
    return [float(model.word_strength[row]), short, long, *map(float, model.word_vectors[row]), *mean]


def gru(net, d, xs):
    """States after each word, one number at a time."""
    n = toxicity.HIDDEN
    w, u, c = (net[k + d].astype(float) for k in "WUc")
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    h, states = [0.0] * n, []
    for x in xs:
        a = [c[j] + sum(x[i] * w[i][j] for i in range(len(x))) for j in range(3 * n)]
        g = [sum(h[i] * u[i][j] for i in range(n)) for j in range(3 * n)]
        new = []
        for j in range(n):
            keep, reset = sigmoid(a[j] + g[j]), sigmoid(a[n + j] + g[n + j])
            candidate = math.tanh(a[2 * n + j] + reset * g[2 * n + j])
            new.append(h[j] + (1 - keep) * (candidate - h[j]))
        h = new
        states.append(h)
    return states


def window_logit(model, words):
    xs = [word_inputs(model, w) for w in words]
    ahead, back = gru(model.net, "f", xs), gru(model.net, "b", xs[::-1])[::-1]
    states = [a + b for a, b in zip(ahead, back, strict=True)]
    dot = lambda v, s: sum(float(x) * y for x, y in zip(v, s, strict=True))
    weights = [math.exp(dot(model.net["q"], s)) for s in states]
    pooled = [sum(w * s[i] for w, s in zip(weights, states, strict=True)) / sum(weights) for i in range(len(states[0]))]
    return dot(model.net["w"], pooled) + float(model.net["b"][0])


def toxic_score(model, text):
    words, logits = words_of(text), []
    for at in range(0, max(len(words), 1), toxicity.STRIDE):
        if part := words[at : at + toxicity.WINDOW]:
            logits.append(window_logit(model, part))
        if at + toxicity.WINDOW >= len(words):
            break
    worst = max(logits, default=-20.0)
    z = (worst - model.cut) * model.slope + math.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_toxicity_by_hand(spark):
    """Every window of short texts of all kinds and of one long one, forward pass by loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in toxicity.op1_toxicity(spark, SF).collect()}
    assert set(found) == set(texts)
    by_length = sorted(texts, key=lambda k: len(words_of(texts[k])))
    chosen = [*by_length[:25], *by_length[60:80:4], next(k for k in by_length if len(words_of(texts[k])) > 400)]
    toxic = [k for k in sorted(found) if found[k].predicted and len(words_of(texts[k])) < 400][:5]
    assert toxic
    for k in {*chosen, *toxic}:
        assert found[k].score == pytest.approx(toxic_score(model, texts[k]), abs=2e-4)
        assert found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and found[k].predicted == (found[k].score >= 0.3)


# --- 5: quality


def plain_features(text):
    raw = list((text or "").encode())
    words = [bytes(w) for w in re.split(rb"[ \t\n\x0b\x0c\r]+", bytes(raw)) if w]
    n = len(words)
    if not n:
        return [0.0] * len(quality.FEATURES)
    part = lambda ok: sum(1 for c in raw if ok(c)) / len(raw)
    among = lambda letters: part(lambda c: chr(c) in letters)
    count = lambda needle: len(re.findall(re.escape(needle), bytes(raw)))
    lines = [x for x in bytes(raw).split(b"\n") if x.strip(SPACE.encode())]
    titled = sum(1 for w in words if re.fullmatch(rb"[^A-Za-z]*(?:[A-Z][a-z]*[^A-Za-z]+)*(?:[A-Z][a-z]*)?[^A-Za-z]*", w) and re.search(rb"[A-Z]", w))
    return [
        math.log(1 + n), part(lambda c: 65 <= c <= 90), part(lambda c: 48 <= c <= 57), among(".,;:!?'\"()-"), among("#*$%&|<>{}[]=_~^\\/@+"), count(b"!!") / n, count(b" | ") / n, part(lambda c: c > 127),
        min(sum(len(w) for w in words) / n, 30) / 10, len(set(words)) / n, sum(1 for i in range(1, n) if words[i] == words[i - 1]) / n, len({(words[i], words[i + 1]) for i in range(n - 1)}) / max(1, n - 1),
        min(len(lines) / n, 1), 1 - len(set(lines)) / max(1, len(lines)), (raw.count(46) + raw.count(63)) / n, sum(1 for w in words if len(w) > 18) / n, titled / n, min(n, max(len(x) for x in bytes(raw).split(b"."))) / 1000,
    ]


def test_quality_by_hand(spark):
    """Features letter by letter and word by word for every document, and the ranking's sum by a loop."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in quality.op5_quality(spark, SF).collect()}
    assert set(found) == set(texts)
    for k, text in texts.items():
        x = plain_features(text)
        assert quality.features(text) == pytest.approx(x, rel=1e-12, abs=1e-12)
        x = x + [math.sqrt(abs(v)) for v in x]
        s = sum(float(w) * max(-8.0, min(8.0, (v - float(m)) / float(d))) for w, v, m, d in zip(model.weights, x, model.mean, model.scale, strict=True))
        score = 1 / (1 + math.exp(-max(-40.0, min(40.0, (s - model.cut) / model.slope))))
        assert found[k].score == pytest.approx(score, rel=1e-9) and found[k].predicted == (found[k].score >= 0.5)
        assert found[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_quality_weights_are_the_least_loss():
    """The weights leave no slope in the pairwise loss: recomputed pair by pair."""
    rng = np.random.default_rng(0)
    x = rng.random((60, len(quality.FEATURES)))
    good = x[:, 0] + 0.3 * rng.standard_normal(60) > 0.5
    model = quality.learn(x, good, 0.4, pairs=500)
    z = [[max(-8.0, min(8.0, (v - m) / d)) for v, m, d in zip([*r, *map(math.sqrt, r)], model.mean, model.scale, strict=True)] for r in x.tolist()]
    draw = np.random.default_rng(7)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = list(zip(draw.choice(up, 500), draw.choice(down, 500), strict=True))

    def loss(w):
        total = 0.0
        for a, b in pairs:
            margin = sum(wi * (p - q) for wi, p, q in zip(w, z[a], z[b], strict=True))
            total += math.log1p(math.exp(-margin))
        return total / len(pairs) + 1e-3 / 2 * sum(v * v for v in w)

    least = loss(model.weights.tolist())
    for i in range(0, len(model.weights), 5):
        for step in (-0.01, 0.01):
            moved = model.weights.tolist()
            moved[i] += step
            assert loss(moved) > least


def plain_cut(s, bad):
    """The middle of the widest gap beside a rank within half a per cent of the quantile, from all sorted scores."""
    s = sorted(s)
    near = [k for k in range(1, len(s)) if abs(k - bad) * 200 <= len(s)]
    k = max(near, key=lambda k: (s[k] - s[k - 1], -k))
    return (s[k] + s[k - 1]) / 2 if s[k] > s[k - 1] else s[bad - 1]


def test_quality_learns_from_all_pairs(spark):
    """No slope is left in the loss over every pair of the training fold, counted pair by pair; the cut is at the fold's own quantile."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    known = [r for r in docs.join(labels, "doc_id").where("quality IS NOT NULL").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    good = np.array([r.quality == 1 for r in known])
    z = quality.expanded(np.array([quality.features(r.text) for r in known]))
    assert model.mean == pytest.approx(z.mean(axis=0), abs=1e-9) and model.scale == pytest.approx(z.std(axis=0) + 1e-6, abs=1e-9)
    z = np.clip((z - model.mean) / model.scale, -8, 8)
    apart = (z[good][:, None] - z[~good][None]).reshape(-1, z.shape[1])
    wrong = 1 / (1 + np.exp(apart @ model.weights))
    assert len(apart) == good.sum() * (~good).sum() > 5000
    assert np.abs(-(wrong @ apart) / len(apart) + 1e-3 * model.weights).max() < 1e-7
    s = z @ model.weights
    assert model.cut == pytest.approx(plain_cut(s.tolist(), (~good).sum()), abs=1e-9) and model.slope == pytest.approx(s.std() / 4, rel=1e-9)


@pytest.mark.parametrize("kinds", [3, 50, 4001])
def test_quality_learns_from_every_labelled_row(spark, kinds):
    """Over 7,000 rows of one class; few kinds of texts, so that one score covers all ranks near the quantile, and many."""
    text = F.concat(F.repeat(F.lit("word "), (F.col("id") * 37 % kinds % 61 + 1).cast("int")), F.repeat(F.lit("x"), (F.col("id") * 37 % kinds % 97).cast("int")))
    table = spark.range(14_000).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") * 37 % kinds % 10 + F.col("id") % 11 / 5 > 1.1).cast("int").alias("quality"))
    known = [r for r in table.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x, good = np.array([quality.features(r.text) for r in known]), np.array([r.quality == 1 for r in known])
    model = quality.train(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    assert good.sum() > 7000 and len(known) > 9000
    assert model.mean == pytest.approx(quality.expanded(x).mean(axis=0), abs=1e-12)
    s = (quality.standardised(x, model.mean, model.scale) * model.weights).sum(axis=1)
    assert model.cut == pytest.approx(plain_cut(s.tolist(), (~good).sum()), abs=1e-12)
    found = quality.scored(table, model).groupBy("text").agg(F.count_distinct("score").alias("n"), F.max("score").alias("most"))
    assert found.where("n > 1").count() == 0  # equal texts on either side of a cut are no two kinds
    assert kinds > 3 or found.where("most = 0.5").count() == 1  # the cut is a score, to the last bit
    local = quality.learn(x, good, (~good).mean())
    assert model.weights == pytest.approx(local.weights, abs=1e-6) and model.cut == pytest.approx(local.cut, abs=1e-6)
