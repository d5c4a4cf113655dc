"""Operators 11 to 13: nearest neighbours, spelling variants, hard negatives."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import negatives, neighbours, spelling

from ..conftest import SF, same

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, rows, schema=VECTORS):
    """The rows with columns whose names clash with what the operators add."""
    clash = {c: F.lit("x") for c in ("id", "which", "shard", "block", "score", "rank", "length", "vector")}
    return spark.createDataFrame(rows, schema).withColumns(clash).repartition(3)


def odd_vectors(seed=3, n=400, d=6):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v], int(i % 4)) for i, v in enumerate(rng.standard_normal((n, d)).astype(np.float32))]
    rows += [(n + i, rows[1][1], 1) for i in range(30)]  # a group of copies
    rows += [rows[0], rows[100], rows[5]]  # repeated rows
    rows += [(0, rows[7][1], 0), (9000, None, 1), (9001, [], 1), (9002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (9003, [NAN] * d, 1), (9004, [INF] * d, 1), (None, rows[3][1], 1), (9100, [0.0] * d, 2), (9200, [1.0, 2.0], 2), (9300, [1.0, 2.5], 3), (100, rows[8][1], None)]
    return rows


# --- 11: nearest neighbours


def nearest_by_hand(rows, k):
    good = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(np.square(np.array(u) - np.array(v)).sum())), i) for i, u in good if len(u) == len(v) and (i, u) != (q, v))
            out += [(q, rank, i, d) for rank, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [100, 100_000])
def test_neighbours_by_hand(spark, shard):
    rows = odd_vectors()
    got = sorted(map(tuple, neighbours.nearest_neighbours(vectors_of(spark, rows), F.col("vec_id") % 100 == 0, miss=0.0, shard=shard).collect()))
    want = nearest_by_hand(rows, 10)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    hits = len(set((q, i, round(d, 9)) for q, _, i, d in got) & set((q, i, round(d, 9)) for q, _, i, d in want))
    assert hits >= 0.99 * len(want)


def test_neighbours_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = neighbours.op11_neighbours(spark, SF)
    assert [f.name for f in found.schema] == ["query_id", "rank", "vec_id", "score"]
    want = nearest_by_hand([tuple(r) for r in table.collect()], 10)
    got = found.collect()
    exact = {(q, i): d for q, _, i, d in want}
    assert sum((r.query_id, r.vec_id) in exact for r in got) >= 0.9 * len(want) and len(got) == len(want)
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], rel=1e-12) for r in got if (r.query_id, r.vec_id) in exact)
    for q in {r.query_id for r in got}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)


def test_neighbours_few_and_none(spark):
    few = neighbours.nearest_neighbours(vectors_of(spark, [(0, [1.0], 1), (1, [2.0], 1), (100, [2.0], 1)]), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, few.collect())) == [(0, 1, 1, 1.0), (0, 2, 100, 1.0), (100, 1, 1, 0.0), (100, 2, 0, 1.0)]
    assert neighbours.nearest_neighbours(vectors_of(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.nearest_neighbours(vectors_of(spark, [(1, [1.0], 1)]), F.col("vec_id") % 100 == 0).count() == 0


def test_threshold_keeps_its_promise():
    rng = np.random.default_rng(1)
    turned = neighbours.directions_of(16, 96)
    assert turned.shape == (16, 96) and np.allclose(np.linalg.norm(turned, axis=0), 4)
    at = neighbours.collision_threshold(16, 96, 1.2, 0.02)
    x = rng.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ((np.abs(x @ turned) <= 1.2).sum(axis=1) >= at).mean() > 0.95


# --- 12: spelling variants


def words_by_hand(docs, damage=97):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if damage and h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def variants_by_hand(n):
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def variant_rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def test_spelling_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = variants_by_hand(words_by_hand([tuple(r) for r in docs]))
    assert variant_rows(spelling.op12_spelling(spark, SF)) == want and sum(r[1] is not None for r in want) > 20


@pytest.mark.parametrize("filter_bytes", [4096, 64 << 20])
def test_spelling_passes_and_chains(spark, filter_bytes):
    """Words that grow out of each other, repeated letters, letters beyond ASCII, very long words; filters in slices."""
    rng = np.random.default_rng(5)
    n = {"".join(rng.choice(list("abcß"), 5 + i % 5)): int(rng.integers(3, 40)) for i in range(1500)}
    n |= {"chains": 3, "chain": 6, "chaîn": 12, "chaîns": 24, "aaaaa": 5, "aaaaaa": 10, "aaaaaaa": 20, "b" * 3000: 9, "b" * 2999: 4, "b" * 63: 3, "b" * 64: 30, "b" * 65: 3}
    df = spark.createDataFrame([*n.items(), (None, 3), ("aaaaa", 2), ("lonelyword", None)], "word string, n long").withColumns({"form": F.lit(1), "near": F.lit(2), "length": F.lit(3)}).repartition(3)
    assert variant_rows(spelling.spelling_variants(df, filter_bytes=filter_bytes)) == variants_by_hand(n)


def test_vocabulary_edges(spark):
    rows = [(1, "Hello hello HELLO Ärger-ärger Ärger ÄRGER"), (None, "hello×÷ hello×÷ hello×÷"), (2, None), (3, ""), (4, "longer " * 50_000), (5, "日本語 word"), (6, "x" * 200_000), (6, "x" * 200_000), (6, "x" * 200_000)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(0)}).repartition(4)
    for damage in (97, 2, None):
        assert {r.word: r.n for r in spelling.vocabulary(df, damage=damage).collect()} == words_by_hand(rows, damage)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.vocabulary(empty)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty.select(F.col("text").alias("word"), F.col("doc_id").alias("n")), frequent=1)


def test_edit_hashes_are_those_of_the_edits():
    letters = np.array(sorted(map(ord, "abcdeß")), np.uint32)
    plain = lambda w: int((spelling._letter(spelling._points([w], len(w))) * spelling._place(len(w))).sum(dtype=np.uint64))
    word, seen = "abbcß", {}
    for size, hashes, asked, at in spelling._probes([word], 5, letters):
        for i, j in zip(*np.nonzero(np.broadcast_to(asked, hashes.shape)[0]), strict=True):
            edit = word[: at + i] + (chr(letters[j]) if size == 5 else "") + word[at + i + 1 :]
            seen[edit] = int(hashes[0, i, j])
    assert len(seen) == 4 + sum(chr(c) > w for w in word for c in letters) and all(plain(e) == h for e, h in seen.items())


# --- 13: hard negatives


def negatives_by_hand(rows, k=5):
    good = {(i, str(label), tuple(int(np.floor(256 * float(x))) for x in v)) for i, v, label in rows if None not in (i, v, label) and v and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=True))
    out = []
    for a in (g for g in good if g[0] % 100 == 0):
        others = [(g, dot(a, g)) for g in good if g != a and len(g[2]) == len(a[2])]
        first = sorted((-s, g[0], g) for g, s in others if g[1] == a[1])[:k]
        for s, i, _ in first:
            inside = sorted((-t, g[0]) for g, t in others if g[1] != a[1] and -80 * s <= 100 * t <= -100 * s)[:k]
            out += [(a[0], i, rank, j, -s, -t) for rank, (t, j) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [50, 100_000])
def test_negatives_by_hand(spark, shard):
    rows = odd_vectors()
    got = negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 100 == 0, shard=shard)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)


def test_negatives_against_sql(spark, duck):
    same(negatives.op13_negatives(spark, SF), duck, negatives.ORACLE)


def test_negatives_large_components_and_none(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate((rng.standard_normal((300, 4)) * 200_000).astype(np.float32))]
    got = negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)
    huge = [(0, [3e38, 0.0], 1), (1, [3e38, 0.0], 1), (2, [2e38, 1.0], 2)]
    assert [(r.negative_id, r.negative_score == r.positive_score) for r in negatives.hard_negatives(vectors_of(spark, huge), F.col("vec_id") == 0).collect()] == [(2, True)]
    assert negatives.hard_negatives(vectors_of(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_search_finds_all_above_every_threshold():
    rng = np.random.default_rng(4)
    y = rng.integers(-300, 300, (500, 12)) * (rng.random((500, 12)) < 0.4)
    index = negatives.Index(y)
    for q in y[:20]:
        search, scores = index.search(q), y @ q
        for threshold in (900_000.0, 400_000.0, 90_000.0, 5000.0, 1.0, 0.0):
            search.lower_to(threshold)
            found = dict(zip(search.rows.tolist(), search.scores.tolist(), strict=True))
            assert set(np.flatnonzero(scores >= threshold)) <= set(found) and all(scores[i] == s for i, s in found.items())
        assert len(found) == len(y)
