"""Hard negatives by threshold joins on an inverted index with suffix-norm bounds.

A shard of integer vectors is indexed by dimension, the heaviest dimensions first. What the dimensions from one on can
add to a product is at most the product of both suffix norms. So for a threshold only the postings count whose
suffixes could still reach it together; each list is kept in the order of its suffix norms, and the dimensions that
the bound covers are its tail, which is not read. The heads give partial scores; a vector whose partial score and
remaining norms stay below the threshold is pruned, and the rest is verified by the whole product. If the windows
of a query are not full the threshold is lowered: the heads grow, and what was read before is not read again.

Two joins: anchors with the rows of their own label find the positives, and the positives' scores are the windows that
anchors with all rows fill with rows of other labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm import vectors
from quarrylens.llm.common import read, written

#: Each threshold is this part of the one before.
LOWER = 0.85
#: Integer components beyond this are taken as this: the products of larger ones need not fit into a long.
LARGEST = 1 << 28
#: Labels with more rows than a shard that are broadcast (at most rows / shard of them); more are joined by a shuffle.
HOT_LABELS = 100_000


class Index:
    """The posting lists of one shard of integer vectors."""

    def __init__(self, y: np.ndarray):
        order = np.argsort(-np.square(y.astype(np.float64)).sum(axis=0), kind="stable")
        self.order, self.y = order, np.ascontiguousarray(y[:, order])
        self.columns, self.suffix = np.ascontiguousarray(self.y.T), _suffix_norms(self.y)
        self.largest = int(np.abs(y).max(initial=0))
        self.doubles = self.y.astype(np.float64)
        self.lists = []
        for d in range(self.y.shape[1]):
            rows = np.flatnonzero(self.y[:, d])
            rows = rows[np.argsort(-self.suffix[rows, d], kind="stable")]
            self.lists.append((rows, self.y[rows, d], -self.suffix[rows, d]))

    def search(self, q: np.ndarray):
        return Search(self, q[self.order])


def _suffix_norms(y: np.ndarray) -> np.ndarray:
    """Norms of what is left from each dimension on, and 0 at the end; a little above the true ones."""
    squares = np.square(y.astype(np.float64))
    sums = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.hstack([np.sqrt(sums) * (1 + 1e-9), np.zeros((len(y), 1))])


class Search:
    """One query against a shard: all rows that reach a threshold, for thresholds that fall."""

    def __init__(self, index: Index, q: np.ndarray):
        self.index, self.q, self.suffix = index, q, _suffix_norms(q[None])[0]
        n = len(index.y)
        self.partial, self.read, self.known = np.zeros(n, np.int64), np.zeros(len(q), np.int64), np.zeros(n, bool)
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lower_to(self, threshold: float) -> None:
        """Afterwards every row whose score reaches the threshold is among ``rows`` with its score; a few others are too."""
        index, partial = self.index, self.partial
        with np.errstate(divide="ignore", invalid="ignore"):
            need = threshold / self.suffix  # a posting counts if its suffix norm reaches this
        for d, (rows, values, negative) in enumerate(index.lists):
            if not self.q[d]:
                continue
            head = len(rows) if threshold <= 0 else int(np.searchsorted(negative, -need[d], "right"))
            if not self.read[d] and 2 * head > len(rows):  # most of a list is read as a whole column
                partial += self.q[d] * index.columns[d]
                self.read[d] = len(rows)
            elif head > self.read[d]:
                part = slice(int(self.read[d]), head)
                partial[rows[part]] += self.q[d] * values[part]  # a row is in a list once
                self.read[d] = head
        if threshold <= 0:  # all lists are read to their ends: partial scores are whole
            rows = np.flatnonzero(~self.known)
        else:
            rows = np.flatnonzero((partial > 0) & ~self.known)  # what is unread is below the threshold
            first = np.zeros(len(rows), np.int64)  # the first dimension that the threshold does not ask for, by halving
            for step in (1 << k for k in reversed(range(len(need).bit_length()))):
                on = np.minimum(first + step, len(need))
                first = np.where(index.suffix[rows, on - 1] >= need[on - 1], on, first)
            first = np.minimum(first, len(need) - 1)
            rows = rows[partial[rows] + index.suffix[rows, first] * self.suffix[first] >= threshold]
        self.known[rows] = True
        self.rows = np.concatenate([self.rows, rows])
        self.scores = np.concatenate([self.scores, self._products(rows)])

    def _products(self, rows: np.ndarray) -> np.ndarray:
        """Whole products; in doubles where these hold every sum exactly."""
        if self.index.largest * int(np.abs(self.q).max(initial=0)) * len(self.q) < 1 << 53:
            return (self.index.doubles[rows] @ self.q.astype(np.float64)).astype(np.int64)
        return self.index.y[rows] @ self.q


def _lowered(top: float, floor: float):
    """Thresholds from ``top`` down to ``floor``, which is the last."""
    while top > max(floor, 1.0):
        yield top
        top *= LOWER
    yield floor


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _table(schema: str, out: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = list(zip(*out, strict=True)) if out else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


POSITIVES = "anchor_id long, anchor_which long, positive_id long, positive_which long, positive_score long"
NEGATIVES = "anchor_id long, anchor_which long, positive_id long, positive_which long, negative_id long, negative_which long, positive_score long, negative_score long"


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            ids, which = vectors.longs(rows, "id"), vectors.longs(rows, "which")
            keep = vectors.once(ids, which)
            ids, which = ids[keep], which[keep]
            index = Index(vectors.matrix(rows, "vector")[keep].astype(np.int64))
            own_ids, own_which, q = vectors.longs(anchors, "id"), vectors.longs(anchors, "which"), vectors.matrix(anchors, "vector").astype(np.int64)
            for i in vectors.once(own_ids, own_which):
                search = index.search(q[i])
                for threshold in _lowered(LOWER * search.suffix[0] * index.suffix[:, 0].max(), 0.0):
                    search.lower_to(threshold)
                    other = (ids[search.rows] != own_ids[i]) | (which[search.rows] != own_which[i])
                    if (search.scores[other] >= threshold).sum() >= k:
                        break
                found, scores = search.rows[other], search.scores[other]
                for at in _best(scores, ids[found], k):
                    out.append((own_ids[i], own_which[i], ids[found[at]], which[found[at]], scores[at]))
        return _table(POSITIVES, out)

    return run


def _negatives(k: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            ids, which = vectors.longs(rows, "id"), vectors.longs(rows, "which")
            labels = np.array(rows.column("label").to_pylist() + anchors.column("label").to_pylist(), object)
            labels = np.unique(labels, return_inverse=True)[1]
            labels, own_labels = labels[: len(ids)], labels[len(ids) :]
            keep = vectors.once(ids, which)
            ids, which, labels = ids[keep], which[keep], labels[keep]
            index = Index(vectors.matrix(rows, "vector")[keep].astype(np.int64))
            own_ids, own_which, q = vectors.longs(anchors, "id"), vectors.longs(anchors, "which"), vectors.matrix(anchors, "vector").astype(np.int64)
            for i in vectors.once(own_ids, own_which):
                windows = [(-(-low * p["positive_score"] // high), p["positive_score"], p) for p in anchors.column("positives")[int(i)].as_py()]
                floor = min(w[0] for w in windows)
                search = index.search(q[i])
                for threshold in _lowered(LOWER * min(w[1] for w in windows), float(floor)):
                    search.lower_to(threshold)
                    other = labels[search.rows] != own_labels[i]
                    found, scores = search.rows[other], search.scores[other]
                    full = [((scores >= max(threshold, least)) & (scores <= most)).sum() >= k for least, most, _ in windows]
                    if all(done or threshold <= least for done, (least, *_) in zip(full, windows, strict=True)):
                        break
                for least, most, p in windows:
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    for at in inside[_best(scores[inside], ids[found[inside]], k)]:
                        out.append((own_ids[i], own_which[i], p["positive_id"], p["positive_which"], ids[found[at]], which[found[at]], most, scores[at]))
        return _table(NEGATIVES, out)

    return run


def hard_negatives(df: DataFrame, is_anchor: Column, k: int = 5, low: int = 80, high: int = 100, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", shard: int = vectors.SHARD) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor row its ``k`` best other rows of
    its label, and for each of these the ``k`` best rows of other labels with low * positive_score <= high * negative_score <=
    high * positive_score. A score is the inner product of floor(scale * component) of both; higher is better, ties go
    to the smaller id.

    The join is exact: every row is indexed, nothing caps candidates. Rows with a null id or label, and vectors null,
    empty or with a null or non-finite component, take no part. Labels are compared as texts, vectors with those of
    their own length. A zero vector has the score 0 with every other. A positive with a negative score has no window. Rows
    equal in id, label and vector are one row; rows that only share an id are rows of their own. An empty table gives
    no rows; other columns are not read. A label that many rows share is dealt over several shards."""
    values = F.col(vector).cast("array<double>")
    good = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & vectors.usable(vector))
    whole = F.transform(values, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.least(F.greatest(x, F.lit(-1e15)), F.lit(1e15)) * scale))))
    text = F.col(label).cast("string")
    columns = [F.col(vec_id).cast("long").alias("id"), F.xxhash64(values, text, F.col(vec_id)).alias("which"), text.alias("label"), whole.cast("array<int>").alias("vector"), F.size(vector).alias("length")]
    good = written(good.select(*columns, F.coalesce(is_anchor, F.lit(False)).alias("asks")), "integer-vectors")
    n, asking = good.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = vectors.grid(df, n, asking, shard)

    hot = written(good.groupBy("length", "label").count().where(F.col("count") > shard).select("length", "label", F.ceil(F.col("count") / shard).cast("int").alias("shards")), "hot-labels")
    hot = F.broadcast(hot) if hot.count() <= HOT_LABELS else hot
    dealt = good.join(hot, ["length", "label"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    own = dealt.where("asks").drop("asks")
    found = vectors.cells(dealt.drop("asks"), own, F.col("shards"), -(-asking // vectors.MOST) or 1, _positives(k), POSITIVES, ("length", "label"))
    best = Window.partitionBy("anchor_id", "anchor_which").orderBy(F.desc("positive_score"), "positive_id", "positive_which")
    positives = written(found, "same-label").withColumn("place", F.row_number().over(best)).where((F.col("place") <= k) & (F.col("positive_score") >= 0))
    windows = positives.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_which").alias("which")).agg(F.collect_list(F.struct("positive_id", "positive_which", "positive_score")).alias("positives"))  # at most k
    anchors = good.where("asks").drop("asks").join(windows, ["id", "which"])

    found = vectors.cells(good.drop("asks"), anchors, shards, blocks, _negatives(k, low, high), NEGATIVES, ("length",))
    best = Window.partitionBy("anchor_id", "anchor_which", "positive_id", "positive_which").orderBy(F.desc("negative_score"), "negative_id", "negative_which")
    ranked = written(found, "other-labels").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """Five hard negatives for each positive of every 100th vector, over labels of which some are shifted as the contract says. Odd
    rows as in ``hard_negatives``: rows without label or with an unusable vector take no part, ties go to the smaller id,
    repeated rows are one, an empty table gives no rows."""
    df = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df.withColumn("label", label), F.col("vec_id") % 100 == 0)


#: The contract in SQL. Null and non-finite components do not occur in the tables and are left out alike.
ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, CAST(list_dot_product(a.e, o.e) AS BIGINT) AS score FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5
"""
