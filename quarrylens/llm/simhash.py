"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so at least
4 bytes agree in place. The index is keyed by groups of byte positions chosen so that any 4 agreeing positions
hold a whole group (a Turan covering). The members of a posting list are posted again by each single position and
byte; the bytes that a pair shares are tallied from these lists, pairs that reach 4 are kept, and only those
are verified bit by bit. Lists emit spanning links, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import small_batches, tasks_for, unused, written
from quarrylens.llm.components import components

MAX_BITS = 4
MIN_SHARED = 8 - MAX_BITS
#: Byte positions in a group. With 3 there are 20 groups and 2^24 lists in each, which keeps lists short up to some 10^10
#: different fingerprints; every width gives the same links.
WIDTH = 3
#: Longer posting lists are cut into blocks and every pair of blocks is compared in a group of its own.
BLOCK = 4096
#: Hot keys that are broadcast (16 bytes each); more are joined by a shuffle.
HOT_KEYS = 200_000
#: A list with more tallied pairs than so many for each member is searched from member to member instead.
DENSE = 8


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles; a text without words gives zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    k = min(size, n)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        found = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        kept = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(found, pa.int64())], names=[*kept, "fp"])


def position_groups(width: int) -> list[tuple[int, ...]]:
    """Groups of ``width`` of the 8 byte positions such that every 4 positions hold one of them."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    if width == 2:
        return [g for p in parts for g in combinations(p, 2)]
    if width == 3:
        inside = [g for p in parts for g in combinations(p, 3)]
        return inside + [(*two, one) for i, p in enumerate(parts) for two in combinations(p, 2) for one in parts[(i + 1) % 3]]
    return list(combinations(range(8), 4))


def _forest(fps: np.ndarray, shared: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all fingerprints of a dense list that are connected within it: from member to member, whose
    lists are tallied. ``shared``: the bytes of each, one row for each fingerprint."""
    n, links = len(fps), []
    order = [np.argsort(shared[:, p], kind="stable") for p in range(8)]
    start = [np.searchsorted(shared[o, p], np.arange(257)) for p, o in enumerate(order)]
    unseen = np.ones(n, bool)
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root], queue = False, [root]
        while queue:
            at = queue.pop()
            lists = [o[s[b] : s[b + 1]] for o, s, b in zip(order, start, shared[at].tolist(), strict=True)]
            near = np.flatnonzero((np.bincount(np.concatenate(lists), minlength=n) >= MIN_SHARED) & unseen)
            near = near[np.bitwise_count(fps[near] ^ fps[at]) <= MAX_BITS]
            unseen[near] = False
            links.extend((int(fps[at]), int(x)) for x in fps[near])
            queue.extend(near.tolist())
    return links


def _pairs_within(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of equal neighbours in a sorted array: all pairs of each run."""
    left, right, at, d = [], [], np.flatnonzero(runs[1:] == runs[:-1]), 1
    while len(at):
        left.append(at)
        right.append(at + d)
        d += 1
        at = at[at + d < len(runs)]
        at = at[runs[at] == runs[at + d]]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def tallied_links(lists: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Links within posting lists. ``lists`` (sorted) numbers the list of each fingerprint."""
    n = len(fps)
    edge = np.r_[0, np.flatnonzero(np.diff(lists) != 0) + 1]
    sizes = np.diff(np.r_[edge, n])
    own = np.repeat(np.arange(len(edge)), sizes)
    some = sizes[own] > 1
    fps, own = fps[some], np.unique(own[some], return_inverse=True)[1]
    n, sizes = len(fps), sizes[sizes > 1]
    if not n:
        return []
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    shared = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
    same = np.logical_and.reduceat(shared == shared[starts[own]], starts, axis=0)  # positions where a whole list agrees
    base = same.sum(axis=1)
    # the members once more, by list, position and byte, where a list does not agree as a whole
    row, position = np.nonzero(~same[own] & (base < MIN_SHARED)[own, None])
    key = (own[row] * 8 + position) * 256 + shared[row, position]
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    # how many pairs that is for each list; all pairs where the whole list reaches the minimum
    run = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
    length = np.diff(np.r_[run, len(key)])
    pairs = np.where(base < MIN_SHARED, 0, sizes * (sizes - 1) // 2)
    if len(key):
        np.add.at(pairs, key[run] // 2048, length * (length - 1) // 2)
    dense = pairs > DENSE * sizes
    links = []
    for k in np.flatnonzero(dense).tolist():
        at = slice(starts[k], starts[k] + sizes[k])
        links.extend(_forest(fps[at], shared[at]))
    keep = ~dense[own[row]] if len(row) else np.zeros(0, bool)
    i, j = _pairs_within(key[keep])
    pair, tally = np.unique(row[keep][i] * n + row[keep][j], return_counts=True)
    pair = pair[tally + base[own[pair // n]] >= MIN_SHARED]
    full = np.flatnonzero(~dense[own] & (base >= MIN_SHARED)[own])
    i, j = _pairs_within(own[full])
    a, b = np.r_[pair // n, full[i]], np.r_[pair % n, full[j]]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= MAX_BITS
    links.extend(zip(fps[a[near]].tolist(), fps[b[near]].tolist(), strict=True))
    return links


def _links(batches):
    """Sorted rows (group key, fp) to links; lists are carried over from batch to batch."""
    rest_g = rest_f = None

    def out(links):
        a = np.array([x for x, _ in links], np.uint64).view(np.int64)
        c = np.array([x for _, x in links], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    for b in batches:
        g = b.column(0).to_numpy(zero_copy_only=False)
        f = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if rest_g is not None:
            g, f = np.concatenate([rest_g, g]), np.concatenate([rest_f, f])
        if not len(g):
            continue
        cut = int(np.searchsorted(g, g[-1], "left"))
        if cut and (found := tallied_links(g[:cut], f[:cut])):
            yield out(found)
        rest_g, rest_f = g[cut:].copy(), f[cut:].copy()
    if rest_g is not None and (found := tallied_links(rest_g, rest_f)):
        yield out(found)


def similar_links(fps: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of column ``fp`` within 4 bits of each other."""
    spark = fps.sparkSession
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255))

    def key(number, group):
        out = F.lit(number).cast("long")
        for k in group:
            out = out * 256 + byte(k)
        return out

    postings = fps.select(F.explode(F.array(*[key(i, g) for i, g in enumerate(position_groups(width))])).alias("key"), "fp")
    hot = postings.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    hot = written(hot, "hot-lists")
    hot = F.broadcast(hot) if hot.count() <= HOT_KEYS else hot  # beside a table that is broadcast no key is hot
    postings = postings.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.xxhash64("key", F.least(own, c), F.greatest(own, c)))
    grouped = postings.select(F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(F.array(F.xxhash64("key")))).alias("group"), "fp")
    dealt = grouped.repartition(tasks_for(spark), "group").sortWithinPartitions("group")
    return dealt.mapInArrow(_links, "a long, b long")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_a, row_b, fp): the fingerprint of every row as a signed long, and two hashes of id and text that
    together tell rows apart where ids are null or repeated."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.select("doc_id", *row_hashes("doc_id", "text"), "text").mapInArrow(_fingerprints, "doc_id long, row_a long, row_b long, fp long")


def row_hashes(doc_id: str, text: str) -> list:
    """Two independent hashes of a row's id and text; null differs from every value."""
    columns = [F.col(doc_id).cast("long"), F.col(text).cast("string"), F.col(doc_id).isNull(), F.col(text).isNull()]
    return [F.xxhash64(F.lit(seed), *columns).alias(name) for seed, name in ((3, "row_a"), (17, "row_b"))]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_a, row_b, fp, root, component_id), one row per document; component_id is the smallest doc_id
    reachable, root a fingerprint that names the component whatever its ids are.

    Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints are one
    node, so copies cost nothing beyond their row; repeated rows and ids are kept. Null ids never become
    a component_id unless all ids of a component are null. An empty table gives no rows. Other columns are
    not read. Two list keys of one hash would only add comparisons, never links.
    """
    rows = written(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    small_batches(docs.sparkSession, 20_000)
    roots = components(similar_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    small_batches(docs.sparkSession)
    classes = written(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    # written, so that the join below has plain exchanges on both sides and a component of very many nodes can be split
    smallest = written(classes.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = classes.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "row_a", "row_b", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component that with the smallest id (null last),
    then the smallest fingerprint. Of rows equal in id and text one stays, whichever is met first. Null ids are no
    group of their own. An empty table gives no rows."""
    a, b = unused("row_a", docs.columns), unused("row_b", docs.columns)
    found = near_duplicates(docs, doc_id, text)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "row_a", "row_b")
    kept = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row_a").alias(a), F.col("first.row_b").alias(b))
    rows = docs.withColumns(dict(zip((a, b), row_hashes(doc_id, text), strict=True))).dropDuplicates([a, b])
    return rows.join(kept, [a, b], "left_semi").select(*[f"`{c}`" for c in docs.columns])


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """A row for each document. Null and empty texts have the fingerprint zero and are linked like others, very long ones are read
    whole; repeated rows and null ids have rows of their own; an empty table gives no rows; other columns are not read."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
