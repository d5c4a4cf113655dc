"""Packing documents into token windows by lexical retrieval.

Documents are tokenized once; whole windows of a long document stand alone, and the remaining tails
are packed. Tails are dealt in the order of a min-hash of their tokens, so likely neighbours meet, and
each task builds BM25 inverted index shards over bounded blocks of them, weighted by document
frequencies of the whole corpus. For every seed the index returns unused neighbours, best first, which fill
the seed's window; the last one is cut where the window ends and its rest is the next seed, so no window
but the last of a task is padded.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import small_batches, tasks_for, written

WINDOW = 1024
#: Parameters of the search: tails in one index shard (all that a seed can find), query terms of a seed, neighbours
#: returned at once. None drops a row: every tail is packed.
SHARD = 2048
TERMS = 24
NEIGHBOURS = 16
K1, B = 1.2, 0.75
#: Pieces remembered by a task, and new ones looked up in one call; settings of speed and memory only.
REMEMBERED, LEARNT = 600_000, 20_000
#: Keys in the sample that gives the edges of the parts, for each part: chosen by their hash, so the same in every run.
SAMPLED = 100


class Tokens:
    """Token ids of whole texts as unsigned 16-bit, equal to the tokenizers library's.

    The split pattern never joins a space that has a non-space on both sides to what precedes it, so
    a text cut before such spaces is tokenized piece by piece, and pieces are remembered. Texts with other
    white space around a space, or with the special token's name, go to the library whole."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids beyond 16 bits are not packed")
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in open(path.removesuffix(".json") + ".tiktoken", "rb"))}  # noqa: SIM115
        self.pieces = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[r for t, r in ranks.items() if t.startswith(b" ")]] = True
        self.known: dict[str, bytes | None] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Remember pieces, many in one call: each begins with the only space in it, and so does the first of its tokens."""
        fit = [p for p in pieces if p and p.strip() == p]
        if len(fit) < len(pieces):
            self.known.update(dict.fromkeys(pieces.difference(fit)))
        for i in range(0, len(fit), LEARNT):
            some = fit[i : i + LEARNT]
            found = np.array(self.pieces.encode_ordinary(" " + " ".join(some)), "<u2")
            starts, ids = (2 * np.flatnonzero(self.spaced[found])).tolist(), found.tobytes()
            if len(starts) != len(some):
                raise ValueError("the vocabulary parts a text elsewhere than before its spaces")
            self.known.update(zip(some, [ids[x:y] for x, y in zip(starts, [*starts[1:], len(ids)], strict=True)], strict=True))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; pieces new to all of them are looked up together."""
        whole = [any(s in t for s in self.specials) for t in texts]
        parts = [None if w else t.split(" ") for t, w in zip(texts, whole, strict=True)]
        if len(self.known) > REMEMBERED:
            self.known = {}
        self._learn(set().union(*(p[1:-1] for p in parts if p)).difference(self.known))
        return [self._joined(t, p) for t, p in zip(texts, parts, strict=True)]

    def _joined(self, text: str, parts: list[str] | None) -> np.ndarray:
        if parts and len(parts) > 1 and parts[0] and parts[-1] and not parts[0][-1].isspace() and not parts[-1][0].isspace():
            try:
                body = b"".join(map(self.known.__getitem__, parts[1:-1]))
            except TypeError:  # a piece that does not fit
                body = None
            if body is not None:
                first, last = (np.array(self.pieces.encode_ordinary(x), "<u2").tobytes() for x in (parts[0], " " + parts[-1]))
                return np.frombuffer(first + body + last, "<u2")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2")

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _signature(ids: np.ndarray) -> int:
    """Min-hash of neighbouring token pairs: tails that share text tend to share it."""
    x = ids.astype(np.uint64)
    pairs = x[:-1] * np.uint64(50261) + x[1:] if len(x) > 1 else x
    return int(((pairs + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).min()) if len(x) else 0


def _key(signature: int, doc_id: int | None, tail: bytes, place: int) -> int:
    """The place of a tail in one order of all: by min-hash, equal ones by a hash of document and tail, and rows that repeat
    both by their place in the input, so that any group of them can be dealt to several parts."""
    own = zlib.crc32(tail, zlib.crc32(b"%d" % doc_id if doc_id is not None else b""))
    return signature << 32 | own >> 8 << 8 | zlib.crc32(b"%d" % place) & 255


TOKENIZED = "doc_id long, doc_tokens long, crcs array<long>, tail binary, key long"


def _tokenize(path: str, end_id: int):
    def run(batches):
        encoder = tokens(path)
        places = itertools.count(TaskContext.get().partitionId() << 36)
        for b in batches:
            cols = [[], [], [], []]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.batch(texts), strict=True):
                ids = np.append(ids, np.uint16(end_id)).astype("<u2")
                full = len(ids) // WINDOW
                cols[0].append(len(ids))
                cols[1].append([_crc(ids[i * WINDOW : (i + 1) * WINDOW]) for i in range(full)])
                tail = ids[full * WINDOW :]
                cols[2].append(tail.tobytes())
                cols[3].append(_key(_signature(tail), doc_id, cols[2][-1], next(places)))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "doc_tokens", "crcs", "tail", "key"])

    return run


def _document_frequencies(batches):
    """(term, n) of a task's tails; term -1 carries their number and -2 their tokens."""
    n, total, df = 0, 0, np.zeros(1 << 16, np.int64)
    for b in batches:
        for tail in b.column(0).to_pylist():
            if tail:
                ids = np.frombuffer(tail, "<u2")
                df[np.unique(ids)] += 1
                n, total = n + 1, total + len(ids)
    terms = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *terms.tolist()], pa.int64()), pa.array([n, total, *df[terms].tolist()], pa.int64())], names=["term", "n"])


class Shard:
    """BM25 inverted index over a block of tails."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(tails)
        lengths = np.array([len(t) for t in tails])
        keys = np.concatenate(tails).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        keys, tf = np.unique(keys, return_counts=True)
        term, self.doc = keys // n, keys % n
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / max(mean, 1.0)))
        edge = np.r_[0, np.flatnonzero(np.diff(term)) + 1, len(term)]
        number = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        self.start, self.stop = edge[:-1].tolist(), edge[1:].tolist()
        order = np.lexsort((-self.weight, self.doc))
        begins = np.searchsorted(self.doc[order], np.arange(n + 1))
        self.queries = [number[order[a : min(a + TERMS, b)]].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]
        self.unused = np.ones(n)

    def neighbours(self, seed: int) -> list[int]:
        """The first unused tails by falling score, ties by place; those without a shared term come last."""
        scores = np.zeros(len(self.unused))
        for q in self.queries[seed]:
            a, b = self.start[q], self.stop[q]
            scores[self.doc[a:b]] += self.weight[a:b]
        scores = (scores + 1e-9) * self.unused
        least = np.partition(scores, -NEIGHBOURS)[-NEIGHBOURS] if len(scores) > NEIGHBOURS else 0.0
        top = np.flatnonzero(scores >= max(least, 1e-9))  # 1e-9 is an unused tail's own
        return top[np.lexsort((top, -scores[top]))][:NEIGHBOURS].tolist()


def _pack(stats):
    kinds = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]

    def run(batches):
        idf, mean = stats.value
        base = TaskContext.get().partitionId() << 32
        state = {"sequence": 0, "filled": 0}
        rows = []

        def place(doc, start, ids):
            """Put a piece into the open window."""
            rows.append((doc[0], start, len(ids), _crc(ids), doc[1], base + state["sequence"], state["filled"]))
            state["filled"] += len(ids)
            if state["filled"] == WINDOW:
                state["sequence"], state["filled"] = state["sequence"] + 1, 0

        def fill(doc, start, ids):
            """Place as much as fits; the rest opens the next window."""
            while len(ids):
                part = ids[: WINDOW - state["filled"]]
                place(doc, start, part)
                start, ids = start + len(part), ids[len(part) :]

        def block(docs):
            shard = Shard([d[3] for d in docs], idf, mean)
            left, seed, at = len(docs), None, 0
            while left:
                if seed is None:
                    while not shard.unused[at]:
                        at += 1
                    chosen = [at]
                else:
                    chosen = shard.neighbours(seed)
                window = state["sequence"]
                for i in chosen:
                    d = docs[i]
                    shard.unused[i] = 0
                    left -= 1
                    fill(d, d[2], d[3])
                    seed = i  # the seed of what follows: the tail that was cut, or else the last one
                    if state["sequence"] != window:
                        break

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
            rows.clear()
            return out

        pending = []
        for b in batches:
            for doc_id, n, crcs, tail in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "tail")), strict=True):
                if tail:
                    pending.append((doc_id, n, len(crcs) * WINDOW, np.frombuffer(tail, "<u2")))
                for k, crc in enumerate(crcs):
                    rows.append((doc_id, k * WINDOW, WINDOW, crc, n, base + (1 << 31) + state.setdefault("whole", 0), 0))
                    state["whole"] += 1
                if len(pending) == SHARD:
                    block(pending)
                    pending = []
            if rows:
                yield flush()
        if pending:
            block(pending)
        if rows:
            yield flush()

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows in the order of their keys over parts of like size, the same in every run: the edges are quantiles of the keys
    that a hash chooses, some ``SAMPLED`` for each part, and not of a random sample."""
    spark = rows.sparkSession
    parts = tasks_for(spark)
    every = max(1, rows.count() // (SAMPLED * parts))
    chosen = sorted(r[0] for r in rows.select("key").where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).collect())
    edges = np.array([chosen[len(chosen) * i // parts] for i in range(1, parts)] if chosen else [], np.int64)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), "right").astype(np.int32))

    return rows.withColumn("part", part("key")).repartitionById(parts, "part").sortWithinPartitions("key", "doc_id", "doc_tokens", "tail").drop("part")


def packed(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of windows of 1024 tokens.

    Null and empty texts are the end id alone. Every id of every row lies in one piece; repeated rows and
    null ids are packed like others. A piece names its window (sequence_id) and its offset there; only
    the last window of a task can be padded. An empty table gives no rows. Other columns are not read. Two runs over
    the same input in the same partitions, with as many shuffle partitions, give the same pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = written(source.mapInArrow(_tokenize(path, end_id), TOKENIZED), "tokenized")
    counts = dict(rows.select("tail").mapInArrow(_document_frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # at most the vocabulary
    n, df = counts.get(-1, 0), np.zeros(1 << 16)
    for term, k in counts.items():
        if term >= 0:
            df[term] = k
    stats = spark.sparkContext.broadcast((np.log1p((n - df + 0.5) / (df + 0.5)), counts.get(-2, 0) / max(n, 1)))
    return _dealt(rows).mapInArrow(_pack(stats), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents. Null and empty texts are the end id alone, a very long text is whole windows and a tail; repeated
    rows and null ids are packed like others; an empty table gives no rows; other columns are not read."""
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
