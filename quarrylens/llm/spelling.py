"""Spelling variants: words one edit apart, found through Bloom filters over the vocabulary.

Every word's deletions and substitutions are generated as hashes and probed against filters of the vocabulary, one
for each word length, that are broadcast to the tasks. Only the edits that a filter knows become strings and are
shuffled, to a join with the vocabulary itself that removes what the filters let through by mistake. An insertion
is a deletion seen from the longer word, and of two words that differ in one place the one with the smaller
letter asks, so every pair is met once.

A hash is the sum of a number for each letter times a number for its place, so the hash of an edit follows from that
of its word by one addition, for a whole batch of words at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import read, small_batches, tasks_for, written

#: Letters of a word.
RUN = "[A-Za-zÀ-ÿ]+"
MIN_POINTS, MIN_COUNT = 5, 3
#: A form must be so many times as frequent as the word.
FREQUENT = 2
#: One run in so many loses a letter, by the hash of document and run (the contract of the query).
DAMAGE = 97
#: Bits of a filter for each word, bits set for each word in one 64-bit block, and blocks of one of Spark's bitmaps.
BITS, SET, BLOCKS = 24, 4, 512
#: Words of this length and longer share a filter.
LONGEST = 64
#: Bytes of filters that are broadcast at once. A larger vocabulary is probed in several passes over slices of the filters.
FILTER_BYTES = 64 << 20
#: Different words that a task counts before it hands them on, and edits hashed at once.
HELD, CELLS = 400_000, 1 << 20


# --- the vocabulary


def _counts(damage: int | None, least: int):
    pattern = re.compile(RUN)

    def run(batches):
        held: dict[bytes, int] = {}

        def out():
            words = pa.array([w.decode() for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, n in Counter(pattern.findall(text or "")).items():
                    if len(word := found.encode().lower()) < least:  # bytes: only A-Z change
                        continue
                    if damage and not (h := zlib.crc32(word, start)) % damage:
                        points = word.decode()
                        word = (points[: h % len(points)] + points[h % len(points) + 1 :]).encode()
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damage: int | None = None, least: int = MIN_POINTS, count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the lower-cased (A-Z only) runs of letters of at least ``least`` code points that occur ``count`` times.

    Tasks count before they shuffle, so a frequent word leaves each of them a few times only. With ``damage``, runs
    whose hash with the document's id is divisible by it lose one letter; a null id then counts as the empty text. Null
    texts have no words; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    counts = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string")).mapInArrow(_counts(damage, least), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= count) & (F.char_length("word") >= least))


# --- hashes of words and of their edits


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letter(points: np.ndarray) -> np.ndarray:
    return _mixed(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _place(length: int) -> np.ndarray:
    return _mixed(np.arange(1, length + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _by_length(words: list[str]):
    """(length, places in ``words``) of each length among them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, edges) if len(order) else ():
        yield int(lengths[part[0]]), part


class Layout:
    """Where the filters of the lengths lie in one row of 64-bit blocks; each has a whole number of bitmaps."""

    def __init__(self, words_of: dict[int, int]):
        self.start, self.blocks, at = {}, {}, 0
        for length in sorted(words_of):
            maps = -(-words_of[length] * BITS // (64 * BLOCKS))
            self.start[length], self.blocks[length] = at, maps * BLOCKS
            at += maps * BLOCKS
        self.bitmaps = at // BLOCKS

    def find(self, length: int, hashes: np.ndarray):
        """The block and the bits of each hash; None where no word has this length."""
        k = min(length, LONGEST)
        if k not in self.start:
            return None
        h = _mixed(hashes)
        block = np.uint64(self.start[k]) + (((h >> np.uint64(32)) * np.uint64(self.blocks[k])) >> np.uint64(32))
        bits = np.zeros_like(h)
        for i in range(SET):
            bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
        return block, bits


def _postings(layout: Layout):
    """(bitmap, position) of every bit that the words set."""

    def run(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            for length, part in _by_length(words):
                own = _letter(_points([words[i] for i in part], length)) * _place(length)
                block, bits = layout.find(length, own.sum(axis=1, dtype=np.uint64))
                on = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, bit = np.nonzero(on)
                maps, rest = np.divmod(block[row].astype(np.int64), BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(maps), pa.array(rest * 64 + bit)], names=["bitmap", "position"])

    return run


def bloom_filters(words: DataFrame, layout: Layout) -> DataFrame:
    """(bitmap, bits): the filters of all lengths as bitmaps of 4096 bytes, by Spark's own bitmap aggregate."""
    bits = words.select("word").mapInArrow(_postings(layout), "bitmap long, position long")
    return bits.groupBy("bitmap").agg(F.bitmap_construct_agg("position").alias("bits"))


def _probes(words: list[str], length: int, alphabet: np.ndarray):
    """The edits of words of one length that lead to a word of this length or one less, some at a time: (length of the
    edit, its hashes as words x places x letters, first place). A substitution with a letter that is not larger, and a
    deletion that the place before gives too, are left out with the mask that goes along."""
    points = _points(words, length)
    here, letters = _letter(points), _letter(alphabet)
    place = _place(length)
    own = (here * place).sum(axis=1, dtype=np.uint64)
    if length > 1:
        before = np.cumsum(here * place, axis=1, dtype=np.uint64) - here * place
        moved = here[:, 1:] * place[:-1]  # what stands after the deleted letter moves one place down
        after = np.zeros_like(here)
        after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        first = np.ones(points.shape, bool)
        first[:, 1:] = points[:, 1:] != points[:, :-1]
        yield length - 1, (before + after)[:, :, None], first[:, :, None], 0
    step = max(1, CELLS // (len(words) * len(alphabet)))
    for at in range(0, length, step):
        part = slice(at, at + step)
        changed = own[:, None, None] + (letters[None, None, :] - here[:, part, None]) * place[None, part, None]
        yield length, changed, alphabet[None, None, :] > points[:, part, None], at


def _positives(layout: Layout, alphabet: list[str], low: int, high: int, filters):
    """(word, n, near): the edits that the broadcast slice of the filters knows."""
    codes = np.array(sorted(map(ord, alphabet)), np.uint32)
    letters = [chr(c) for c in codes]

    def found(words, counts, length):
        for size, hashes, asked, at in _probes(words, length, codes):
            place = layout.find(size, hashes)
            if place is None:
                continue
            block, bits = place
            inside = asked & (block >= np.uint64(low)) & (block < np.uint64(high))
            word, edit, letter = np.nonzero(inside)
            slot = block[word, edit, letter] - np.uint64(low)
            want = bits[word, edit, letter]
            hit = (filters.value[slot] & want) == want
            for i, j, k in zip(word[hit].tolist(), (edit[hit] + at).tolist(), letter[hit].tolist(), strict=True):
                w = words[i]
                yield w, counts[i], w[:j] + (letters[k] if size == length else "") + w[j + 1 :]

    def run(batches):
        for b in batches:
            words, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for length, part in _by_length(words):
                most = max(1, CELLS // (length * max(1, len(codes))))
                for i in range(0, len(part), most):
                    rows = part[i : i + most]
                    if out := list(found([words[k] for k in rows], [counts[k] for k in rows], length)):
                        a, n, near = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n, pa.int64()), pa.array(near, pa.string())], names=["word", "n", "near"])

    return run


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(a, n_a, b, n_b): every two words of the vocabulary (word, n) that differ by one inserted, deleted or replaced code
    point, once. ``words`` has each word once and is read several times, so it should be a written table.

    What the driver holds is bounded: the number of words of each length up to 64, the letters that the words use (with
    ``RUN`` at most 90) and ``filter_bytes`` of filters at a time."""
    spark = words.sparkSession
    small_batches(spark, 20_000)
    sizes = words.groupBy(F.least(F.char_length("word"), F.lit(LONGEST)).alias("length")).count().collect()
    layout = Layout({r["length"]: r["count"] for r in sizes})
    alphabet = [r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct().collect()]
    filters = written(bloom_filters(words, layout), "filters")
    dealt = words.select("word", "n").repartition(tasks_for(spark), "word")
    step, out = max(1, filter_bytes // (8 * BLOCKS)), None
    for low in range(0, max(1, layout.bitmaps), step):
        high = min(low + step, layout.bitmaps)
        blocks = np.zeros((high - low, BLOCKS), np.uint64)
        for r in filters.where(F.col("bitmap").between(low, high - 1)).collect():
            blocks[r["bitmap"] - low] = np.frombuffer(r["bits"], "<u8")
        shared = spark.sparkContext.broadcast(blocks.reshape(-1))
        part = dealt.mapInArrow(_positives(layout, alphabet, low * BLOCKS, high * BLOCKS, shared), "word string, n long, near string")
        out = part if out is None else out.unionByName(part)
    known = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    return out.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "near").join(known, F.col("near") == F.col("b")).select("a", "n_a", "b", "n_b")


# --- forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form) by pointer doubling: each round a word takes over the pointer of the word it
    points to. Forms grow in frequency, so chains have an end; a chain of n steps takes about log2(n) rounds."""
    at = written(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        ahead = at.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        at = written(at.join(ahead, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")), "pointers")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_variants(words: DataFrame, frequent: int = FREQUENT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of a vocabulary (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. The form of a word is its
    near word of largest n (ties: the smallest in code-point order) if that is at least ``frequent`` times the word's
    own (at least twice); root is where following the forms ends. A word has at most some hundred near words, so groups
    and join keys are small. Null words take no part; of a word in several rows the largest n counts; an empty
    vocabulary gives no rows; other columns are not read."""
    if frequent < 2:
        raise ValueError("a form must be at least twice as frequent, or forms could go round in a circle")
    words = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.max(F.col("n").cast("long")).alias("n"))
    words = written(words, "vocabulary")
    pairs = near_pairs(words, filter_bytes)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = pairs.select(F.inline(both)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    rows = words.join(best, "word", "left").withColumn("ok", -F.col("best.m") >= F.col("n") * frequent)
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("best.near")).alias("form"), F.when(F.col("ok"), -F.col("best.m")).alias("form_n"))
    rows = written(rows, "forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of all documents, damaged by the contract's rule, with their forms. Null and empty texts have no words, a very
    long text is one row of one batch, repeated rows count each, other columns are not read; no words give no rows."""
    return spelling_variants(vocabulary(read(spark, sf_dir, "documents"), damage=DAMAGE))
