"""Byte-pair encoding and decoding through a minimal acyclic transducer.

Spark counts the stretches between white space of the whole corpus; the words of the most frequent ones are
compiled into a minimal acyclic automaton (equal suffixes shared) whose path numbers point to their token
ids. The file is a few megabytes, is broadcast, and every Python worker maps it into memory. Words outside it
are merged exactly, many at a time in numpy.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylens.llm.common import ASCII_SPACE, small_batches, written

#: Words compiled into the automaton; stretches and words that a worker remembers in each of two generations.
LEXICON_WORDS = 65_536
REMEMBERED = 200_000
#: Words of more bytes are merged through a heap, in n log n steps; a setting of speed only, both ways are exact.
LONG = 64


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes take the code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairRanks:
    """Ranks of many pairs at once: an open-addressing table in arrays. ``NONE`` stands for a pair that never merges."""

    NONE = 1 << 30
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[int, int]):
        self.bits = max(4, (4 * len(ranks)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int64)
        keys, values = np.array(list(ranks), np.int64), np.array(list(ranks.values()), np.int64)
        slots = self._slots(keys)
        while len(keys):  # of the keys that meet in a free slot one is written, the others go on
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.ranks[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20 | right).ravel()
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.ranks[slots], self.NONE)
        on = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        while len(on):
            slots[on] = (slots[on] + 1) & ((1 << self.bits) - 1)
            out[on] = np.where(self.keys[slots[on]] == keys[on], self.ranks[slots[on]], self.NONE)
            on = on[(self.keys[slots[on]] != keys[on]) & (self.keys[slots[on]] >= 0)]
        return out.reshape(left.shape)


class Vocabulary:
    """What the tokenizer file says: ids, merges, special tokens, and the split pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.ids = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = {i: t for t, i in (*self.ids.items(), *self.specials.items())}
        self.shown = {i: (b"%d" % i, t.encode("utf-8")) for i, t in self.tokens.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {self.ids[a] << 20 | self.ids[b]: i for i, (a, b) in enumerate(merges)}  # by both ids in one number
        self.made = [self.ids[a + b] for a, b in merges]
        self.pairs = PairRanks(self.ranks)
        self.made_ids = np.array([*self.made, 0], np.int64)
        suffix = model.get("end_of_word_suffix") or ""
        split = next(p for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.letters = byte_letters()
        self.inner, self.ending = [self.ids[c] for c in self.letters], [self.ids[c + suffix] for c in self.letters]
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.library = Tokenizer.from_file(path)  # normalises and splits stretches beyond Latin; never encodes

    def words(self, raw: str) -> list[str]:
        """Words of a stretch of text without ASCII white space, normalised and split as the file says (NFC, lower case letter by letter)."""
        if max(raw) < "\u0180":  # Latin letters: composed already, and classed alike in every Unicode version
            low = raw.lower()
            if low.isalpha():
                return [low]
            if low[-1] in ".,;:!?" and low[:-1].isalpha():
                return [low[:-1], low[-1]]
            return self.pattern.findall(low)
        text = self.library.normalizer.normalize_str(raw)
        letters = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return [bytes(self.bytes[c] for c in w).decode("utf-8") for w in letters]

    def merged(self, word: str) -> list[int]:
        """Token ids of one word: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
        *head, tail = word.encode("utf-8")
        parts = [self.inner[b] for b in head]
        parts.append(self.ending[tail])
        if len(parts) > LONG:
            return self._merged_long(parts)
        rank, none = self.ranks.get, 1 << 30
        pairs = [rank(a << 20 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [self.made[best]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] << 20 | parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] << 20 | parts[i + 1], none)
        return parts

    def merged_many(self, words: list[bytes]) -> list[list[int]]:
        """``merged`` of each word (UTF-8, not empty): one merge in every word of a length at each step."""
        out: list = [None] * len(words)
        inner, ending, none = np.array(self.inner, np.int64), np.array(self.ending, np.int64), PairRanks.NONE
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, places in by_length.items():
            if n > LONG or len(places) < 4:
                for k in places:
                    out[k] = self.merged(words[k].decode("utf-8"))
                continue
            at = np.array(places)
            raw = np.frombuffer(b"".join([words[k] for k in places]), np.uint8).reshape(-1, n)
            parts = np.concatenate([inner[raw[:, :-1]], ending[raw[:, -1:]], np.full((len(at), 1), -1)], axis=1)
            ranks = np.full((len(at), n + 1), none)
            ranks[:, : n - 1] = self.pairs.get(parts[:, : n - 1], parts[:, 1:n])
            columns = np.arange(n + 1)
            while len(at):
                i = ranks.argmin(axis=1)
                row = np.arange(len(at))
                best = ranks[row, i]
                done = best == none
                if done.any():
                    for k, ids in zip(at[done].tolist(), parts[done].tolist(), strict=True):
                        out[k] = ids[: ids.index(-1)]
                    at, parts, ranks, i, best = at[~done], parts[~done], ranks[~done], i[~done], best[~done]
                    row = np.arange(len(at))
                    if not len(at):
                        break
                shift = np.minimum(columns + (columns > i[:, None]), n)
                parts, ranks = np.take_along_axis(parts, shift, 1), np.take_along_axis(ranks, shift, 1)
                made = parts[row, i] = self.made_ids[best]
                # the pair after the merged one, and the one before it
                right = parts[row, i + 1]
                ranks[row, i] = np.where(right >= 0, self.pairs.get(made, np.maximum(right, 0)), none)
                before = np.flatnonzero(i)
                ranks[before, i[before] - 1] = self.pairs.get(parts[before, i[before] - 1], made[before])
        return out

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same merges over a linked list, the next pair from a heap of (rank, place)."""
        n, rank = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] << 20 | parts[j]) != r:
                continue  # merged away, or another pair stands here by now
            parts[i], parts[j], after[i] = self.made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (new := rank(parts[left] << 20 | parts[right])) is not None:
                    heapq.heappush(heap, (new, left))
        return [x for x in parts if x >= 0]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Words with their ids as one file: an acyclic automaton with equal suffixes shared.

    Words are added in order; what follows the common prefix of two neighbours is final and is
    replaced by an equal state where one exists. Each edge stores how many words sort before its
    subtree, so walking a word gives its number, and the number gives its ids."""
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # (final, edges (byte, state))
    path: list[list] = [[False, []]]  # open states of the last word: [final, edges]; the last edge's target is open

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append((final, edges))
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    last = b""
    for w in words:
        common = len(os.path.commonprefix([last, w]))
        close(common)
        for b in w[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    states.append((path[0][0], path[0][1]))
    below = []
    for final, edges in states:  # targets come before their sources
        below.append(int(final) + sum(below[t] for _, t in edges))
    first, labels, targets, skips, finals = [0], bytearray(), [], [], bytearray()
    for final, edges in states:
        finals.append(final)
        skip = int(final)
        for b, t in edges:
            labels.append(b)
            targets.append(t)
            skips.append(skip)
            skip += below[t]
        first.append(len(targets))
    offsets, ids = [0], []
    for w in words:
        ids.extend(entries[w])
        offsets.append(len(ids))
    parts = [struct.pack(f"<{len(x)}I", *x) for x in (first, targets, skips, offsets, ids)]
    head = struct.pack("<6I", len(states), *(len(p) for p in parts))
    return head + b"".join(parts) + bytes(finals) + bytes(labels)


class Lexicon:
    """The compiled file, mapped into memory."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:  # the mapping outlives the name and the handle
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        count, *sizes = struct.unpack_from("<6I", self.map)
        view, at, parts = memoryview(self.map), 24, []
        for n in sizes:
            parts.append(view[at : at + n].cast("I"))
            at += n
        self.first, self.targets, self.skips, self.offsets, self.ids = parts
        self.finals, self.labels, self.root = view[at : at + count], at + count, count - 1

    def get(self, word: bytes) -> list[int] | None:
        state, number, base, find = self.root, 0, self.labels, self.map.find
        for i in range(len(word)):
            edge = find(word[i : i + 1], base + self.first[state], base + self.first[state + 1]) - base
            if edge < 0:
                return None
            number += self.skips[edge]
            state = self.targets[edge]
        if not self.finals[state]:
            return None
        return list(self.ids[self.offsets[number] : self.offsets[number + 1]])


_vocabularies: dict[str, Vocabulary] = {}
_encoders: dict[tuple, Encoder] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Recent:
    """Remembered results in two generations of about ``limit`` keys: what is in use survives a change."""

    def __init__(self, limit: int):
        self.new, self.old, self.limit = {}, {}, limit

    def missing(self, keys: set) -> list:
        """The keys without a result; those of the old generation move to the new one."""
        lost = []
        for k in keys.difference(self.new):
            if (out := self.old.get(k)) is None:
                lost.append(k)
            else:
                self.new[k] = out
        return lost

    def turn(self) -> None:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}


class Encoder:
    """Ids and token strings of texts. Stretches between ASCII white space are remembered: they are
    encoded on their own, for white space ends every word and never joins its neighbours in NFC."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None, remembered: int = REMEMBERED):
        self.vocab, self.lexicon, self.blank = vocab, lexicon, False
        self.known, self.stretches = Recent(remembered), Recent(remembered)  # stretches differ far more than their words

    def _learn_words(self, words: set[str]) -> None:
        """Ids and token strings of words, from the lexicon or else merged."""
        fresh = self.known.missing(words)
        raw = [w.encode("utf-8") for w in fresh]
        found = [self.lexicon.get(w) for w in raw] if self.lexicon else [None] * len(raw)
        unseen = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(unseen, self.vocab.merged_many([raw[k] for k in unseen]), strict=True):
            found[k] = ids
        shown = self.vocab.shown
        for w, ids in zip(fresh, found, strict=True):
            parts = [shown[i] for i in ids]
            self.known.new[w] = parts[0] if len(parts) == 1 else (b" ".join([x for x, _ in parts]), b" ".join([x for _, x in parts]))

    def _learn(self, stretches: set[bytes]) -> None:
        fresh = self.stretches.missing(stretches)
        split = [self.vocab.words(w.decode("utf-8")) for w in fresh]
        self._learn_words({w for words in split for w in words})
        known, new = self.known.new, self.stretches.new
        for raw, words in zip(fresh, split, strict=True):
            if len(words) == 1:
                new[raw] = known[words[0]]
                continue
            self.blank |= not words
            parts = [known[w] for w in words]
            new[raw] = b" ".join([x for x, _ in parts]), b" ".join([x for _, x in parts])

    def rendered(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text the decimal ids joined by a space, and the decoded text."""
        vocab = self.vocab
        split, marked = [], []  # of each text its stretches, and special tokens as their own results
        for t in texts:
            marked.append("<|" in t and vocab.special_pattern.search(t) is not None)
            if marked[-1]:
                pieces = [[vocab.shown[vocab.specials[p]]] if p in vocab.specials else p.encode("utf-8").split() for p in vocab.special_pattern.split(t)]
                split.append([x for p in pieces for x in p])
            else:
                split.append(t.encode("utf-8").split())
        self._learn({w for w in set().union(*split) if type(w) is bytes})
        get, out = self.stretches.new.get, []
        for words, special in zip(split, marked, strict=True):
            parts = [get(w, w) for w in words] if special else list(map(self.stretches.new.__getitem__, words))
            if self.blank:
                parts = [p for p in parts if p[0]]  # what normalises to nothing has no words
            out.append((b" ".join([x for x, _ in parts]), b" ".join([x for _, x in parts])))
        self.known.turn()
        self.stretches.turn()
        return out


def _encoder(path: str, blob: bytes) -> Encoder:
    key = (path, hashlib.sha256(blob).digest())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary(path), Lexicon(blob))
    return _encoders[key]


def frequent_stretches(docs: DataFrame, text: str, words: int) -> list[str]:
    """The most frequent stretches between white space, ``words`` at most, counted over all texts.

    A histogram of the counts in narrow steps gives the least count that leaves no more than that, so only
    those that are kept come to the driver. What is met once is never frequent; neither is what is longer than a word."""
    stretch = F.explode(F.split(F.col(text).cast("string"), f"{ASCII_SPACE}+")).alias("word")
    counts = docs.select(stretch).where(F.length("word").between(1, LONG)).groupBy("word").agg(F.count("*").alias("n"))
    counts = written(counts.where("n > 1"), "word-counts")
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # some hundred steps
    least, total = 1 << 30, 0
    for r in sizes:
        total += r["count"]
        if total > words:
            break
        least = r["step"]
    return [r.word for r in counts.where(step >= least).select("word").collect()]


def lexicon_file(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The automaton of the words of the corpus's most frequent stretches; a few megabytes."""
    vocab = vocabulary(path)
    top = list({w.encode("utf-8") for s in frequent_stretches(docs, text, words) for w in vocab.words(s)})
    return compile_lexicon(dict(zip(top, vocab.merged_many(top), strict=True)))


def encoded(docs: DataFrame, path: str, text: str = "text", digests: bool = False, words: int = LEXICON_WORDS) -> DataFrame:
    """The input's columns but the text, with n_tokens and ``ids`` (array<int>) and ``decoded`` (string);
    with ``digests`` their SHA-256 instead (ids_sha256 of the decimal ids joined by a space, decoded_sha256).

    Null and empty texts have no tokens, no ids and an empty decoded text. Special tokens written in a
    text become their ids, as the library does by default. Long texts are encoded whole. Repeated rows
    are encoded alike; an empty table gives no rows; input columns with the new names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blob = spark.sparkContext.broadcast(lexicon_file(docs, path, text, words))
    new = {"n_tokens": ("long", pa.int64()), **({"ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())} if digests else {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())})}
    kept = [c for c in docs.columns if c != text and c not in new]
    source = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))

    def run(batches):
        encoder = _encoder(path, blob.value)
        for b in batches:
            pairs = encoder.rendered(b.column(len(kept)).to_pylist())
            counts = [i.count(b" ") + 1 if i else 0 for i, _ in pairs]
            if digests:
                made = [[hashlib.sha256(p[k]).hexdigest() for p in pairs] for k in (0, 1)]
            else:
                made = [[list(map(int, i.split())) for i, _ in pairs], [d.decode("utf-8") for _, d in pairs]]
            arrays = [pa.array(x, kind) for x, (_, kind) in zip([counts, *made], new.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *arrays], names=[*kept, *new])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join(fields + [f"{n} {kind}" for n, (kind, _) in new.items()]))


def decoded_text(ids: list[int], path: str) -> str:
    """The library's decode of these ids, special tokens kept: token strings joined by a space."""
    return " ".join(vocabulary(path).tokens[i] for i in ids)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text. Null counts as empty, a very long text is encoded whole, repeated rows and null
    ids have a row each; an empty table gives no rows; other columns are not read."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)
