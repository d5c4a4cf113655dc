"""Exact deduplication by Grace hash partitioning: records are split recursively into spill files by
bits of their hash until each bucket fits an open-addressing table that compares complete content.

Two levels. First every input partition is reduced by itself, so a text that a third of all rows hold
leaves each partition once. Then the survivors are shuffled by hash and reduced again, and the group
of a survivor is joined back to the rows it stood for on a key that is local to their partition: that
join has no hot key, however large a group is.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import itertools
import os
import pickle
import struct
import tempfile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import small_batches, tasks_for, written

#: Deleted before texts are compared.
WHITE = b" \t\n\x0b\x0c\r"
FAN_OUT_BITS = 4


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


class Table:
    """Open addressing with linear probing over 64-bit hashes; equal hashes are settled by content."""

    def __init__(self):
        self.slots, self.entries, self.bytes = np.full(1024, -1, np.int64), [], 0

    def find(self, h: int, content: bytes):
        """The entry [hash, content, payload] of this content, or None and the free slot."""
        mask, slots, entries = len(self.slots) - 1, self.slots, self.entries
        i = (h ^ (h >> 29)) & mask
        while (k := slots[i]) >= 0:
            e = entries[k]
            if e[0] == h and e[1] == content:
                return e, i
            i = (i + 1) & mask
        return None, i

    def add(self, slot: int, h: int, content: bytes, payload, size: int) -> list:
        self.slots[slot] = len(self.entries)
        self.entries.append(entry := [h, content, payload])
        self.bytes += len(content) + 200 + size
        if 2 * len(self.entries) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            mask = len(self.slots) - 1
            for k, (g, _, _) in enumerate(self.entries):
                i = (g ^ (g >> 29)) & mask
                while self.slots[i] >= 0:
                    i = (i + 1) & mask
                self.slots[i] = k
        return entry


class Member(NamedTuple):
    """A record that has found its entry."""

    entry: list
    payload: object


def grace(records, merge, memory: int, size=lambda payload: 0, members: bool = False):
    """Entries [hash, content, payload], one for each distinct content. ``records`` yields (hash,
    content, payload); ``merge(a, b)`` joins the payloads of equal contents; ``size`` says how many bytes a payload
    holds beside the content. With ``members`` every record is told of as a ``Member`` as soon as it has its entry, before the
    entries themselves, so that nobody has to keep lists of them. Beyond ``memory`` bytes of what is held, records new to the table go to spill files by
    the next bits of their hash, and each file is reduced in the same way. Copies never spill: they meet their entry
    in the table. Level 15 is the last of the 64 bits; beyond it contents of one hash stay together. The spill
    folder is the task's own and goes with it, whether it ends, fails or is left half-read."""
    with contextlib.ExitStack() as stack:
        folder = functools.cache(lambda: stack.enter_context(tempfile.TemporaryDirectory(prefix="grace-", ignore_cleanup_errors=True)))
        yield from _reduced(records, merge, memory, size, members, 0, folder)


def _reduced(records, merge, memory: int, size, members: bool, level: int, folder):
    table, files, paths = Table(), None, []
    for h, content, payload in records:
        entry, slot = table.find(h, content)
        if entry is not None:
            table.bytes -= size(entry[2])
            entry[2] = merge(entry[2], payload)
            table.bytes += size(entry[2])
            if members:
                yield Member(entry, payload)
        elif table.bytes < memory or level > 15:
            entry = table.add(slot, h, content, payload, size(payload))
            if members:
                yield Member(entry, payload)
        else:
            if files is None:
                paths = [f"{folder()}/{level}-{os.urandom(6).hex()}" for _ in range(1 << FAN_OUT_BITS)]
                files = [open(p, "wb") for p in paths]  # noqa: SIM115
            packed = pickle.dumps((h, content, payload), 5)
            f = files[(h >> (FAN_OUT_BITS * level)) & ((1 << FAN_OUT_BITS) - 1)]
            f.write(struct.pack("<I", len(packed)))
            f.write(packed)
    yield from table.entries
    table = None
    for f in files or ():
        f.close()
    for p in paths:
        if os.path.getsize(p):
            yield from _reduced(_spilled(p), merge, memory, size, members, level + 1, folder)
        os.unlink(p)


def _spilled(path: str):
    with open(path, "rb") as f:
        while head := f.read(4):
            yield pickle.loads(f.read(struct.unpack("<I", head)[0]))


def _hash(content: bytes) -> tuple[str, int]:
    d = hashlib.sha256(content).digest()
    return d.hex(), int.from_bytes(d[:8], "little")


def _better(a, b) -> bool:
    """Of two payloads (count, -code points, doc_id, place, ...): most code points, then the smallest doc_id (null last), then the earliest place."""
    key = lambda x: (x[1], x[2] is None, x[2] or 0, x[3])
    return key(a) <= key(b)


LOCAL = "doc_id long, group_key long, place long, sha string, h long, content binary, n long, points long"
GROUPS = "group_key long, keep_id long, group_size long, keep_key long"


def _arrow(columns, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _reduce_partition(memory: int):
    """Per input partition: a row for each document with the key of its local group and its place, as it is read, and a row for
    each group with the content and the document and place of its best."""
    kinds = [("doc_id", pa.int64()), ("group_key", pa.int64()), ("place", pa.int64()), ("sha", pa.string()), ("h", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("points", pa.int64())]

    def run(batches):
        part = TaskContext.get().partitionId()
        numbers = itertools.count()

        def records():
            place = 0
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    content = normalised(text)
                    sha, h = _hash(content)
                    yield h, content, (1, -len(text or ""), doc_id, place, sha, None)
                    place += 1

        def merge(a, b):
            best = a if _better(a, b) else b
            return (a[0] + b[0], *best[1:5], a[5])

        rows = []
        for found in grace(records(), merge, memory, members=True):
            if isinstance(found, Member):
                entry, (_, _, doc_id, place, _, _) = found
                if entry[2][5] is None:  # the first of its group
                    entry[2] = (*entry[2][:5], (part << 36) | next(numbers))
                rows.append((doc_id, entry[2][5], place, None, None, None, None, None))
            else:
                h, content, (n, points, best, place, sha, key) = found
                rows.append((best, key, place, sha, h - (1 << 64) if h >> 63 else h, content, n, -points))
            if len(rows) >= 2000 or (len(rows) >= 500 and rows[-1][5] is not None):
                yield _arrow(zip(*rows, strict=True), kinds)
                rows = []
        if rows:
            yield _arrow(zip(*rows, strict=True), kinds)

    return run


def _reduce_groups(memory: int):
    kinds = [(n, pa.int64()) for n in ("group_key", "keep_id", "group_size", "keep_key")]

    def run(batches):
        def records():
            for b in batches:
                for key, h, content, n, points, best in zip(*(b.column(k).to_pylist() for k in ("group_key", "h", "content", "n", "points", "doc_id")), strict=True):
                    yield h & (2**64 - 1), content, (n, -points, best, key, [key])

        def merge(a, b):
            a[4].extend(b[4])
            best = a if _better(a, b) else b
            return (a[0] + b[0], *best[1:4], a[4])

        rows = []
        for _, _, (n, _, best, keep, own) in grace(records(), merge, memory, lambda p: 40 * len(p[4])):  # a key for each input partition at most
            rows.extend((key, best, n, keep) for key in own)
            if len(rows) >= 10_000:
                yield _arrow(zip(*rows, strict=True), kinds)
                rows = []
        if rows:
            yield _arrow(zip(*rows, strict=True), kinds)

    return run


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memory: int = 48_000_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; a null text is empty, and all empty
    texts are one group. The row with the most code points in the original text stays, then the one
    with the smallest id (a null id is the largest), then the first met: exactly one row of a group has
    kept = true, repeated ids included. An empty table gives no rows. Columns other than the two named
    are not read. ``memory`` bounds the distinct content a task holds; beyond it records spill to its disk. Copies are handed on as
    they are read, however many there are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    local = written(source.mapInArrow(_reduce_partition(memory), LOCAL), "local-groups")
    heads = local.where("n IS NOT NULL")
    groups = heads.select("group_key", "h", "content", "n", "points", "doc_id").repartition(tasks_for(spark), "h").mapInArrow(_reduce_groups(memory), GROUPS)
    groups = groups.join(heads.select("group_key", F.col("sha").alias("text_sha256"), F.col("place").alias("best_place")), "group_key")
    rows = local.where("n IS NULL").select("doc_id", "group_key", "place")
    kept = (F.col("place") == F.col("best_place")) & (F.col("group_key") == F.col("keep_key"))
    return rows.join(groups, "group_key").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _bytes_of(value) -> int:
    """About what a value of a row holds."""
    if isinstance(value, (str, bytes)):
        return len(value) + 60
    if isinstance(value, dict):
        return 100 + sum(_bytes_of(x) for pair in value.items() for x in pair)
    if isinstance(value, (list, tuple)):
        return 60 + sum(map(_bytes_of, value))
    return 30


def _winners(names: list[str], doc_id: str, text: str, memory: int):
    """Whole rows, one for each distinct content of the partition: the row that stays among those seen."""

    def run(batches):
        kinds = []

        def records():
            place = 0
            for b in batches:
                kinds[:] = [(f.name, f.type) for f in b.schema]
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    body = row[names.index(text)]
                    content = normalised(body)
                    yield _hash(content)[1], content, (1, -len(body or ""), row[names.index(doc_id)], place, row)
                    place += 1

        def merge(a, b):
            return a if _better(a, b) else b

        rows = []
        for code, _, payload in grace(records(), merge, memory, lambda p: _bytes_of(p[4])):
            rows.append((code - (1 << 64) if code >> 63 else code, *payload[4]))
            if len(rows) >= 500:
                yield _arrow(zip(*rows, strict=True), [("h", pa.int64()), *kinds])
                rows = []
        if rows:
            yield _arrow(zip(*rows, strict=True), [("h", pa.int64()), *kinds])

    return run


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memory: int = 24_000_000) -> DataFrame:
    """The rows of ``docs`` that stay under the rule of ``exact_groups``, with all their columns; of rows
    with the same text and id one stays. Each input partition drops its own copies before the shuffle."""
    from pyspark.sql.types import LongType, StructField, StructType

    spark = docs.sparkSession
    small_batches(spark)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the input's columns are called
    schema = StructType([StructField("h", LongType()), *inner.schema.fields])
    winners = _winners(docs.columns, doc_id, text, memory)
    local = inner.mapInArrow(winners, schema)
    merged = local.repartition(tasks_for(spark), "h").drop("h")
    return merged.mapInArrow(winners, schema).drop("h").toDF(*docs.columns)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """A row for each document. Null counts as empty, ties go to the smallest id, then to the first met; repeated rows have a row
    each; an empty table gives no rows; other columns are not read."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
