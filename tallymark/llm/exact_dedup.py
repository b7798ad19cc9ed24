"""Exact dedup by Grace hashing.

Each task first folds its own rows into an open-addressing table that compares
whole texts, so that a text held by a third of all rows leaves a task once.
The distinct texts are then shuffled by hash, and the receiving task partitions
them again: a bucket that does not fit ``table_bytes`` is written to spill
files by further hash bits, recursively, until each piece fits its table.  What
comes back is one small row per distinct text, joined to the documents by the
text's SHA-256 (a join, so that AQE can split the rows of a hot text).

Defined results: null counts as empty text; rows that repeat a doc_id each
count in ``group_size``, and rows that repeat both id and text share the
verdict; a null doc_id ranks below all others (``keep_id`` is null only if no
row of the group has an id).  Extra columns are ignored.  If two texts with
one SHA-256 and different content ever met, the task would raise.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NONE = -(2**63)  # stands for a null doc_id: below all others


class Table:
    """Open addressing with linear probing: slots hold entry numbers, entries hold whole contents."""

    def __init__(self) -> None:
        self.slots, self.entries, self.bytes = [-1] * 1024, [], 0

    def add(self, digest: bytes, text: bytes, top: int, n: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            if entry[0] == digest and entry[1] == text:
                entry[2] = max(entry[2], top)
                entry[3] += n
                return
            if entry[0] == digest:
                raise ValueError("two different texts have one SHA-256")
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, text, top, n])
        self.bytes += len(text) + 120
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for i, entry in enumerate(self.entries):
                at = int.from_bytes(entry[0][8:16], "little") & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i


HEAD = struct.Struct("<32sqqI")


def read_spill(path: str) -> Iterator[tuple[bytes, bytes, int, int]]:
    with open(path, "rb") as f:
        while head := f.read(HEAD.size):
            digest, top, n, size = HEAD.unpack(head)
            yield digest, f.read(size), top, n


def grace(rows: Iterator[tuple[bytes, bytes, int, int]], table_bytes: int, level: int = 0, fan: int = 16) -> Iterator[list]:
    """Entries ``[digest, text, largest id, count]`` of the distinct texts in ``rows``."""
    table = Table()
    for row in rows:
        table.add(*row)
        if table.bytes > table_bytes and len(table.entries) > 1 and level < 30:
            break
    else:
        yield from table.entries
        return
    with tempfile.TemporaryDirectory() as folder:  # the task's own scratch, gone when it ends
        files = [open(os.path.join(folder, str(i)), "wb") for i in range(fan)]
        for source in (table.entries, rows):
            for digest, text, top, n in source:
                part = files[(digest[16 + level // 2] >> (4 * (level % 2))) % fan]
                part.write(HEAD.pack(digest, top, n, len(text)))
                part.write(text)
        del table
        for f in files:
            f.close()
            yield from grace(read_spill(f.name), table_bytes, level + 1, fan)
            os.unlink(f.name)


def fold(table_bytes: int, send_text: bool):
    """A mapInPandas function that folds the rows of a task, keeping texts for a later fold or not."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((bytes(d), bytes(t), int(i), int(n)) for f in frames for d, t, i, n in zip(f["digest"], f["body"], f["top"], f["n"]))
        part, size = [], 0
        for entry in grace(rows, table_bytes):
            part.append(entry)
            size += len(entry[1])
            if size > 8 << 20 or len(part) >= 5000:
                yield frame(part, send_text)
                part, size = [], 0
        yield frame(part, send_text)

    return run


def frame(part: list, send_text: bool) -> pd.DataFrame:
    cols = {"digest": [e[0] for e in part], "top": pd.Series([e[2] for e in part], dtype="int64"), "n": pd.Series([e[3] for e in part], dtype="int64")}
    return pd.DataFrame(cols | ({"body": [e[1] for e in part]} if send_text else {}))


def duplicate_groups(docs: DataFrame, table_bytes: int = 64 << 20, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row per distinct text: ``(digest, top, n)``."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("body"), F.coalesce(F.col(doc).cast("long"), F.lit(NONE)).alias("top"), F.lit(1).cast("long").alias("n"))
    local = rows.mapInPandas(fold(table_bytes, True), "digest binary, top long, n long, body binary")
    return local.repartition("digest").mapInPandas(fold(table_bytes, False), "digest binary, top long, n long")


def exact_dedup(docs: DataFrame, text: str = "text", doc: str = "doc_id", table_bytes: int = 64 << 20) -> DataFrame:
    """Every row's ``doc_id, keep_id, group_size, kept, text_sha256``."""
    groups = duplicate_groups(docs, table_bytes, text, doc)
    rows = docs.select(F.col(doc).alias("doc_id"), F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)).alias("digest"))
    keep = F.nullif(F.col("top"), F.lit(NONE))
    return rows.join(groups, "digest").select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, table_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without the copies: of equal texts, one row with the largest doc_id stays."""
    groups = common.written(duplicate_groups(docs, table_bytes).select(F.col("digest").alias("__digest"), F.col("top").alias("__top"), "n"))
    digest = F.unhex(F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256))
    top = (digest == F.col("__digest")) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)) == F.col("__top"))
    # Rows of one text may tie for the largest id, or all have none: one of them stays.
    once = docs.join(groups.where("n = 1").drop("n"), top, "left_semi")
    ties = docs.join(groups.where("n > 1").drop("n"), top)
    return once.unionByName(common.one_each(ties, "__digest", docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
