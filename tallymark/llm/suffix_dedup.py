"""Suffix-array dedup by bucket-pointer refinement, on UTF-8 bytes.

Suffixes by their first ``GRAM`` bytes are the buckets between tasks: of the
suffixes in a window of 50 bytes the one with the least bucket hash (a
minimiser: equal windows keep equal suffixes) files the window under its bucket.
Runs of windows of one bucket that are equal as a whole are settled at once,
and buckets without different runs need no sorting.

In the others the suffixes are sorted by bucket-pointer refinement (see
``anchored.refine``): buckets by the first eight bytes, in order of these bytes,
are refined by sorting on a suffix's own bucket and its bucket at a later
offset, at first eight bytes on; the buckets found then serve the next turn, at
16, and so on until buckets are 50 bytes deep.  Suffixes alone in a bucket leave
the sorting early.  Of each bucket in the end, all suffixes but those of the
first document are repeats.

Removed is each byte covered by a 50-byte string that also starts in a document
with a smaller doc_id.  Defined results: null is empty; a null doc_id is smaller
than all others; rows that repeat a doc_id are one document for the rule "in a
smaller document", and each loses only what it repeats itself; a text
shorter than 50 bytes loses nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .anchored import RUNS, Repeats, covered, rows
from .hashing import mix, spans

WIDTH, GRAM, BLOCK = 50, 20, 1 << 19


def blocks(texts: Iterator[tuple[tuple[int, int], bytes]], width: int, size: int = BLOCK) -> Iterator[tuple[bytes, list[tuple[tuple[int, int], int, int, int]]]]:
    """Bytes of about ``size`` and their pieces ``((doc, row), offset in doc, start, windows)``; long texts come in overlapping parts."""
    data, pieces, at = [], [], 0
    for doc, text in texts:
        for off in range(0, max(len(text) - width + 1, 0), size):
            part = text[off : off + size + width - 1]
            pieces.append((doc, off, at, len(part) - width + 1))
            data.append(part)
            at += len(part)
            if at >= size:
                yield b"".join(data), pieces
                data, pieces, at = [], [], 0
    if pieces:
        yield b"".join(data), pieces


class ByteRepeats(Repeats):
    same_doc = False

    def __init__(self, width: int = WIDTH, gram: int = GRAM) -> None:
        self.width, self.gram = width, gram

    def runs(self, texts: Iterator[tuple[tuple[int, int], bytes]]) -> Iterator[np.ndarray]:
        for data, pieces in blocks(texts, self.width):
            yield self.block_runs(np.frombuffer(data, np.uint8), pieces)

    def block_runs(self, data: np.ndarray, pieces: list) -> np.ndarray:
        q, width, h = self.gram, self.width, spans(1)
        prefix = h.prefix(data)
        n, m = len(data) - q + 1, len(data) - width + 1
        bucket = mix((prefix[q:] - prefix[:-q]) * h.back[:n])
        least, where, reach, want = (bucket >> np.uint64(32)).astype(np.uint32), np.arange(n, dtype=np.int32), 1, width - q + 1
        while reach * 2 <= want:  # the leftmost least bucket of ever longer stretches
            take = least[reach:] < least[:-reach]
            where = np.where(take, where[reach:], where[:-reach])
            least = np.minimum(least[reach:], least[:-reach])
            reach *= 2
        if rest := want - reach:
            where = np.where(least[rest : rest + m] < least[:m], where[rest : rest + m], where[:m])
        where = where[:m]
        real = np.zeros(m, bool)
        for _, _, start, windows in pieces:
            real[start : start + windows] = True
        new = np.ones(m + 1, bool)
        new[1:m] = (where[1:] != where[:-1]) | ~real[:-1]
        first = np.flatnonzero(real & new[:m])
        stop = np.append(real[1:], False)
        last = np.flatnonzero(real & (new[1:] | ~stop))
        piece = np.array([(d, row, off, start) for (d, row), off, start, _ in pieces], np.int64)
        own = piece[np.searchsorted(piece[:, 3], first, "right") - 1]
        return rows(bucket[where[first]], h.of(prefix, first, last + width), own[:, :2], first - own[:, 3] + own[:, 2], last - first + 1)

    def windows(self, text: bytes, open_spans: np.ndarray) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        n = open_spans["n"].astype(np.int64)
        at = np.repeat(open_spans["at"], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = at[at + self.width <= len(data)]
        half, out = self.width // 2, np.zeros(len(at), RUNS)
        for name, seed in (("k", 2), ("r", 3)):
            h = spans(seed)
            prefix = h.prefix(data)
            left, right = h.of(prefix, at, at + half), h.of(prefix, at + half, at + self.width)
            out[name] = mix(left * np.uint64(0x9E3779B97F4A7C15) + right)
        out["at"], out["n"] = at, 1
        return out


    def pieces(self, text: bytes, open_spans: np.ndarray) -> list[bytes]:
        return [text[at : at + n - 1 + self.width] for at, n in zip(open_spans["at"].tolist(), open_spans["n"].tolist())]

    def buckets(self, pieces: list[bytes]) -> tuple[np.ndarray, int, np.ndarray]:
        data = np.frombuffer(b"".join(pieces) + bytes(7), np.uint8)
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)[: len(data) - 7]
        _, ids = np.unique(np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64), return_inverse=True)
        return ids, 8, np.array([len(t) for t in pieces], np.int64)


def dedup_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: kept bytes as binary."""

    def finish(text: bytes, found: np.ndarray) -> tuple:
        gone = covered(len(text), found, width)
        n = int(gone.sum())
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if n else 0
        return len(text), n, runs, np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text

    return ByteRepeats(width, gram).find(docs.select("doc_id", "text"), finish, "n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_spans(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS byte FROM t),
p2 AS (SELECT doc_id, i, byte || lead(byte) OVER o AS b2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p4 AS (SELECT doc_id, i, b2, b2 || lead(b2, 2) OVER o AS b4 FROM p2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p8 AS (SELECT doc_id, i, b2, b4 || lead(b4, 4) OVER o AS b8 FROM p4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p16 AS (SELECT doc_id, i, b2, b8 || lead(b8, 8) OVER o AS b16 FROM p8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, i, b16 || lead(b16, 16) OVER o || lead(b16, 32) OVER o || lead(b2, 48) OVER o AS g FROM p16 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT g, min(doc_id) AS first FROM w WHERE g IS NOT NULL GROUP BY g HAVING min(doc_id) < max(doc_id)),
s AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.g = f.g WHERE w.doc_id > f.first),
m AS (SELECT p.doc_id, p.i, p.byte, max(s.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.i = p.i),
g AS (SELECT doc_id, i, byte, coalesce(last > i - 50, false) AS gone FROM m),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT t.doc_id, len(t.b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""
