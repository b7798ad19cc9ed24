"""Alignment of two tokenizers' cuts of the same text, and how often their tokens are linked.

Both vocabularies cut ``space + text``.  Places where tokens of both end cut the
bytes into groups; the last tokens of a group, whose byte ranges end together,
are a link.  ``aligned`` finds them by diagonal run skipping: at the current
shift between the two arrays of ends it compares stretches that double in
length, jumps over what agrees (stretches of one token against one), halves
down to the first difference, resolves that irregular group by stepping the
side that is behind, and goes on with the new shift.

A space between two characters that are not white space cuts in both
vocabularies, so no token and no group reaches across it.  What lies between
such cuts repeats, and a worker keeps a bounded memo of it; what is new in a
batch is encoded by the two libraries and aligned in one pass over its joined
ends.

Counts over the corpus go by blocks: a task gathers its documents until their
distinct links reach ``BLOCK_LINKS`` and adds up each link once a block, so a
link that a third of all tokens make costs one row a block.  The blocks' rows
are summed and ranked by Spark, joined back, and meet the block's documents.

Defined results: null and empty texts, and texts whose tokens do not spell
``space + text`` in bytes (such as texts that hold U+2581), have no tokens:
zeros and an empty digest.  Rows that repeat count each time.  A null id stays
null.  Texts of any length are cut whole.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

META = "▁"
#: Cuts in both vocabularies: one space that follows no space and precedes no white space.
CUT = re.compile(rf"(?<=[^ {META}]) (?![\s{META}]|\Z)")
#: A text without it, without U+2581 and without white space at its ends is cut at each space.
ODD = re.compile(r" \s")
#: Distinct links, added over its documents, that a block holds; pieces that a worker remembers.
BLOCK_LINKS, MEMO = 2_000_000, 350_000

DOCS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, n binary, keys binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into ``a`` and ``b`` of the ends that both hold, pair by pair; both rise, and end alike."""
    list_a, list_b = a.tolist(), b.tolist()
    raw_a, raw_b, wide = a.astype(np.int64).tobytes(), b.astype(np.int64).tobytes(), 8  # stretches are compared as bytes
    runs: list[tuple[int, int, int]] = []
    n, m = len(list_a), len(list_b)
    i = j = 0
    while i < n and j < m:
        x, y = list_a[i], list_b[j]
        while x != y:  # an irregular group: step the side that is behind
            if x < y:
                i += 1
                x = list_a[i]
            else:
                j += 1
                y = list_b[j]
        run, step, rest = 1, 1, min(n - i, m - j)
        p, q = wide * i, wide * j
        while run + step <= rest and raw_a[p + wide * run : p + wide * (run + step)] == raw_b[q + wide * run : q + wide * (run + step)]:
            run, step = run + step, 2 * step
        while step > 1:
            step //= 2
            if run + step <= rest and raw_a[p + wide * run : p + wide * (run + step)] == raw_b[q + wide * run : q + wide * (run + step)]:
                run += step
        runs.append((i, j, run))
        i, j = i + run, j + run
    start_a, start_b, size = np.array(runs, np.int64).reshape(-1, 3).T
    inside = ranges(size)
    return np.repeat(start_a, size) + inside, np.repeat(start_b, size) + inside


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def byte_table() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Two vocabularies, and a memo of pieces with their groups and links."""

    def __init__(self, path_a: str, path_b: str, memo: int = MEMO) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        table = byte_table()
        self.size_a, self.size_b, self.memo = self.a.get_vocab_size(), self.b.get_piece_size(), memo
        names = [self.a.id_to_token(k) or "" for k in range(self.size_a)]
        pieces = [self.b.id_to_piece(k) for k in range(self.size_b)]
        if any(META in s.lstrip(META) for s in pieces):
            raise ValueError("pieces that span words are not supported")
        self.bytes_a = [bytes(table[c] for c in s) if all(c in table for c in s) else s.encode() for s in names]
        self.bytes_b = [bytes([int(s[3:5], 16)]) if self.b.is_byte(k) else s.replace(META, " ").encode() for k, s in enumerate(pieces)]
        self.len_a, self.len_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        # A token's id and what follows it in the digest: A goes on or gives way to B, B goes on or ends its group.
        self.names = [f"{k}{c}" for n, ends in ((self.size_a, ",|"), (self.size_b, ",;")) for c in ends for k in range(n)]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        # By piece: tokens of A (-1: does not spell itself), tokens of both, links; then the tokens and links of all pieces.
        self.sizes, self.line, self.links = np.empty((0, 3), np.int64), np.empty(0, np.int32), np.empty(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        """``text`` cut where both vocabularies cut; each piece has a space in front that is left out."""
        if text[0].isspace() or text[-1].isspace() or META in text or ODD.search(text):
            return CUT.split(text)
        return text.split(" ")

    def learn(self, todo: list[str]) -> None:
        """Encode and align new pieces, joined one after the other, as each ends in both.

        A piece that its tokens do not spell gets none: B may only lose bytes (U+2581 becomes a space), which no other piece makes good.
        """
        first = len(self.index)
        self.index.update(zip(todo, range(first, first + len(todo))))
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in todo], add_special_tokens=False)]
        ids_b = self.b.encode(todo, num_threads=1)
        spell_a, spell_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        fine = np.ones(len(todo), bool)
        whole = "".join([" " + s for s in todo]).encode()
        if not b"".join(map(spell_a, chain.from_iterable(ids_a))) == whole == b"".join(map(spell_b, chain.from_iterable(ids_b))):
            fine[:] = [b"".join(map(spell_a, x)) == (" " + s).encode() == b"".join(map(spell_b, y)) for s, x, y in zip(todo, ids_a, ids_b)]
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, fine)] for ids in (ids_a, ids_b))
        n_a, n_b = np.fromiter(map(len, ids_a), np.int64), np.fromiter(map(len, ids_b), np.int64)
        all_a, all_b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        left, right = aligned(np.cumsum(self.len_a[all_a]), np.cumsum(self.len_b[all_b]))
        ends_a, ends_b = left + 1, right + 1
        links = all_a[left] * self.size_b + all_b[right]
        # In the digest a group's tokens of A stand before those of B.
        of_a, of_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        all_a[left] += self.size_a
        all_b[right] += self.size_b
        line = np.empty(len(all_a) + len(all_b), np.int32)
        line[np.arange(len(all_a)) + np.repeat(ends_b - of_b, of_a)] = all_a
        line[np.arange(len(all_b)) + np.repeat(ends_a, of_b)] = all_b + 2 * self.size_a
        groups = np.diff(np.searchsorted(ends_a, np.cumsum(n_a), side="right"), prepend=0)
        sizes = np.stack([np.where(fine, n_a, -1), n_a + n_b, groups], axis=1)
        self.sizes, self.line, self.links = np.concatenate([self.sizes, sizes]), np.concatenate([self.line, line]), np.concatenate([self.links, links])

    def documents(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """For each text ``n_a, n_b, n_groups``, the digest of its groups, and its links as ``id of A * size of B + id of B``."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.index) > self.memo or len(self.line) > 10 * self.memo:
            self.forget()
        if todo := list(set().union(*cut).difference(self.index)):
            self.learn(todo)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64)
        sizes = self.sizes[at]
        starts = (np.cumsum(self.sizes[:, 1:], axis=0) - self.sizes[:, 1:])[at]
        line, links = (pool[np.repeat(starts[:, k], sizes[:, k + 1]) + ranges(sizes[:, k + 1])] for k, pool in enumerate((self.line, self.links)))
        shown = list(map(self.names.__getitem__, line.tolist()))
        out, p, q, r = [], 0, 0, 0
        for pieces in cut:
            own = sizes[p : p + len(pieces)]
            p += len(pieces)
            n_a, n, groups = own.sum(axis=0).tolist()
            if not pieces or own[:, 0].min() < 0:
                out.append((0, 0, 0, "", np.empty(0, np.int64)))
            else:
                out.append((n_a, n - n_a, groups, hashlib.sha256("".join(shown[q : q + n])[:-1].encode()).hexdigest(), links[r : r + groups]))
            q, r = q + n, r + groups
        return out


@functools.lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """One pair per worker process and vocabularies."""
    return Pair(path_a, path_b)


def batches(texts: list[str | None], chars: int = 700_000) -> Iterator[slice]:
    """Slices with about ``chars`` characters."""
    at = n = 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield slice(at, k + 1)
            at, n = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def encoded(docs: DataFrame, models: tuple[str, str], block_links: int = BLOCK_LINKS) -> DataFrame:
    """A row a document with its distinct links as places among its block's, and a row a block with these links and their counts."""
    names = [x.split()[0] for x in DOCS.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, DOCS.split(", "))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, part, seq = pair(*models), TaskContext.get().partitionId(), 0
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held, seq
            block = (part << 32) + seq
            keys, place = np.unique(np.concatenate([r[-2] for r in rows]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([r[-1] for r in rows]), minlength=len(keys)).astype(np.int64)
            ends = np.cumsum([len(r[-2]) for r in rows])[:-1]
            out = [(block, doc, a, b, g, g, sha, at.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), None) for (doc, a, b, g, sha, _, n), at in zip(rows, np.split(place, ends))]
            out.append((block, None, None, None, None, None, None, None, total.tobytes(), keys.tobytes()))
            rows, held, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for f in frames:
            ids, texts = f.column(0).to_pylist(), f.column(1).to_pylist()
            for s in batches(texts):
                for doc, (a, b, g, sha, links) in zip(ids[s], p.documents(texts[s])):
                    keys, n = np.unique(links, return_counts=True)
                    rows.append((doc, a, b, g, sha, keys, n))
                    held += len(keys)
                    if held >= block_links:
                        yield flush()
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DOCS)


def link_rows(blocks: DataFrame) -> DataFrame:
    """``block, key, n``: a row for each distinct link of a block."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for block, n, keys in zip(*(f.column(k).to_pylist() for k in range(3))):
                key = np.frombuffer(keys, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(key), pa.array(np.frombuffer(n, np.int64))], names=["block", "key", "n"])

    return blocks.where("keys is not null").select("block", "n", "keys").mapInArrow(run, "block long, key long, n long")


def link_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """``key, total, best``: how often a link is made in the corpus, and whether no link of its B id is made more often."""
    counts = rows.groupBy("key").agg(F.sum("n").alias("total")).withColumn("id_b", F.col("key") % size_b)
    top = counts.groupBy(F.col("id_b").alias("of_b")).agg(F.max("total").alias("top"))
    return counts.join(top, F.col("id_b") == F.col("of_b")).select("key", "total", (F.col("total") == F.col("top")).alias("best"))


def settle(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block with the counts of their links."""
    counts = counts.sort_values("key")
    total, best = counts["total"].to_numpy(np.int64), counts["best"].to_numpy(bool)
    n_best, count_sum = [], []
    for at, n in zip(docs["at"], docs["n"]):
        at, n = np.frombuffer(at, np.int32), np.frombuffer(n, np.int32).astype(np.int64)
        n_best.append(int(n[best[at]].sum()))
        count_sum.append(int((n * total[at]).sum()))
    return docs.assign(n_best=n_best, count_sum=count_sum)[[x.split()[0] for x in RESULT.split(", ")]].assign(doc_id=docs["doc_id"].astype("Int64"))


def align_documents(docs: DataFrame, models: tuple[str, str] | None = None, block_links: int = BLOCK_LINKS) -> DataFrame:
    """A row a document: tokens of either vocabulary, groups, links, links that are the best of their B id, the sum of their counts, the digest of its groups."""
    import sentencepiece

    models = models or default_models()
    size_b = sentencepiece.SentencePieceProcessor(model_file=models[1]).get_piece_size()
    blocks = common.written(encoded(docs, models, block_links))
    rows = link_rows(blocks)
    counts = common.written(link_counts(rows, size_b))
    known = rows.join(counts.withColumnRenamed("key", "of_key"), F.col("key") == F.col("of_key")).select("block", "key", "total", "best")
    own = blocks.where("keys is null").drop("keys")
    return own.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(settle, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return align_documents(common.documents(spark, sf_dir))
