"""Token-ID output in training order: a keyed permutation gives every sequence its slot.

Every document is encoded (a byte-level BPE vocabulary, read by tiktoken) and cut into sequences of up to
``SEQ_TOKENS`` ids.  Sequences get dense numbers 0..N-1 in two steps (documents
dealt to ``BUCKETS`` by a hash of id and text, offsets by running sums over the
buckets; only counts travel for it), so that any partitioning gives the same
numbers, and a keyed
Feistel network with cycle-walking maps number to slot, a permutation of 0..N-1
that needs no sort and no state.  Slots are dealt by range to parts of whole
shards, many sequences to a compressed row; a task writes its shards one after another, record k of a shard at byte
``k * stride``, so a reader can start anywhere and read on in order.

A record holds the number of ids and the ids, padded to the stride (both as
little-endian integers of ``width`` bytes).  A shard is written under a
temporary name and renamed, so a task that is run again writes the same file.

Defined results: null and empty texts have no sequence; rows that repeat are
numbered apart; a null doc_id is a document like others; no rows, no shards.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEQ_TOKENS, SHARD_RECORDS, KEY, ROUNDS, WIDTH, BROADCAST_DOCS, BUCKETS, LEVEL = 256, 16384, 0x5DEECE66D, 6, 2, 1_000_000, 4096, 6
NONE = -(2**63)  # a null doc_id


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """One encoder per worker process and vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(number: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of sequence numbers: a keyed permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = np.asarray(number).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(rounds):
            left, right = right, left ^ (mixed(right + np.uint64((key + 0x9E3779B97F4A7C15 * (r + 1)) % 2**64)) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]  # cycle-walking: beyond n, permute again
    return out.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str | None = None, seq_tokens: int = SEQ_TOKENS, width: int = WIDTH) -> DataFrame:
    """``doc_id, row, copy, seq, n_tokens, ids``: the ids of each sequence as bytes; ``row, copy`` names the document."""
    path = vocabulary or default_vocabulary()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        if e.n_vocab > 1 << (8 * width):
            raise ValueError("ids do not fit the width")
        for f in frames:
            for start in range(0, len(f), 500):
                part, rows = f.iloc[start : start + 500], []
                for d, k, c, text in zip(part["doc_id"], part["row"], part["copy"], part["body"]):
                    raw = e.encode_to_numpy(text).astype(f"<u{width}")
                    rows += [(d, k, c, i, len(s := raw[at : at + seq_tokens]), s.tobytes()) for i, at in enumerate(range(0, len(raw), seq_tokens))]
                yield pd.DataFrame(rows, columns=["doc_id", "row", "copy", "seq", "n_tokens", "ids"])

    # Rows that repeat are numbered apart.
    rows = common.numbered(docs.select("doc_id", common.row_key().alias("row"), F.coalesce("text", F.lit("")).alias("body")))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(run, "doc_id string, row long, copy long, seq int, n_tokens int, ids binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def number(seqs: DataFrame) -> tuple[DataFrame, int]:
    """``seqs`` with dense ``number``; and how many there are.  ``seqs`` is read twice, its ids once."""
    spark = seqs.sparkSession
    per_doc = seqs.groupBy("row", "copy").agg(F.max("seq").alias("last")).select("row", "copy", (F.col("last") + 1).cast("long").alias("n"), F.pmod("row", F.lit(BUCKETS)).cast("int").alias("bucket"))
    per_doc = common.written(per_doc)
    counts = {r["bucket"]: r["n"] for r in per_doc.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # BUCKETS rows at most
    offsets, total = [], 0
    for b in range(BUCKETS):
        offsets.append((b, total))
        total += counts.get(b, 0)
    offset = F.broadcast(spark.createDataFrame(offsets, "bucket int, offset long"))  # BUCKETS rows
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("row", "copy")) - F.col("n")
    first = per_doc.withColumn("before", before).join(offset, "bucket").select("row", "copy", (F.col("offset") + F.col("before")).alias("first"))
    if per_doc.count() <= BROADCAST_DOCS:  # three numbers a document; beyond that a shuffled join
        first = F.broadcast(first)
    return seqs.join(first, ["row", "copy"]).select(*seqs.columns, (F.col("first") + F.col("seq")).alias("number")), total


def shards(docs: DataFrame, out_dir: str, vocabulary: str | None = None, seq_tokens: int = SEQ_TOKENS, shard_records: int = SHARD_RECORDS, key: int = KEY, width: int = WIDTH) -> DataFrame:
    """Write the shards; a row per sequence: ``slot, shard, byte_at, doc_id, seq, n_tokens, record_sha256``."""
    seqs = common.written(sequences(docs, vocabulary, seq_tokens, width), LEVEL)
    numbered, n = number(seqs)
    stride = width * (seq_tokens + 1)

    n_shards = max(1, -(-n // shard_records))
    n_parts = min(n_shards, 2 * common.parallel(docs))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sequences by range of slots, many to a compressed row."""
        held, size = [], 0
        for f in frames:
            held.append(f)
            size += int(f["n_tokens"].sum()) * width
            if size > 48 << 20:
                yield pack(pd.concat(held))
                held, size = [], 0
        if held:
            yield pack(pd.concat(held))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        slot = permute(f["number"].to_numpy(), n, key)
        part = slot // shard_records * n_parts // n_shards
        order = np.lexsort((slot, part))
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        rows, z = [], zstandard.ZstdCompressor(level=LEVEL)
        doc, seq, tokens, ids = f["doc"].to_numpy(np.int64), f["seq"].to_numpy("<i4"), f["n_tokens"].to_numpy("<u2"), f["ids"].to_numpy()
        for s, e in zip([0, *cuts], [*cuts, len(order)]):
            if e > s:
                o = order[s:e]
                rows.append((int(part[o[0]]), z.compress(b"".join([len(o).to_bytes(8, "little"), slot[o].astype("<i8").tobytes(), doc[o].tobytes(), seq[o].tobytes(), tokens[o].tobytes(), *ids[o]]))))
        return pd.DataFrame(rows, columns=["part", "payload"]).astype({"part": "int32"})

    def unpack(data: bytes) -> tuple[np.ndarray, ...]:
        raw = zstandard.ZstdDecompressor().decompress(data)
        m, at, out = int.from_bytes(raw[:8], "little"), 8, []
        for kind in ("<i8", "<i8", "<i4", "<u2"):
            out.append(np.frombuffer(raw, kind, m, at))
            at += m * np.dtype(kind).itemsize
        end = at + np.cumsum(out[3].astype(np.int64)) * width
        ids = np.empty(m, object)
        ids[:] = [raw[s:e] for s, e in zip([at, *end[:-1]], end)]
        return (*out, ids)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        rows = ((p, bytes(b)) for f in frames for p, b in zip(f["part"], f["payload"]))
        for _, payloads in itertools.groupby(rows, key=lambda r: r[0]):  # sorted: one range of slots at a time
            slot, doc, seq, tokens, ids = (np.concatenate(c) for c in zip(*(unpack(b) for _, b in payloads)))
            order = np.argsort(slot)
            shard = slot[order] // shard_records
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(order)]):
                o, name, digests = order[s:e], f"_writing-{uuid.uuid4().hex}", []
                with store.open_output_stream(f"{root}/{name}") as file:
                    for i in o:
                        record = (int(tokens[i]).to_bytes(width, "little") + ids[i]).ljust(stride, b"\0")
                        file.write(record)
                        digests.append(hashlib.sha256(record).hexdigest())
                store.move(f"{root}/{name}", f"{root}/shard-{int(shard[s]):08d}.bin")
                yield pd.DataFrame({"slot": slot[o], "shard": shard[s:e], "byte_at": slot[o] % shard_records * stride, "doc": doc[o], "seq": seq[o], "n_tokens": tokens[o].astype(np.int32), "record_sha256": digests})

    rows = numbered.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc"), "seq", "n_tokens", "ids", "number")
    dealt = rows.mapInPandas(deal, "part int, payload binary").repartition(common.parallel(docs), "part").sortWithinPartitions("part")
    out = dealt.mapInPandas(write, "slot long, shard long, byte_at long, doc long, seq int, n_tokens int, record_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc", F.lit(NONE))).drop("doc")


def read_records(data: bytes, width: int = WIDTH, seq_tokens: int = SEQ_TOKENS) -> list[list[int]]:
    """Ids of each record of a shard's bytes."""
    grid = np.frombuffer(data, f"<u{width}").reshape(-1, seq_tokens + 1)
    return [row[1 : 1 + row[0]].tolist() for row in grid]


def query(spark, sf_dir: str) -> DataFrame:
    base = common.shared_dir(spark)
    base = base if "://" in base else base.replace("file:", "file://", 1) if base.startswith("file:") else f"file://{base}"
    return shards(common.documents(spark, sf_dir), f"{base}/token-shards-{uuid.uuid4().hex}")
