"""Signatures of texts and near duplicates by them: SimHash, MinHash, hashed vectors; mentions and claims."""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

try:
    from _md5 import md5  # for short texts in half the time
except ImportError:
    from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import register
from .graph import components, written
from .setjoin import may_overlap, parity

BITS, SIMILAR = 64, 0.85
#: Longs of a sketch of a word set.
SKETCH = 8


def tokens(text: Column) -> Column:
    """Words in lower case; what is neither letter, digit nor underscore separates."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def simhash(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, low, high``: a 64-bit SimHash over word 3-grams, as two halves of 32 bits; 0 without a 3-gram.

    A row per gram, counted by text with map-side combine: 32 sums, each of two bits in lanes of 32.
    """
    words = docs.select(key, tokens(F.col(text)).alias("w"))
    grams = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.md5(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))))
    each = words.select(key, F.explode_outer(grams).alias("h"))
    half = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("long")
    each = each.select(key, half(1).bitwiseOR(F.shiftleft(half(9), 32)).alias("x"))
    lanes = F.lit(1 << 32 | 1)
    sums = each.groupBy(key).agg(F.count("x").alias("n"), *[F.sum(F.shiftright("x", i).bitwiseAND(lanes)).alias(f"x{i}") for i in range(32)])
    counts = {"low": lambda i: F.col(f"x{i}").bitwiseAND(F.lit(0xFFFFFFFF)), "high": lambda i: F.shiftrightunsigned(f"x{i}", 32)}
    whole = lambda c: F.coalesce(sum((F.when(2 * counts[c](i) > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(32)), F.lit(0)), F.lit(0)).cast("long")
    return sums.select(key, whole("low").alias("low"), whole("high").alias("high"))


#: Seconds that a filed row and a compared pair take; rows filed in a task; pairs handed on at once.
ROW_S, PAIR_S, FILED, HANDED = 1.5e-6, 6e-9, 200_000, 1_000_000


def block_plan(prints: int, apart: int) -> tuple[list[tuple[int, int]], int]:
    """Blocks (start, width) of the fingerprint, and how many of them make a key.

    Of ``apart + k`` blocks, fingerprints that differ in ``apart`` bits share ``k``
    whole ones.  More blocks make longer keys and more of them; ``k`` is the one
    by which filing under all keys and comparing within them cost least.
    """

    def cost(k: int) -> float:
        keys = math.comb(apart + k, k)
        return keys * prints * (ROW_S + PAIR_S * prints / 2 ** (1 + BITS * k / (apart + k)))

    k = min(range(1, 6), key=cost)
    widths = [BITS // (apart + k) + (i < BITS % (apart + k)) for i in range(apart + k)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)], k


def simhash_pairs(prints: DataFrame, key: str, threshold: float = SIMILAR) -> DataFrame:
    """``a, b, similarity``: fingerprints alike, each named by the smallest key that has it.

    Copies share a fingerprint and stand as one.  No pair is lost: candidates
    share all blocks of a key (``block_plan``), and are compared where a key's
    fingerprints meet, under the first key that both share, so each comes once.
    """
    each = written(prints.groupBy("low", "high").agg(F.min(key).alias("id")))
    n, apart = each.count(), math.floor(BITS * (1 - threshold) + 1e-9)
    blocks, k = block_plan(n, apart)
    masks = [sum(((1 << w) - 1) << s for s, w in c) for c in itertools.combinations(blocks, k)]
    half = lambda c, m: F.col(c).bitwiseAND(F.lit(m & 0xFFFFFFFF))
    keys = F.array(*[F.struct(F.lit(i).alias("n"), F.xxhash64(half("low", m), half("high", m >> 32)).alias("v")) for i, m in enumerate(masks)])
    files = max(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // FILED)
    filed = each.select("id", "low", "high", F.explode(keys).alias("k")).select("id", "low", "high", "k.*").repartition(files, "n", "v").drop("v")

    def compare(batches):
        rows = pd.concat([pd.DataFrame({"id": [], "low": [], "high": [], "n": []}, dtype="int64"), *batches])
        if not len(rows):
            return
        mask, number = np.array(masks, dtype=np.uint64), rows["n"].to_numpy()
        x = rows["high"].to_numpy().astype(np.uint64) << np.uint64(32) | rows["low"].to_numpy().astype(np.uint64)
        order = np.lexsort((x & mask[number], number))
        x, number, ids = x[order], number[order], rows["id"].to_numpy()[order]
        value = x & mask[number]
        starts = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (number[1:] != number[:-1])])
        sizes = np.diff(np.r_[starts, len(x)])
        end = np.repeat(starts + sizes, sizes)
        found, held, d, at = [], 0, 0, np.arange(len(x))
        while len(at) or held:
            d += 1
            at = at[at + d < end[at]]  # the d-th after each, while it has the same key
            near = at[np.bitwise_count(x[at] ^ x[at + d]) <= apart]
            found.append((near, near + d))
            held += len(near)
            if held and (held >= HANDED or not len(at)):
                i, j = (np.concatenate(c) for c in zip(*found))
                differ, first = x[i] ^ x[j], np.full(len(i), -1)
                for m in range(len(mask) - 1, -1, -1):
                    first[differ & mask[m] == 0] = m
                similarity = 1 - np.bitwise_count(differ) / BITS
                keep = (first == number[i]) & (similarity >= threshold)
                one, two = ids[i[keep]], ids[j[keep]]
                yield pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two), "similarity": similarity[keep]})
                found, held = [], 0

    kind = each.schema["id"].dataType.simpleString()
    return filed.mapInPandas(compare, f"a {kind}, b {kind}, similarity double")


#: Words whose digests a task remembers; sets that are signed at once.
REMEMBERED, SIGNED = 200_000, 1000
HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


class Digests:
    """MD5 of words under ``hashes`` seeds, as two halves of 64 bits each; a word is worked out once while it is remembered."""

    def __init__(self, hashes: int) -> None:
        self.seeds, self.seen = [f"{i}:".encode() for i in range(hashes)], {}
        self.halves = np.zeros((0, hashes, 2), np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        """The halves of each of ``words``, which come once each; those that come first, as frequent ones do, are remembered."""
        new = [w for w in words if w not in self.seen]
        at = {w: len(self.seen) + k for k, w in enumerate(new)}
        made = np.frombuffer(b"".join([md5(seed + w).digest() for w in map(str.encode, new) for seed in self.seeds]), ">u8").astype(np.uint64).reshape(-1, len(self.seeds), 2)
        both = np.concatenate([self.halves[: len(self.seen)], made])
        out = both[[self.seen[w] if w in self.seen else at[w] for w in words]]
        kept = new[: max(REMEMBERED - len(self.seen), 0)]
        if kept:
            self.halves = both[: len(self.seen) + len(kept)]
            self.seen.update((w, at[w]) for w in kept)
        return out


def signatures(words: pa.Array, known: Digests) -> pa.Array:
    """The least digest of each set under each seed, in hexadecimal; no set is empty."""
    coded = pc.dictionary_encode(pc.list_flatten(words))
    halves, codes = known.of(coded.dictionary.to_pylist()), coded.indices.to_numpy()
    n = pc.list_value_length(words).to_numpy()
    starts = np.cumsum(n) - n
    least = np.zeros((len(n), len(known.seeds), 2), ">u8")
    for k in range(len(known.seeds)):
        high, low = halves[codes, k, 0], halves[codes, k, 1]
        least[:, k, 0] = top = np.minimum.reduceat(high, starts)
        least[:, k, 1] = np.minimum.reduceat(np.where(high == np.repeat(top, n), low, np.uint64(2**64 - 1)), starts)
    text = HEX[np.frombuffer(least.tobytes(), np.uint8)].tobytes()
    each = pa.StringArray.from_buffers(least.size // 2, pa.py_buffer(np.arange(0, len(text) + 1, 32, dtype=np.int32)), pa.py_buffer(text))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(each) + 1, len(known.seeds), dtype=np.int32)), each)


def word_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, words``: the distinct words of texts that have any."""
    return docs.select(key, F.array_sort(F.array_distinct(tokens(F.col(text)))).alias("words")).where(F.size("words") > 0)


def minhash(docs: DataFrame, key: str, text: str, hashes: int = 16) -> DataFrame:
    """``key, words, signature``: the distinct words, and the least hash of them under each of ``hashes`` seeds."""
    return signed_sets(word_sets(docs, key, text), key, hashes)


def signed_sets(words: DataFrame, key: str, hashes: int = 16) -> DataFrame:
    """``key, words`` with the ``signature`` of each set."""

    def sign(batches):
        known = Digests(hashes)
        for batch in batches:
            for at in range(0, batch.num_rows, SIGNED):
                part = batch.slice(at, SIGNED)
                yield pa.RecordBatch.from_arrays([*part.columns, signatures(part.column(1), known)], [key, "words", "signature"])

    return words.mapInArrow(sign, T.StructType([*words.schema.fields, T.StructField("signature", T.ArrayType(T.StringType()))]))


def minhash_pairs(signed: DataFrame, key: str, threshold: float = 0.8, rows: int = 4) -> DataFrame:
    """``a, b, jaccard``: word sets alike, each named by the smallest key that has it; candidates share a band of ``rows`` hashes.

    In a band, sizes and sketches of the sets leave out most of what cannot reach
    the threshold, and the rest are compared where they meet: words are shuffled
    with the sets that share a band with another, and never for each pair.
    """
    n = F.call_function("div", F.size("signature"), F.lit(rows))
    bands = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(i, F.array_join(F.slice("signature", (i * rows + 1).cast("int"), F.lit(rows)), "|")))
    each = signed.select(key, "words", bands.alias("bands")).groupBy("words").agg(F.min(key).alias("id"), F.first("bands").alias("bands"))
    each = written(each.select("id", "words", "bands", F.size("words").alias("n"), *parity(F.col("words"), SKETCH)))
    in_band = each.select("*", F.posexplode("bands").alias("at", "band"))
    shared = in_band.groupBy("at", "band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("at", "band")
    met = written(in_band.join(shared, ["at", "band"], "left_semi"))
    part = Fraction(str(threshold))
    # The first band that two share counts, so a pair comes once.
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), F.lit(True)) == F.col("x.at") + 1
    same = F.size(F.array_intersect("x.words", "y.words"))
    size = F.col("x.n") + F.col("y.n")
    enough = same * (part.numerator + part.denominator) >= size * part.numerator  # words are compared once a candidate
    pairs = met.alias("x").join(met.alias("y"), [F.col("x.at") == F.col("y.at"), F.col("x.band") == F.col("y.band"), F.col("x.id") < F.col("y.id"), may_overlap(SKETCH, part.numerator, part.denominator), first, enough])
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), same.alias("same"), size.alias("size")).select("a", "b", (F.col("same") / (F.col("size") - F.col("same"))).alias("jaccard"))


def hash_vectors(docs: DataFrame, keys: list[str], text: str, dim: int = 64, seed: str = "0") -> DataFrame:
    """``keys, bucket, value``: character 3-grams hashed into ``dim`` (a power of two up to 256) signed buckets, of length one in all.

    SHA-256 of seed and gram: its first byte gives the bucket, the second eight
    bytes (little-endian, signed) the weight.  A text of fewer than three
    characters is one gram.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1)))
    each = docs.select(*keys, F.explode(F.transform(starts, lambda i: F.sha2(F.concat(F.lit(f"{seed}:"), F.substring(t, i, 3)), 256))).alias("h"))
    byte = lambda at: F.conv(F.substring("h", 2 * at + 1, 2), 16, 10).cast("long")
    low, high = byte(8) + byte(9) * 256 + byte(10) * 65536 + byte(11) * 16777216, byte(12) + byte(13) * 256 + byte(14) * 65536 + byte(15) * 16777216
    signed = F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high)
    sums = each.select(*keys, (byte(0) % dim).alias("bucket"), (signed / float(1 << 31) + low / float(1 << 63)).alias("v")).groupBy(*keys, "bucket").agg(F.sum("v").alias("v"))
    return sums.withColumn("value", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*keys)))).drop("v")


# Time hints and symbols with other names.
HINTS = ["today", "tonight", "tomorrow", "this week", "next week", "this month", "next month", "this year", "next year", "soon"]


def sentences(text: Column) -> Column:
    """Sentences by end marks and line ends."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def claims(items: DataFrame, key: str, title: str, content: str, symbols: list[str]) -> DataFrame:
    """``key, claim, score, time_hint``: the sentence that names most symbols, is long enough and has a capital early; the first of equals."""
    every = items.select(key, F.array_distinct(F.concat(sentences(F.col(title)), sentences(F.col(content)))).alias("s"))
    hits = lambda s: sum((F.contains(s, F.lit(x)).cast("int") for x in symbols), F.lit(0))
    score = lambda s: 2.0 * hits(s) + F.when(F.size(F.split(s, r"\s+")) >= 6, 0.5).otherwise(0.0) + F.when(F.substring(s, 2, 4).rlike("[A-Z]"), 0.5).otherwise(0.0)
    ranked = F.array_max(F.transform("s", lambda s, i: F.struct(score(s).alias("score"), (-i).alias("i"), s.alias("s"))))
    hint = F.regexp_extract(F.lower(F.concat_ws(" ", "s")), rf"\b({'|'.join(HINTS)})\b", 1)
    return every.select(key, ranked.alias("best"), F.nullif(hint, F.lit("")).alias("time_hint")).select(key, F.col("best.s").alias("claim"), F.col("best.score").alias("score"), "time_hint")


#: Vectors of a side that meet in a task, and in a product; slices that small inputs are cut into; axes that a bound looks at.
SLICE, TILE, SPREAD, AXES = 64_000, 2000, 8, 16


def vector_duplicates(vectors: DataFrame, key: str, vector: str, threshold: float = 0.95, slice_rows: int = SLICE) -> DataFrame:
    """``a, b, cosine``: vectors alike, ``b`` the duplicate of the smaller ``a``; no pair is lost.  Zero vectors have none.

    Equal vectors stand as one.  In many dimensions no index leaves much out, so
    all pairs are compared, in bounded memory: vectors are cut into slices, two
    slices meet in a task, ``TILE`` of each in a product.  The first ``AXES`` axes and
    the length of the rest bound a cosine from above (Cauchy-Schwarz); only pairs
    within the bound are worked out whole.
    """
    each = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).groupBy("v").agg(F.min("id").alias("id"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    each = written(each.withColumn("norm", norm).where("norm > 0").select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v")))
    n = each.count()
    parts = max(1, -(-n // slice_rows), min(SPREAD, -(-n // TILE)))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    cut = each.select("id", "v", F.size("v").alias("dim"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other"))
    met = cut.select("dim", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "id", "v").repartition(parts * (parts + 1) // 2, "p", "q")
    kind = each.schema["id"].dataType.simpleString()

    def compare(rows: pa.Table) -> pa.Table:
        p, q, dim = (rows[c][0].as_py() for c in ("p", "q", "dim"))
        part, ids = rows["part"].to_numpy(), rows["id"].to_numpy()
        v = pc.list_flatten(rows["v"]).to_numpy().reshape(-1, dim)
        rest = np.sqrt(np.square(v[:, AXES:]).sum(axis=1, keepdims=True))
        bound = np.hstack([v[:, :AXES], rest]).astype(np.float32)
        left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
        found = [(ids[:0], ids[:0], np.zeros(0))]
        for s in range(0, len(left), TILE):
            for t in range(s if p == q else 0, len(right), TILE):
                x, y = left[s : s + TILE], right[t : t + TILE]
                i, j = np.nonzero(bound[x] @ bound[y].T >= threshold - 1e-4)
                if len(i) > TILE * TILE // 8:  # the bound says little here
                    i, j = np.nonzero(v[x] @ v[y].T >= threshold - 1e-9)
                for k in range(0, len(i), TILE * TILE // AXES):
                    a, b = x[i[k : k + TILE * TILE // AXES]], y[j[k : k + TILE * TILE // AXES]]
                    cosine = np.concatenate([np.einsum("ij,ij->i", v[a[m : m + TILE * AXES]], v[b[m : m + TILE * AXES]]) for m in range(0, len(a), TILE * AXES)])
                    keep = (cosine >= threshold) & ((a < b) if p == q else True)
                    one, two = ids[a[keep]], ids[b[keep]]
                    found.append((np.minimum(one, two), np.maximum(one, two), cosine[keep]))
        return pa.table(dict(zip(("a", "b", "cosine"), (pa.array(np.concatenate(c), type=f) for c, f in zip(zip(*found), (rows.schema.field("id").type,) * 2 + (pa.float64(),))))))

    return met.groupBy("dim", "p", "q").applyInArrow(compare, f"a {kind}, b {kind}, cosine double")


BIT_SUMS = ", ".join(f"sum(2 * (({c} >> {i}) & 1) - 1) AS {c}{i}" for c in "xy" for i in range(32))
WHOLE = {c: " + ".join(f"CASE WHEN {c}{i} > 0 THEN {1 << i} ELSE 0 END" for i in range(32)) for c in "xy"}
TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: w <> '')"
SIM_SQL = f"""d AS (SELECT doc_id, {TOKENS} AS w FROM documents), e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
g AS (SELECT doc_id, md5(word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o) AS h FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT AS x, ('0x' || substr(h, 9, 8))::BIGINT AS y FROM g WHERE h IS NOT NULL), s AS (SELECT doc_id, {BIT_SUMS} FROM b GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce({WHOLE['x']}, 0)::BIGINT AS low, coalesce({WHOLE['y']}, 0)::BIGINT AS high FROM d LEFT JOIN s ON d.doc_id = s.doc_id)"""
SIM_PAIRS = """, u AS (SELECT low, high, min(doc_id) AS id FROM f GROUP BY low, high),
p AS (SELECT a.id AS a, b.id AS b, 1 - (bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high))) / 64 AS similarity FROM u a JOIN u b ON a.id < b.id)
SELECT a, b, similarity FROM p WHERE similarity >= 0.85"""
register("simhash", lambda v: simhash(v.documents, "doc_id", "text"), f"WITH {SIM_SQL} SELECT doc_id, low, high FROM f")
register("simhash_pairs", lambda v: simhash_pairs(simhash(v.documents, "doc_id", "text"), "doc_id"), f"WITH {SIM_SQL}{SIM_PAIRS}")
MIN_SQL = ", ".join(f"min(md5('{i}:' || w)) AS m{i}" for i in range(16))
BANDS = ", ".join(f"md5(concat_ws('|', {b}, m{4 * b}, m{4 * b + 1}, m{4 * b + 2}, m{4 * b + 3}))" for b in range(4))
register("minhash", lambda v: minhash_pairs(minhash(v.documents, "doc_id", "text"), "doc_id").withColumn("jaccard", F.round("jaccard", 6)), f"""WITH d AS (SELECT doc_id, list_sort(list_distinct({TOKENS})) AS ws FROM documents), u AS (SELECT ws, min(doc_id) AS id FROM d WHERE len(ws) > 0 GROUP BY ws),
e AS (SELECT id, unnest(ws) AS w FROM u), m AS (SELECT id, {MIN_SQL} FROM e GROUP BY id), b AS (SELECT id, unnest([{BANDS}]) AS band FROM m), p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM b x JOIN b y ON x.band = y.band AND x.id < y.id),
k AS (SELECT a, b, len(list_intersect(x.ws, y.ws)) AS same, len(x.ws) AS n, len(y.ws) AS m FROM p JOIN u x ON x.id = a JOIN u y ON y.id = b) SELECT a, b, round(same / (n + m - same), 6) AS jaccard FROM k WHERE same / (n + m - same) >= 0.8""")
LE = lambda at: " + ".join(f"('0x' || substr(h, {2 * (at + i) + 1}, 2))::BIGINT * {256**i}" for i in range(4))
register("hash_embed", lambda v: hash_vectors(v.conversations, ["conv_id", "turn"], "text").withColumn("value", F.round("value", 6)), f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), p AS (SELECT conv_id, turn, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM c), g AS (SELECT conv_id, turn, sha256('0:' || substr(t, i, 3)) AS h FROM p),
w AS (SELECT conv_id, turn, ('0x' || substr(h, 1, 2))::BIGINT % 64 AS bucket, ({LE(8)}) AS low, ({LE(12)}) AS high FROM g), s AS (SELECT conv_id, turn, bucket, sum((CASE WHEN high >= 2147483648 THEN high - 4294967296 ELSE high END) / 2147483648.0::DOUBLE + low / 9223372036854775808.0::DOUBLE) AS v FROM w GROUP BY ALL)
SELECT conv_id, turn, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM s""")
#: Stand-ins for near copies: every third vector again, moved along its first few axes.
NEAR_COPIES = "SELECT vec_id, embedding AS v FROM {0} UNION ALL SELECT vec_id + 1000000, {1} FROM {0} WHERE vec_id % 3 = 0"
with_copies = lambda v: v.spark.sql(NEAR_COPIES.format("{e}", "transform(embedding, (x, i) -> CAST(x + CASE WHEN i < vec_id % 7 THEN 0.15D ELSE 0 END AS FLOAT))"), e=v.embeddings)
COPIES_SQL = NEAR_COPIES.format("embeddings", "list_transform(embedding, lambda x, i: (x + CASE WHEN i <= vec_id % 7 THEN 0.15::DOUBLE ELSE 0::DOUBLE END)::FLOAT)")
register("vec_dedup", lambda v: vector_duplicates(with_copies(v), "vec_id", "v").withColumn("cosine", F.round("cosine", 6)), f"WITH c AS ({COPIES_SQL}), u AS (SELECT v::DOUBLE[] AS v, min(vec_id) AS id FROM c GROUP BY 1) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.95")
SYMBOLS = ["The", "And", "Er", "On"]
HIT_SQL = " + ".join(f"contains(x, '{s}')::INT" for s in SYMBOLS)
register("claims", lambda v: claims(v.news, "doc_id", "title", "content", SYMBOLS), rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(title, ''), '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') || list_filter(list_transform(regexp_split_to_array(coalesce(content, ''), '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM news),
e AS (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM s), r AS (SELECT doc_id, x, i, 2.0 * ({HIT_SQL}) + CASE WHEN len(regexp_split_to_array(x, '\s+')) >= 6 THEN 0.5 ELSE 0.0 END + CASE WHEN regexp_matches(substr(x, 2, 4), '[A-Z]') THEN 0.5 ELSE 0.0 END AS score FROM e),
b AS (SELECT doc_id, x, score::DOUBLE AS score FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1)
SELECT s.doc_id, b.x AS claim, b.score, nullif(regexp_extract(lower(array_to_string(s.s, ' ')), '\b({'|'.join(HINTS)})\b', 1), '') AS time_hint FROM s LEFT JOIN b ON b.doc_id = s.doc_id""")


def near_clusters(docs: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """``key, cluster``: components of MinHash pairs and of equal word sets, named by their smallest key; texts without words stand alone."""
    sets = written(word_sets(docs, key, text).groupBy("words").agg(F.min(key).alias("head"), F.collect_list(key).alias("members")))
    first = sets.select("head", F.explode("members").alias(key))
    pairs = written(minhash_pairs(signed_sets(sets.select("head", "words"), "head"), "head", threshold).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    comp = first.select("head").distinct() if pairs.isEmpty() else components(pairs).select(F.col("node").alias("head"), "comp")
    named = first.join(comp, "head", "left") if "comp" in comp.columns else first.withColumn("comp", F.col("head"))
    return docs.select(key).join(named.select(key, F.coalesce("comp", "head").alias("cluster")), key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


register("news_cluster", lambda v: near_clusters(v.documents, "doc_id", "text"), f"""WITH RECURSIVE d AS (SELECT doc_id, list_sort(list_distinct({TOKENS})) AS ws FROM documents), u AS (SELECT ws, min(doc_id) AS id FROM d WHERE len(ws) > 0 GROUP BY ws),
e AS (SELECT id, unnest(ws) AS w FROM u), m AS (SELECT id, {MIN_SQL} FROM e GROUP BY id), b AS (SELECT id, unnest([{BANDS}]) AS band FROM m), p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM b x JOIN b y ON x.band = y.band AND x.id < y.id),
k AS (SELECT a, b, len(list_intersect(x.ws, y.ws)) AS same, len(x.ws) AS n, len(y.ws) AS m FROM p JOIN u x ON x.id = a JOIN u y ON y.id = b), l AS (SELECT a, b FROM k WHERE same / (n + m - same) >= 0.8), t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id AS v, id AS w FROM u UNION SELECT t.b, r.w FROM r JOIN t ON t.a = r.v AND r.w < t.b), c AS (SELECT v, min(w) AS low FROM r GROUP BY v) SELECT d.doc_id, coalesce(c.low, d.doc_id) AS cluster FROM d LEFT JOIN u ON u.ws = d.ws LEFT JOIN c ON c.v = u.id""")
