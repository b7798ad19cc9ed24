"""Line dedup: range-partitioned line hashes, a secondary sort, first occurrences, keep bitmaps.

Lines are cut and hashed where the text is read; only ``(hash, document,
position)`` travels.  The hashes are range-partitioned together with the
document, so that a line held by a third of all documents spreads over many
ranges.  Inside a range the rows are sorted by line, document (largest first)
and position, and a running window streams over them: the first row of a line
names the document that keeps it, the document's rank counts those that hold it.
A line that lies in one range is settled there.  At most one line a range goes
on into the next one: the ends of all ranges (two rows each) tell which, and
these few lines get their totals over the ranges.  Rows that lose a line become
64-bit words of a sparse bitmap per document, compressed in that only words
that drop a line are stored; the text is joined with its bitmap last.

Defined results: a null or empty text is one empty line, which is never
dropped.  Rows that repeat a doc_id count as one document per id for the
"found in n documents" test; each row keeps its own bitmap (rows are told
apart by a hash of their text).  A null doc_id is one document ranked below
all others.  Extra columns are ignored.  Line keys are compared by 128 bits of
hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def ranked_lines(keyed: DataFrame, parts: int) -> DataFrame:
    """``keyed`` in sorted ranges, with the document that keeps the line and the number of documents that hold it in the range."""
    ranged = keyed.repartitionByRange(parts, "h1", "h2", "doc_id").withColumn("range", F.spark_partition_id())
    line = Window.partitionBy("range", "h1", "h2")
    first = F.first("doc_id").over(line.orderBy(F.desc("doc_id"), "word"))
    ranked = ranged.select("*", first.alias("first_doc"), F.dense_rank().over(line.orderBy(F.desc("doc_id"))).alias("nth_doc"))
    return ranked.select("*", F.max("nth_doc").over(line).alias("n_docs"))


def line_drops(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row per document that loses lines: ``(doc_id, text_hash, drop_words)``.

    ``drop_words`` maps a word number to a 64-bit mask; bit b of word w drops
    line ``64 * w + b``.  A word that is not there keeps all its lines.
    """
    lines = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    key = common.lower_ascii(common.strip_ascii(F.col("line")))
    keyed = (
        lines.select("doc_id", "text_hash", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word"), F.expr("shiftleft(1L, cast(pos % 64 as int))").alias("bit"))
    )
    keyed = common.cut(keyed)  # a few numbers a line, read for the ranges' bounds and for the ranges
    ranked = common.cut(ranked_lines(keyed, common.parallel(docs)))
    # Lines that go over the end of a range: two rows a range tell which.
    key = F.struct("h1", "h2")
    ends = ranked.groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.select("range", F.explode(F.array("low", "high")).alias("key")).distinct().groupBy("key").count().where("count > 1").select("key.h1", "key.h2")
    over = ranked.join(F.broadcast(ends), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "range").agg(F.max("n_docs").alias("n_docs"), F.first("first_doc").alias("first_doc"))
    over = over.groupBy("h1", "h2").agg(F.sum("n_docs").alias("all_docs"), F.max("first_doc").alias("top_doc"))
    whole = ranked.join(F.broadcast(over), ["h1", "h2"], "left")
    first = F.when(F.col("all_docs").isNull(), F.col("first_doc")).otherwise(F.col("top_doc"))
    lost = whole.where((F.coalesce("all_docs", "n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(first))
    return (
        lost.groupBy("doc_id", "text_hash", "word")
        .agg(F.bit_or("bit").alias("mask"))
        .groupBy("doc_id", "text_hash")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("drop_words"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Every row with ``n_lines``, ``n_dropped``, ``kept_text`` and its bitmap, beside ``doc_id``."""
    drops = line_drops(docs, min_chars, min_docs, text, doc).select(F.col("doc_id").alias("d_doc"), F.col("text_hash").alias("d_hash"), "drop_words")
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"), F.xxhash64(text).alias("text_hash"))
    joined = rows.join(drops, rows.doc_id.eqNullSafe(drops.d_doc) & (rows.text_hash == drops.d_hash), "left")
    lines = F.split("body", "\n")
    mask = lambda i: F.coalesce(F.try_element_at("drop_words", F.expr("0") + F.floor(i / 64).cast("int")), F.lit(0))
    kept = F.when(F.col("drop_words").isNull(), F.col("body")).otherwise(F.array_join(F.filter(lines, lambda x, i: F.getbit(mask(i), i % 64) == 0), "\n"))
    dropped = F.when(F.col("drop_words").isNull(), 0).otherwise(F.aggregate(F.map_values("drop_words"), F.lit(0), lambda a, x: a + F.bit_count(x)))
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept_text"), "drop_words")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", common.sha256_text(F.col("kept_text")).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i AS pos, s[i] AS line,
         translate(regexp_replace(regexp_replace(s[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE top IS NOT NULL AND top <> doc_id))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE top IS NULL OR top = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id
"""
