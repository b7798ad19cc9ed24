"""Quality rules with thresholds learned from mergeable quantile sketches.

Each text is measured once with built-in functions.  Four ratios of a document
are kept as integers and counted into bucket sketches per language and source:
a bucket is the ratio itself up to 32, and beyond that the ratio cut to its
five leading bits, so a sketch has a few hundred buckets at most, merges by
adding counts (Spark does that map-side, so a hot source costs nothing) and
gives any quantile within 1/16, always the same.

The quartiles of a sketch become two fences, ``SPREAD`` times their distance
(one unit of the ratio at least) away from them; no cutoff is fixed.  Repeats
and repeated lines are absent from most documents, so their sketches count the
documents that show them, and a document without them passes.  A group's fences
are averaged with those of all documents, which weigh as much as ``PRIOR``
documents, so small groups lean on the whole and large ones on themselves.  A
join on language and source applies them.

Defined results: a null or empty text has no words and fails; a null language
or source is a group of its own; rows that repeat are judged alike.  Extra
columns are ignored by ``measure`` and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: ratio name -> (numerator, denominator, scale, whether its sketch counts all documents or those that show it)
RATIOS = {
    "symbols": ("n_symbols", "word_chars", 1000, True),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, False),
    "repeats": ("n_repeat_words", "n_words", 1000, False),
    "word_length": ("word_chars", "n_words", 10, True),
}
SPREAD, PRIOR = 3, 30


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the array holds twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, windows).otherwise(F.expr("array()").cast("array<bigint>"))


def covered(pairs: Column) -> Column:
    """Positions covered by windows (three long) that share their hash with another one.

    ``pairs``: the (hash, position) of all windows, sorted; a column, as lambdas evaluate what they capture again and again.
    """
    twice = F.filter(F.transform(pairs, lambda x, k: F.when((x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    return F.aggregate(F.sort_array(twice), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")))["n"]


def measure(docs: DataFrame, text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every text, plus ``extra`` columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select("doc_id", "lang", "source", *extra, body.alias("_body"), common.words(F.col(text)).alias("_words"))
    lines = F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = base.select(
        "doc_id", "lang", "source", *extra, "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"), repeat_words(F.col("_words")).alias("_windows"),
    )
    pairs = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.select("*", pairs.alias("_pairs"))
    return step.select(
        "doc_id", "lang", "source", *extra, "n_words", "word_chars", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered(F.col("_pairs")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    num, den, scale, _ = RATIOS[name]
    return F.when(F.col(den) > 0, F.expr(f"{scale} * {num} div {den}")).otherwise(F.lit(0)).cast("long")


def bucket(v: Column) -> Column:
    """The value cut to its five leading bits: exact up to 32, within 1/16 beyond."""
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def fences(measured: DataFrame, spread: int = SPREAD) -> DataFrame:
    """``whole, lang, source, name, n, low, high``: the fences of each ratio by group, and of all documents together."""
    each = measured.where(~base_failed()).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), ratio(n).alias("v"), F.lit(r[3]).alias("every")) for n, r in RATIOS.items()])).alias("r"))
    each = each.where("r.every or r.v > 0").select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "r.name", bucket(F.col("r.v")).alias("v"))
    sketch = each.groupBy("lang", "source", "name", "v").agg(F.count(F.lit(1)).alias("n"))
    total = sketch.groupBy("name", "v").agg(F.sum("n").alias("n")).select(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "name", "v", "n")
    both = sketch.select(F.lit(False).alias("whole"), "lang", "source", "name", "v", "n").unionByName(total)
    w = Window.partitionBy("whole", "lang", "source", "name")
    ranked = both.select("*", F.sum("n").over(w.orderBy("v")).alias("upto"), F.sum("n").over(w).alias("all_n"))
    quart = ranked.groupBy("whole", "lang", "source", "name").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("all_n"), F.col("v"))).alias("q1"), F.min(F.when(4 * F.col("upto") >= 3 * F.col("all_n"), F.col("v"))).alias("q3"), F.max("all_n").alias("n")
    )
    step = spread * F.greatest(F.col("q3") - F.col("q1"), F.lit(1))
    return quart.select("whole", "lang", "source", "name", "n", (F.col("q1") - step).alias("low"), (F.col("q3") + step).alias("high"))


def judge(measured: DataFrame, spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``.

    The measures are cut first: a few numbers a document, read twice, and no
    filter on them may pull the counting of windows into itself.
    """
    measured = common.cut(measured)
    limits = common.cut(fences(measured, spread))
    side = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    # One row per language and source: AQE broadcasts it only if its measured size allows.
    own = limits.where(~F.col("whole")).groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*[side(n, c).alias(f"{n}_{c}") for n in RATIOS for c in ("n", "low", "high")])
    whole = {r["name"]: r for r in limits.where("whole").collect()}  # a row per ratio
    joined = measured.join(own, measured.lang.cast("string").eqNullSafe(F.col("f_lang")) & measured.source.cast("string").eqNullSafe(F.col("f_source")), "left")
    fine = F.lit(True)
    for name, (*_, every) in RATIOS.items():
        if name in whole:
            n = F.coalesce(F.col(f"{name}_n"), F.lit(0))
            # A weighted mean of the group's fence and that of all documents, without division.
            weigh = lambda c: n * F.coalesce(F.col(f"{name}_{c}"), F.lit(0)) + F.lit(prior * whole[name][c])  # noqa: E731, B023
            v = ratio(name) * (n + prior)
            inside = (v >= weigh("low")) & (v <= weigh("high"))
            fine = fine & (inside if every else inside | (ratio(name) == 0))
    return joined.select(*measured.columns, base_failed().alias("base_failed"), (~base_failed() & fine).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(measure(common.documents(spark, sf_dir))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    measured = measure(docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("_hash")), extra=("_hash",))
    kept = judge(measured).where("kept").select(F.col("doc_id").alias("__doc"), F.col("_hash").alias("__hash")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__hash")), "left_semi")


def _oracle() -> str:
    ratios = [f"SELECT doc_id, lang, source, '{n}' AS name, {e} AS every, CASE WHEN {d} > 0 THEN {k} * {c} // {d} ELSE 0 END AS v FROM m WHERE NOT base_failed" for n, (c, d, k, e) in RATIOS.items()]
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t WHERE len(w) >= 4),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g WHERE g IS NOT NULL),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM h, (VALUES (0), (1), (2)) AS o(j) WHERE k > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(l.n - l.d, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id LEFT JOIN p ON t.doc_id = p.doc_id
), m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
r AS ({" UNION ALL ".join(ratios)}),
b AS (SELECT lang, source, name, CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END AS v FROM r WHERE every OR v > 0),
s AS (SELECT false AS whole, lang, source, name, v, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT true, NULL, NULL, name, v, count(*) FROM b GROUP BY name, v),
u AS (SELECT *, sum(n) OVER (PARTITION BY whole, lang, source, name ORDER BY v) AS upto, sum(n) OVER (PARTITION BY whole, lang, source, name) AS all_n FROM s),
q AS (SELECT whole, lang, source, name, max(all_n) AS n, min(v) FILTER (WHERE 4 * upto >= all_n) AS q1, min(v) FILTER (WHERE 4 * upto >= 3 * all_n) AS q3 FROM u GROUP BY whole, lang, source, name),
f AS (SELECT *, q1 - {SPREAD} * greatest(q3 - q1, 1) AS low, q3 + {SPREAD} * greatest(q3 - q1, 1) AS high FROM q),
bad AS (
  SELECT DISTINCT r.doc_id FROM r JOIN f a ON a.whole AND a.name = r.name LEFT JOIN f o ON NOT o.whole AND o.name = r.name AND o.lang IS NOT DISTINCT FROM r.lang AND o.source IS NOT DISTINCT FROM r.source
  WHERE (every OR v > 0) AND NOT v * (coalesce(o.n, 0) + {PRIOR}) BETWEEN coalesce(o.n * o.low, 0) + {PRIOR} * a.low AND coalesce(o.n * o.high, 0) + {PRIOR} * a.high
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM m LEFT JOIN bad ON m.doc_id = bad.doc_id
"""


ORACLE = _oracle()
