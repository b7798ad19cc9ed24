"""Audit of how far the sources of a language differ in their words.

Tasks count the terms of their documents per language and source and hand on
sums.  A language keeps the terms that ``MIN_DOCS`` of its documents hold; a
kept term has a share ``p`` in every source of the language, smoothed by two,
so sources without it have a share as well, their zero baseline.

The sum of ``f = (p-q)^2 / (p+q)`` over all kept terms, for each pair of sources,
is a sparse matrix times its own transpose, done row by row as Gustavson does:
entries are dealt into parts by term and into blocks by source, and a task holds
the rows of one block and the term-major index of another.  Each row's terms
pick their postings from the index and are scattered into one dense accumulator
over the block's peers; no pair of postings becomes a row.  Only terms that both
hold are met this way.  What a term adds where one of the two lacks it comes
from counts of equal shares, and what remains (the terms that neither holds)
from the number of kept terms, so each scattered value is corrected by the zero
baselines that were already added.  All sums are of whole numbers.

A source that holds a third of all words is at most one row of each part; a
language of that size is dealt into more parts and blocks.

Defined results: null text, language and source are the empty string.  A
language without a kept term has pairs of value 0 and no terms.  Rows that
repeat are documents of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Letters and all that is not ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
MIN_DOCS, TOP = 10, 10
#: Entries that a task counts before it hands them on; entries of a part; sources of a block; postings scattered at once.
FLUSH, PART, BLOCK, STRIDE = 200_000, 100_000, 256, 1_000_000


def term_rows(docs: DataFrame, flush: int = FLUSH) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, several rows an entry; an empty term marks a source."""

    def rows(counts: dict, held: dict) -> pa.RecordBatch:
        names = ["lang", "source", "term", "n", "docs"]
        cols: list[list] = [[], [], [], [], []]
        for (lang, source), terms in counts.items():
            docs_of = held[lang, source]
            for c, x in zip(cols, ([lang] * (len(terms) + 1), [source] * (len(terms) + 1), [b"", *terms], [0, *terms.values()], [0, *map(docs_of.__getitem__, terms)])):
                c += x
        text = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*text, pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=names)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = defaultdict(Counter), defaultdict(Counter)
        for f in frames:
            for lang, source, text in zip(f.column(0).to_pylist(), f.column(1).to_pylist(), f.column(2).cast(pa.binary()).to_pylist()):
                terms = TERM.findall(text.lower())  # of bytes: A-Z only
                counts[lang, source].update(terms)
                held[lang, source].update(set(terms))
            if sum(map(len, counts.values())) >= flush:
                yield rows(counts, held)
                counts, held = defaultdict(Counter), defaultdict(Counter)
        if counts:
            yield rows(counts, held)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, of: Column) -> Column:
    """``1 + floor(10^9 * n / of)`` for ``n <= of``, by three steps of long division, as the product may not fit; null if ``of`` is 0."""
    out, rest, of = F.lit(0).cast("long"), n, F.nullif(of, F.lit(0))
    for _ in range(3):
        out, rest = out * 1000 + div(rest * 1000, of), rest * 1000 % of
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), p + q)


def entries(docs: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Kept terms by language and source, and an empty term for each of them.

    ``lang, source, term, n``; ``p, q``: the term's share in the source and the
    language; ``z, held, v``: the share of a term that the source lacks, the kept
    terms that it holds and those of its language; ``block, blocks, parts``: its
    block of sources, and how many blocks and parts the language has.
    """
    each = term_rows(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    known = each.select("lang", "source", "term", "n", F.sum("docs").over(same).alias("in_docs"), F.sum("n").over(same).alias("n_lang"), (F.min("source").over(same) == F.col("source")).alias("first"))
    known = common.written(known.where((F.col("term") == "") | (F.col("in_docs") >= min_docs)).drop("in_docs"))
    term = F.col("term") != ""
    groups = known.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(term).alias("held"))
    langs = known.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_if(term & F.col("first")).alias("v"), F.count_if(term).alias("rows"), F.count_if(~term).alias("sources"))
    blocks = F.ceil(F.col("sources") / block)
    langs = langs.select("lang", "total_lang", "v", blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil(2 * F.col("rows") / (part * (blocks + 1)))).alias("parts"))
    groups = groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    of, of_lang = F.col("total") + 2 * F.col("v"), F.col("total_lang") + 2 * F.col("v")
    return known.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "held", "v", "block", "blocks", "parts",
        F.coalesce(share(F.col("n") + 2, of), F.lit(1)).alias("p"), share(F.col("n_lang") + 2, of_lang).alias("q"), F.coalesce(share(F.lit(2).cast("long"), of), F.lit(1)).alias("z"),
    )


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def accumulate(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
    """What the terms of one part add to each pair of a source of block ``low`` and one of block ``high``, both ways."""
    lang, part, low, high = key
    marks = cell[cell["term"] == ""].sort_values("source")
    cell = cell[cell["term"] != ""]
    term = pd.factorize(cell["term"])[0]
    block, source, share_of = cell["block"].to_numpy(), cell["source"].to_numpy(), cell["p"].to_numpy(np.int64)
    sides = []
    for b in (low, high):
        own = marks[marks["block"] == b]
        name = own["source"].to_numpy()
        at = np.flatnonzero(block == b)
        sides.append((name, own["z"].to_numpy(np.int64), own["held"].to_numpy(np.int64), at, np.searchsorted(name, source[at])))
    (rows, z_row, held_row, at_row, row), (peers, z_peer, held_peer, at_peer, peer) = sides
    # The index by term of block high: where each term's postings begin, their peers and shares.
    order = np.argsort(term[at_peer], kind="stable")
    begin = np.searchsorted(term[at_peer][order], np.arange(term.max(initial=-1) + 2))
    post_peer, post_p = peer[order], share_of[at_peer][order]
    # Equal shares of a peer add alike where a row lacks the term.
    same, times = np.unique(np.stack([peer, share_of[at_peer]]), axis=1, return_counts=True)
    sums = lambda where, values: np.bincount(where, weights=values, minlength=len(peers)).astype(np.int64)  # noqa: E731  exact, as all sums stay below 2^53
    v = int(marks["v"].iloc[0])
    out = np.zeros((len(rows), len(peers)), np.int64)
    for i, z in enumerate(z_row):
        mine = at_row[row == i]
        p, n = np.unique(share_of[mine], return_counts=True)
        acc = out[i]
        for k in range(0, len(p), 4096):
            acc += (apart(p[k : k + 4096, None], z_peer[None, :]) * n[k : k + 4096, None]).sum(axis=0)
        acc += sums(same[0], apart(z, same[1]) * times)
        if part == 0:
            acc += (v - held_row[i] - held_peer) * apart(z, z_peer)
        found = begin[term[mine] + 1] - begin[term[mine]]
        upto = np.cumsum(found)
        for a, b in stretches(upto):
            size = found[a:b]
            at = np.repeat(begin[term[mine[a:b]]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            j, q, p = post_peer[at], post_p[at], np.repeat(share_of[mine[a:b]], size)
            acc += sums(j, apart(p, q) - apart(p, z_peer[j]) - apart(z, q) + apart(z, z_peer[j]))
    one = pd.DataFrame({"lang": lang, "source": np.repeat(rows, len(peers)), "item": np.tile(peers, len(rows)), "value": out.ravel()})
    if low == high:
        return one[one["source"] != one["item"]]
    return pd.concat([one, one.rename(columns={"source": "item", "item": "source"})[one.columns]])


def stretches(upto: np.ndarray, most: int = STRIDE) -> Iterator[tuple[int, int]]:
    """Stretches of terms with about ``most`` postings together."""
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def pairs(known: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each other source of a language."""
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    part = F.when(F.col("term") == "", every).otherwise(F.array(F.pmod(F.xxhash64("term"), "parts")))
    cells = known.select("*", F.explode(part).alias("part")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("lang", "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "source", "block", "term", "p", "z", "held", "v")
    added = cells.groupBy("lang", "part", "low", "high").applyInPandas(accumulate, "lang string, source string, item string, value long")
    return added.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def terms(known: DataFrame) -> DataFrame:
    """``lang, source, item, value``: terms of a source that it uses more than its language does."""
    return known.where((F.col("term") != "") & (F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``lang, source, part, item, value, rank``: all other sources (`pair`) and the ``top`` terms (`term`) of each source, the most divergent first."""
    known = common.written(entries(docs, min_docs, block, part))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))).cast("int").alias("rank")
    ranked = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank)
    return ranked(pairs(known), "pair").unionByName(ranked(terms(known), "term").where(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
e AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT s.lang, s.source, coalesce(any_value(l.v), 0) AS v, coalesce(sum(e.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM t) s LEFT JOIN l ON l.lang = s.lang LEFT JOIN e ON e.lang = s.lang AND e.source = s.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(e.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(e.n, 0) + 2) // (g.n + 2 * g.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN e ON e.lang = g.lang AND e.source = g.source AND e.term = k.term),
m AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x) WHERE part = 'pair' OR rank <= {TOP}
"""
