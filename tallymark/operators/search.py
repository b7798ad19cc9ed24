"""Vectors, lexical search and fusion."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register


BLOCK, SLICE = 1024, 8192


def rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves away from zero by the shortest decimal form, as Spark's round."""
    scaled = np.abs(x) * 1e6
    out = np.sign(x) * np.floor(scaled + 0.5) / 1e6
    with np.errstate(invalid="ignore"):
        for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)):
            out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def by_length(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> which vectors have it, and their values; null vectors are left out."""
    size = np.array([-1 if x is None else len(x) for x in vectors])
    return {int(n): (at, np.array([vectors.iloc[i] for i in at], np.float64).reshape(len(at), n)) for n in np.unique(size[size >= 0]) for at in [np.flatnonzero(size == n)]}


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``x`` and ``y``, summed in the order of the dimensions."""
    out = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        out += x[:, d, None] * y[None, :, d]
    return out


def norm(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * x[:, d]
    return np.sqrt(out)


def best_of(q: pd.DataFrame, v: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best vectors of ``v`` for each row of ``q``; pairs without a cosine come last."""
    score = np.full((len(v), len(q)), -np.inf)
    left, right = by_length(v["embedding"]), by_length(q["embedding"])
    for n in left.keys() & right.keys():
        (i, x), (j, y) = left[n], right[n]
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = dots(x, y) / norm(x)[:, None] / norm(y)[None, :]
        score[np.ix_(i, j)] = np.where(np.isfinite(cos), rounded(cos), -np.inf)
    vec, query = v["vec_id"].to_numpy(np.int64), q["vec_id"].to_numpy(np.int64)
    other = vec[:, None] != query[None, :]
    score = np.where(other, score, np.nan)  # sorts last and is no pair
    least = -np.sort(-score, axis=0)[min(k, len(v)) - 1] if len(v) > k else np.full(len(q), -np.inf)
    i, j = np.nonzero(other & ~(score < least))
    order = np.lexsort((vec[i], -score[i, j], j))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.append(True, j[1:] != j[:-1])) if len(j) else np.zeros(0, int)
    nth = np.arange(len(j)) - np.repeat(first, np.diff(np.append(first, len(j))))
    i, j = i[nth < k], j[nth < k]
    found = score[i, j]
    return pd.DataFrame({"query_id": query[j], "vec_id": vec[i], "score": pd.Series(found, dtype="float64").where(np.isfinite(found))})


def ranked(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k most similar vectors (cosine) of each query.

    Blocks of queries meet slices of vectors, both of bounded size; a task keeps
    the k best of its slice for each query, and only these are ranked.
    """
    q, v = queries.select("vec_id", "embedding").where("vec_id is not null"), vectors.select("vec_id", "embedding").where("vec_id is not null")
    blocks = -(-max(q.count(), 1) // BLOCK)
    slices = max(-(-v.count() // SLICE), int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(dealt(blocks).alias("block"), every(slices).alias("slice"), "vec_id", "embedding")
    right = v.select(every(blocks).alias("block"), dealt(slices).alias("slice"), "vec_id", "embedding")
    met = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(lambda a, b: best_of(a, b, k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


QUERIES = "vec_id % 20 = 0"
COS = "s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)"
top = lambda v, k: ranked(v.embeddings.where(QUERIES), v.embeddings, k)
register("vec_topk", lambda v: top(v, 10), f"WITH {COS} SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 10")
register("semantic", lambda v: top(v, 20).where("score >= 0.2").select("query_id", "vec_id", "score"), f"WITH {COS} SELECT query_id, vec_id, score FROM k WHERE rank <= 20 AND score >= 0.2")


def token_hits(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Documents by the share of a query's words that they hold, through an inverted index."""
    word = lambda df, i, t: df.select(i, F.explode(F.array_distinct(F.filter(F.split(F.lower(t), r"[^a-z]+"), lambda w: F.length(w) > 3))).alias("word"))
    q = word(queries, "item_id", "text")
    size = q.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    hits = word(docs, "doc_id", "text").join(q, "word").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("hits")).join(size, "item_id")
    scored = hits.select("item_id", "doc_id", F.round(F.col("hits") / F.col("n"), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


WORD = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 3))"
LEX = f"q AS (SELECT item_id, unnest({WORD}) AS word FROM benchmark), d AS (SELECT doc_id, unnest({WORD}) AS word FROM documents), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY ALL), l AS (SELECT item_id, doc_id, round(count(*) / any_value(n), 9) AS score FROM d JOIN q USING (word) JOIN n USING (item_id) GROUP BY ALL), lr AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM l)"
register("lexical", lambda v: token_hits(v.benchmark, v.documents, 10), f"WITH {LEX} SELECT item_id, doc_id, score, rank FROM lr WHERE rank <= 10")


def normal_value(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))


def value_hits(queries: DataFrame, docs: DataFrame, mode: str, k: int) -> DataFrame:
    """``query_id, doc_id, rank``: the ``k`` last documents whose value is (``exact``) or begins with (``prefix``) that of a query, case and outer white space aside.

    ``queries``: ``query_id, text``; ``docs``: ``doc_id, text``.  Distinct values
    of queries are looked up once and keep ``k`` documents, however many queries
    or copies share them.  A beginning is a key of its own: a document has one
    for each length that queries have, so a prefix search is a join on equality.
    """
    asked = queries.select("query_id", normal_value(F.col("text")).alias("q"))
    values = docs.select("doc_id", normal_value(F.col("text")).alias("value"))
    if mode == "exact":
        found = values.select("doc_id", F.col("value").alias("q"))
    elif mode == "prefix":
        lengths = sorted(r[0] for r in asked.select(F.char_length("q")).distinct().collect())  # a number for each length of a query
        cuts = F.explode(F.array(*map(F.lit, lengths)) if lengths else F.expr("cast(array() as array<int>)"))
        found = values.select("doc_id", "value", cuts.alias("n")).where(F.char_length("value") >= F.col("n")).select("doc_id", F.expr("substring(value, 1, n)").alias("q"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    last = found.join(asked.select("q").distinct(), "q").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("doc_id")))).where(F.col("rank") <= k)
    return asked.join(last, "q").select("query_id", "doc_id", "rank")


TWENTIETH = "doc_id % 20 = 0"
asking = lambda v, text: v.documents.where(TWENTIETH).select(F.col("doc_id").alias("query_id"), text.alias("text"))
VALUES = r"v AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS value FROM documents)"
NTH = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS INT) AS rank"
register("lexical_exact", lambda v: value_hits(asking(v, F.col("text")), v.documents, "exact", 10), f"WITH {VALUES}, h AS (SELECT q.doc_id AS query_id, v.doc_id, {NTH.replace('doc_id DESC', 'v.doc_id DESC').replace('query_id', 'q.doc_id')} FROM v q JOIN v ON v.value = q.value WHERE q.{TWENTIETH}) SELECT * FROM h WHERE rank <= 10")
register("lexical_prefix", lambda v: value_hits(asking(v, F.expr("substring(text, 1, 4 + cast(doc_id % 3 as int))")), v.documents, "prefix", 10), rf"WITH {VALUES}, q AS (SELECT doc_id AS query_id, lower(regexp_replace(coalesce(substring(text, 1, 4 + doc_id % 3), ''), '^\s+|\s+$', '', 'g')) AS q FROM documents WHERE {TWENTIETH}), h AS (SELECT query_id, doc_id, {NTH} FROM q JOIN v ON starts_with(value, q)) SELECT * FROM h WHERE rank <= 10")


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, vec_id, rank)."""
    every = lists[0].select("query_id", "vec_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "vec_id", "rank"))
    return every.groupBy("query_id", "vec_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"))




def label_mates(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` first other vectors of each query's label: of a label, only its first ``k + 1`` can be among them."""
    first = vectors.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("r")).where(F.col("r") <= k + 1).drop("r")
    both = queries.select(F.col("vec_id").alias("query_id"), "label").join(first, "label").where("vec_id <> query_id")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id"))).where(F.col("rank") <= k)


register("hybrid", lambda v: fuse([top(v, 10), label_mates(v.embeddings.where(QUERIES), v.embeddings, 10)]), f"WITH {COS}, b AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10), u AS (SELECT query_id, vec_id, rank FROM k WHERE rank <= 10 UNION ALL SELECT query_id, vec_id, rank FROM b) SELECT query_id, vec_id, round(sum(1 / (60 + rank)), 9) AS score FROM u GROUP BY ALL")
register("multi_query", lambda v: top(v, 10).groupBy("vec_id").agg(F.max("score").alias("score")), f"WITH {COS} SELECT vec_id, max(score) AS score FROM k WHERE rank <= 10 GROUP BY vec_id")
by_query = lambda: Window.partitionBy("query_id")
register("ranking", lambda v: top(v, 10).select("query_id", "vec_id", F.round(0.7 * (F.col("score") - F.min("score").over(by_query())) / F.nullif(F.max("score").over(by_query()) - F.min("score").over(by_query()), F.lit(0.0)) + 0.3 * F.pow(F.lit(0.5), F.col("rank") / 5), 6).alias("blend")), f"WITH {COS}, t AS (SELECT * FROM k WHERE rank <= 10) SELECT query_id, vec_id, round(0.7::DOUBLE * (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) + 0.3::DOUBLE * pow(0.5, rank / 5), 6) AS blend FROM t WINDOW w AS (PARTITION BY query_id)")
register("meta_filter", lambda v: v.documents.where((F.col("lang").isin("en", "de")) & (F.col("n_chars") > 500) & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "lang", "source"), "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND n_chars > 500 AND source IN ('src1', 'src2', 'src3')")


def context_pack(blocks: DataFrame, budget: int) -> DataFrame:
    """Blocks of each query in rank order while they fit a budget; what does not fit is skipped."""
    listed = blocks.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "size"))).alias("b"))
    fold = F.aggregate("b", F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("ids")), lambda a, x: F.when(a["used"] + x["size"] <= budget, F.struct((a["used"] + x["size"]).alias("used"), F.array_append(a["ids"], x["doc_id"]).alias("ids"))).otherwise(a))
    return listed.select("item_id", fold.alias("f")).select("item_id", "f.used", F.array_join("f.ids", ",").alias("ids"))


register("context_pack", lambda v: context_pack(token_hits(v.benchmark, v.documents, 10).join(v.documents.select("doc_id", F.expr("n_chars div 4").alias("size")), "doc_id"), 2000))
