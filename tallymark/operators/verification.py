"""Verdicts on narratives from what their sources say, and confidence calibrated on labelled history.

Copies of a text are one source, with the best credibility of its carriers.
Counts by credibility and stance give one of seven verdicts by ordered rules; a
denial and a support whose weights differ much turn it into a dispute, for which
only the extremes of either side count, so no pairs are made.

History is counted into buckets of the score.  From these sums, a thousand at
most for a verdict, pool-adjacent-violators fits a rising step function and
Newton's method a logistic curve.

Defined results: a narrative without items has no row; null stances are neutral,
null tiers the least credible; ties go to the least item; a verdict with fewer
than ``LEAST_HISTORY`` cases in history keeps the damped confidence.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register
from .ledger import count_if
from .news import FP, fingerprint

#: Tiers of credibility, words of hearsay and of fabrication, and the confidence of each rule.
OFFICIAL, CREDIBLE, AGGREGATOR, SOCIAL, UNKNOWN = 1, 3, 4, 5, 6
HEARSAY = "sources say|reportedly|allegedly|insider says"
FABRICATED = r"\b(satire|satirical|parody|hoax|fabricated|deepfake|made up|not real|onion headline|babylon bee)\b"
COORDINATED, AMPLIFIED, DECISIVE = 60, 3, 2
TRUE, FALSE, UNSURE = ["confirmed_true", "likely_true"], ["confirmed_false", "likely_false"], ["unconfirmed", "disputed"]
#: Buckets of a score, and cases that a fit needs.
BUCKETS, LEAST_HISTORY = 1000, 10


def evidence(items: DataFrame) -> DataFrame:
    """Counts of each narrative over its sources: ``items`` (``narrative, item, tier, stance, title, content``) with equal content are one."""
    t = F.coalesce("tier", F.lit(UNKNOWN))
    key = F.coalesce(fingerprint(F.col("content")), F.concat(F.lit("title:"), fingerprint(F.coalesce("title", F.lit("")))))
    text = F.lower(F.concat_ws(" ", F.substring("content", 1, 200), "title"))
    marked = F.coalesce(F.concat_ws(" ", "title", "content").rlike(f"(?i){FABRICATED}"), F.lit(False))
    rows = items.select("narrative", "item", t.alias("tier"), F.coalesce("stance", F.lit("neutral")).alias("stance"), key.alias("key"), text.rlike(HEARSAY).alias("hearsay"), marked.alias("marked"))
    sources = rows.groupBy("narrative", "key").agg(F.min_by(F.struct("tier", "stance", "hearsay"), F.struct("tier", "item")).alias("s"), F.count(F.lit(1)).alias("copies"), F.bool_or("marked").alias("marked")).select("narrative", "copies", "marked", "s.*")
    said = lambda *stances: F.col("stance").isin(*stances)
    official, credible = F.col("tier") == OFFICIAL, F.col("tier") <= CREDIBLE
    weight = lambda f, stance: f(F.when(said(stance), 7 - F.col("tier")))
    return sources.groupBy("narrative").agg(
        F.sum("copies").alias("items"), F.count(F.lit(1)).alias("sources"), count_if(official).alias("official"), count_if(credible).alias("credible"),
        count_if(official & said("deny")).alias("official_deny"), count_if(official & said("support", "neutral")).alias("official_confirm"), count_if(credible & said("support", "neutral")).alias("asserted"),
        count_if(credible & said("question") & F.col("hearsay")).alias("hearsay"), count_if(said("deny")).alias("denies"), count_if(said("support")).alias("supports"), count_if(said("question")).alias("questions"),
        F.bool_and(F.col("tier") >= SOCIAL).alias("social_only"), F.bool_and(F.col("tier") >= AGGREGATOR).alias("none_credible"), F.bool_or("marked").alias("marked"),
        weight(F.max, "deny").alias("deny_most"), weight(F.min, "deny").alias("deny_least"), weight(F.max, "support").alias("support_most"), weight(F.min, "support").alias("support_least"),
    )


def rules(coordination: Column) -> list[tuple[Column, str, Column | float]]:
    """Condition, verdict and confidence, the first that holds counts."""
    c = F.col
    return [
        (c("marked"), "fabricated", F.when(coordination > 0, 0.85).otherwise(0.7)),
        (c("official_deny") >= 1, "confirmed_false", 0.85),
        (c("denies") >= 2, "confirmed_false", F.when(c("credible") == 0, 0.7).otherwise(0.85)),
        ((c("denies") == 1) & (c("supports") == 0) & (c("asserted") == 0), "likely_false", 0.7),
        (c("denies") >= 1, "disputed", 0.5),
        (c("official_confirm") >= 2, "confirmed_true", 0.92),
        (c("official_confirm") == 1, "confirmed_true", 0.85),
        (c("none_credible") & (coordination >= COORDINATED) & (c("items") >= AMPLIFIED), "likely_false", 0.65),
        (c("asserted") >= 2, "likely_true", 0.75),
        ((c("asserted") == 1) | (c("hearsay") >= 1), "likely_true", 0.65),
        ((c("questions") >= 1) & (c("supports") == 0), "unconfirmed", 0.35),
        ((c("supports") >= 2) & (c("sources") >= 2), "unconfirmed", 0.35),
    ]


def damped(score: Column, verdict: Column) -> Column:
    """Unsure verdicts lose confidence, the others keep it."""
    return F.when(~verdict.isin(*UNSURE), score).when(score <= 0.5, score * 0.7).otherwise(0.35 + (score - 0.5) * 0.5)


def verify(items: DataFrame, coordination: DataFrame | None = None) -> DataFrame:
    """``evidence`` with ``verdict``, ``raw`` and ``confidence``. ``coordination``: ``narrative, coordination`` from 0 to 100."""
    found = evidence(items)
    found = found.withColumn("coordination", F.lit(0)) if coordination is None else found.join(coordination, "narrative", "left").withColumn("coordination", F.coalesce("coordination", F.lit(0)))
    verdict, raw = F.lit("unconfirmed"), F.lit(0.3)
    for when, name, value in reversed(rules(F.col("coordination"))):
        verdict, raw = F.when(when, name).otherwise(verdict), F.when(when, value).otherwise(raw)
    judged = found.withColumns({"verdict": verdict, "raw": raw})
    outweighed = F.col("support_least") - F.col("deny_most") < -DECISIVE  # by some pair of a denial and a support
    upheld = F.col("support_most") - F.col("deny_least") > DECISIVE
    turned = F.coalesce((F.col("verdict").isin(*TRUE) & outweighed) | (F.col("verdict").isin(*FALSE) & upheld), F.lit(False))
    judged = judged.withColumns({"raw": F.when(turned, F.col("raw") * 0.5).otherwise(F.col("raw")), "verdict": F.when(turned, "disputed").otherwise(F.col("verdict"))})
    return judged.withColumn("confidence", F.round(damped(F.col("raw"), F.col("verdict")), 6)).withColumn("raw", F.round("raw", 6)).drop("marked", "none_credible", "deny_most", "deny_least", "support_most", "support_least")


def bucket(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * BUCKETS).cast("int")


def buckets(history: DataFrame) -> DataFrame:
    """``verdict, bucket, n, hits`` of ``history`` (``verdict, score, held``): at most a row for each bucket; nulls are left out."""
    return history.where("score is not null and held is not null").groupBy("verdict", bucket(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("held")).alias("hits"))


def pooled(n: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The rising fit of ``hits / n``: neighbours that fall are pooled until none does."""
    blocks: list[list[int]] = []  # hits, cases, buckets
    for h, m in zip(hits.tolist(), n.tolist()):
        blocks.append([h, m, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, m2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + m2, blocks[-1][2] + k2]
    return np.repeat([h / m for h, m, _ in blocks], [k for *_, k in blocks]) if blocks else np.empty(0)


def logistic(x: np.ndarray, n: np.ndarray, hits: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """``a, b`` of ``1 / (1 + exp(a * x + b))``, by Newton's method with halved steps, over targets drawn in by one case of either kind."""
    good, bad = float(hits.sum()), float((n - hits).sum())
    high, low = (good + 1) / (good + 2), 1 / (bad + 2)
    target = hits * high + (n - hits) * low

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float(((target * z) + n * np.logaddexp(0, -z)).sum())

    a, b = 0.0, math.log((bad + 1) / (good + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(a * x + b))
        d, w = target - n * p, n * p * (1 - p)
        g = np.array([(d * x).sum(), d.sum()])
        h = np.array([[(w * x * x).sum() + 1e-12, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-12]])
        if np.abs(g).max() < 1e-9:
            break
        da, db = np.linalg.solve(h, -g)
        size, now = 1.0, loss(a, b)
        while size > 1e-10 and loss(a + size * da, b + size * db) > now:
            size /= 2
        if size <= 1e-10:
            break
        a, b = a + size * da, b + size * db
    return a, b


def isotonic(history: DataFrame) -> DataFrame:
    """``verdict, bucket, n, value``: the rising fit at each bucket that history holds; a verdict's buckets are one group, of a thousand at most."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        return rows.assign(value=pooled(rows["n"].to_numpy(), rows["hits"].to_numpy()))[["verdict", "bucket", "n", "value"]]

    return buckets(history).groupBy("verdict").applyInPandas(fit, "verdict string, bucket int, n long, value double")


def platt(history: DataFrame) -> DataFrame:
    """``verdict, n, a, b``: the logistic curve of each verdict."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = logistic(rows["bucket"].to_numpy() / BUCKETS, rows["n"].to_numpy(), rows["hits"].to_numpy())
        return pd.DataFrame({"verdict": rows["verdict"].iloc[:1], "n": [int(rows["n"].sum())], "a": [a], "b": [b]})

    return buckets(history).groupBy("verdict").applyInPandas(fit, "verdict string, n long, a double, b double")


def calibrate(judged: DataFrame, history: DataFrame, how: str = "isotonic") -> DataFrame:
    """``judged`` (of ``verify``) with ``confidence`` as history bears it out: the fit at the nearest bucket not above, or the logistic curve."""
    if how == "platt":
        known = platt(history).where(F.col("n") >= LEAST_HISTORY).select("verdict", "a", "b")
        fitted = 1 / (1 + F.exp(F.col("a") * F.col("raw") + F.col("b")))
        return judged.join(known, "verdict", "left").withColumn("confidence", F.round(F.coalesce(fitted, "confidence"), 6)).drop("a", "b")
    steps = isotonic(history).groupBy("verdict").agg(F.sum("n").alias("cases"), F.array_sort(F.collect_list(F.struct("bucket", "value"))).alias("steps")).where(F.col("cases") >= LEAST_HISTORY).select("verdict", "steps")
    at = bucket(F.col("raw"))
    below = F.filter("steps", lambda s: s["bucket"] <= F.col("at"))
    value = F.coalesce(F.get(below, F.size(below) - 1)["value"], F.get("steps", F.lit(0))["value"])
    return judged.join(steps, "verdict", "left").withColumn("at", at).withColumn("confidence", F.round(F.coalesce(value, "confidence"), 6)).drop("steps", "at")


#: Stand-ins: five items in a row are a narrative; tiers, stances and words by number, so that every rule holds somewhere.
TOLD = """SELECT doc_id DIV 5 AS narrative, doc_id AS item, CAST(1 + (doc_id * 7 + doc_id DIV 35) % 6 AS INT) AS tier,
CASE WHEN doc_id % 23 < 2 THEN 'deny' WHEN doc_id % 11 < 4 THEN 'support' WHEN doc_id % 4 = 1 THEN 'question' WHEN doc_id % 29 > 0 THEN 'neutral' END AS stance,
concat(title, CASE WHEN doc_id % 6 = 1 THEN ' reportedly' ELSE '' END, CASE WHEN doc_id % 97 = 5 THEN ' a Hoax' ELSE '' END) AS title, content FROM news"""
COORD = "SELECT DISTINCT doc_id DIV 5 AS narrative, CAST((doc_id DIV 5) * 37 % 101 AS INT) AS coordination FROM news"
told = lambda v, sql: v.spark.sql(sql.replace("FROM news", "FROM {news}"), news=v.news)
duck = lambda sql: sql.replace("doc_id DIV", "doc_id //")


def _rules_sql() -> str:
    head = f"""WITH i AS ({duck(TOLD)}), co AS ({duck(COORD)}),
k AS (SELECT narrative, item, coalesce(tier, 6) AS tier, coalesce(stance, 'neutral') AS stance, coalesce({FP.format('content')}, 'title:' || {FP.format("coalesce(title, '')")}) AS key, regexp_matches(lower(concat_ws(' ', substring(content, 1, 200), title)), '{HEARSAY}') AS hearsay, regexp_matches(concat_ws(' ', title, content), '(?i){FABRICATED}') AS marked FROM i),
s AS (SELECT narrative, key, count(*) AS copies, bool_or(marked) AS marked, min(tier) AS tier, first(stance ORDER BY tier, item) AS stance, first(hearsay ORDER BY tier, item) AS hearsay FROM k GROUP BY narrative, key),
e AS (SELECT narrative, sum(copies)::BIGINT AS items, count(*) AS sources, count(*) FILTER (WHERE tier = 1) AS official, count(*) FILTER (WHERE tier <= 3) AS credible, count(*) FILTER (WHERE tier = 1 AND stance = 'deny') AS official_deny, count(*) FILTER (WHERE tier = 1 AND stance IN ('support', 'neutral')) AS official_confirm,
  count(*) FILTER (WHERE tier <= 3 AND stance IN ('support', 'neutral')) AS asserted, count(*) FILTER (WHERE tier <= 3 AND stance = 'question' AND hearsay) AS hearsay, count(*) FILTER (WHERE stance = 'deny') AS denies, count(*) FILTER (WHERE stance = 'support') AS supports, count(*) FILTER (WHERE stance = 'question') AS questions, bool_and(tier >= 5) AS social_only, bool_and(tier >= 4) AS none_credible, bool_or(marked) AS marked FROM s GROUP BY narrative),
x AS (SELECT d.narrative, min(d.tier - u.tier) AS worst, max(d.tier - u.tier) AS best FROM s d JOIN s u ON u.narrative = d.narrative AND d.stance = 'deny' AND u.stance = 'support' GROUP BY d.narrative)"""
    cases = """WHEN marked THEN ['fabricated', CASE WHEN coordination > 0 THEN '0.85' ELSE '0.7' END] WHEN official_deny > 0 THEN ['confirmed_false', '0.85'] WHEN denies > 1 THEN ['confirmed_false', CASE WHEN credible = 0 THEN '0.7' ELSE '0.85' END]
WHEN denies = 1 AND supports = 0 AND asserted = 0 THEN ['likely_false', '0.7'] WHEN denies = 1 THEN ['disputed', '0.5'] WHEN official_confirm > 1 THEN ['confirmed_true', '0.92'] WHEN official_confirm = 1 THEN ['confirmed_true', '0.85'] WHEN none_credible AND coordination >= 60 AND items >= 3 THEN ['likely_false', '0.65']
WHEN asserted > 1 THEN ['likely_true', '0.75'] WHEN asserted = 1 OR hearsay > 0 THEN ['likely_true', '0.65'] WHEN questions > 0 AND supports = 0 THEN ['unconfirmed', '0.35'] WHEN supports > 1 AND sources > 1 THEN ['unconfirmed', '0.35'] ELSE ['unconfirmed', '0.3']"""
    return f"""{head}, j AS (SELECT *, CASE {cases} END AS r FROM e JOIN co USING (narrative) LEFT JOIN x USING (narrative)),
t AS (SELECT *, (coalesce(worst, 0) < -2 AND r[1] LIKE '%_true') OR (coalesce(best, 0) > 2 AND r[1] LIKE '%_false') AS turned FROM j),
u AS (SELECT *, CASE WHEN turned THEN 'disputed' ELSE r[1] END AS verdict, r[2]::DOUBLE * CASE WHEN turned THEN 0.5::DOUBLE ELSE 1 END AS raw FROM t)
SELECT narrative, items, sources, official, credible, official_deny, official_confirm, asserted, hearsay, denies, supports, questions, social_only, coordination, verdict, round(raw, 6) AS raw, round(CASE WHEN verdict NOT IN ('unconfirmed', 'disputed') THEN raw WHEN raw <= 0.5 THEN raw * 0.7::DOUBLE ELSE 0.35::DOUBLE + (raw - 0.5::DOUBLE) * 0.5::DOUBLE END, 6) AS confidence FROM u"""


history = lambda v: v.evalcase.select(F.col("detector").alias("verdict"), F.col("confidence").alias("score"), F.col("label").alias("held"))
register("verify", lambda v: verify(told(v, TOLD), told(v, COORD)), _rules_sql())
# The rising fit has a closed form: the greatest, over all starts, of the least mean up to any end.
register("verify_isotonic", lambda v: isotonic(history(v)).withColumn("value", F.round("value", 9)), f"""WITH b AS (SELECT detector AS verdict, round(confidence * {BUCKETS})::INT AS bucket, count(*) AS n, count(*) FILTER (WHERE label) AS hits FROM evalcase WHERE confidence IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS nn, sum(hits) OVER w AS hh FROM b WINDOW w AS (PARTITION BY verdict ORDER BY bucket)), m AS (SELECT i.verdict, i.bucket, i.n, s.bucket AS start, min((e.hh - s.hh + s.hits) / (e.nn - s.nn + s.n)) AS low FROM c i JOIN c s ON s.verdict = i.verdict AND s.bucket <= i.bucket JOIN c e ON e.verdict = i.verdict AND e.bucket >= i.bucket GROUP BY ALL)
SELECT verdict, bucket, n, round(max(low), 9) AS value FROM m GROUP BY verdict, bucket, n""")
register("verify_platt", lambda v: platt(history(v)))
