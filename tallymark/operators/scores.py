"""Nine scores of a subject from 0 to 100 with their bands, and one of them all.

A subject is a row; what a score needs is a column of it, and null counts as
nothing.  Scores come out long: a row a subject and score, so weights are a join.

Defined results: severities of null count as the score's own default; a locked
ratio and a depth are kept between 0 and 1; amounts of 10^10 and more are read in
the smallest unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register
from .rollups import SUMMARY, summary

#: Least values of the bands, points of signals, depths by name.
BANDS = [("critical", 80), ("high", 60), ("medium", 40), ("low", 20)]
PER_SEVERITY, RISK_SEVERITY, ANOMALY_SEVERITY, PER_INDICATOR = 20.0, 1.0, 0.5, 12.5
DEPTHS = {"none": 0.0, "shallow": 0.3, "adequate": 0.6, "deep": 1.0}
SMALLEST_UNIT, UNITS = 1e10, 1e18
SIGNAL = "array<struct<name: string, severity: double>>"


def clamp(c: Column, high: float = 100.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(high), c))


def band_of(c: Column) -> Column:
    out = F.lit("none")
    for name, least in reversed(BANDS):
        out = F.when(c >= least, name).otherwise(out)
    return out


def number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def signals(name: str, severity: float) -> Column:
    """Sum of severities, each kept between 0 and 100 points."""
    each = F.transform(F.coalesce(name, F.expr(f"cast(array() as {SIGNAL})")), lambda s: clamp(F.coalesce(s["severity"], F.lit(severity)) * PER_SEVERITY))
    return clamp(F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def magnitude(name: str) -> Column:
    amount = number(name)
    whole = F.when(amount >= SMALLEST_UNIT, amount / UNITS).otherwise(amount)
    return F.when(whole > 0, clamp(20.0 * F.log10(1.0 + whole))).otherwise(0.0)


def depth() -> Column:
    named = F.lower("liquidity_depth")
    by_name = F.lit(None).cast("double")
    for word, value in DEPTHS.items():
        by_name = F.when(named == word, value).otherwise(by_name)
    given = F.col("liquidity_depth").try_cast("double")
    return clamp(F.coalesce(by_name, F.when(given.isNotNull() & (given != 0), given), F.when(F.col("liquidity_depth").isNotNull() & given.isNull(), 0.0), number("depth")), 1.0)


def formulas() -> dict[str, Column]:
    n = number
    return {
        "risk": signals("risk_signals", RISK_SEVERITY),
        "anomaly": signals("anomalies", ANOMALY_SEVERITY),
        "fraud": F.least(F.lit(100.0), PER_INDICATOR * F.greatest(F.lit(0), F.size(F.coalesce("fraud_indicators", F.expr("cast(array() as array<string>)"))))),
        "influence": clamp(2 * n("followers") + 3 * n("network_reach")),
        "liquidity": clamp(60 * clamp(n("locked_ratio"), 1.0) + 40 * depth()),
        "reputation": clamp(50 + 5 * n("positive") - 10 * n("negative")),
        "smart_money": clamp(10 * n("profitable_trades") + 5 * n("track_record")),
        "trust": clamp(10 * n("age_years") + F.when(F.coalesce("verified", F.lit(False)), 30.0).otherwise(0.0)),
        "whale": clamp(0.5 * magnitude("balance") + 0.5 * magnitude("largest_transfer")),
    }


def scores(subjects: DataFrame, key: str = "address") -> DataFrame:
    """``key, name, value, band`` of all nine scores."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.round(v, 6).alias("value")) for k, v in formulas().items()]))
    return subjects.select(key, each.alias("s")).select(key, "s.*").withColumn("band", band_of(F.col("value")))


def final_score(long: DataFrame, weights: DataFrame | None = None, key: str = "address") -> DataFrame:
    """``key, value, confidence, band``: the weighted mean of scores (``name, value`` and maybe ``confidence``), as sure as the least sure; weights (``name, weight``) that are missing are 1."""
    rows = long if "confidence" in long.columns else long.withColumn("confidence", F.lit(1.0))
    rows = rows.withColumn("weight", F.lit(1.0)) if weights is None else rows.join(weights, "name", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    total = F.sum("weight")
    mean = F.sum(F.col("value") * F.col("weight")) / F.when(total == 0, 1.0).otherwise(total)
    out = rows.groupBy(key).agg(F.round(clamp(mean), 5).alias("value"), F.min("confidence").alias("confidence"))
    return out.withColumn("band", band_of(F.col("value")))


#: Stand-ins for what is known of an address, from its transfers; {0} is the number of its name.
SUBJECT = """address, sent, received, counterparties, {0} AS k, CASE WHEN {0} % 4 > 0 THEN counterparties END AS followers, {0} % 12 AS network_reach, sent / (sent + received) + {0} % 3 * 0.25 AS locked_ratio,
CASE {0} % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'Shallow' WHEN 2 THEN 'adequate' WHEN 3 THEN 'DEEP' WHEN 4 THEN '0.4' WHEN 5 THEN 'unknown' END AS liquidity_depth, ({0} % 5) * 0.3 AS depth, {0} % 13 AS positive, {0} % 8 AS negative, {0} % 11 AS profitable_trades, {0} % 5 AS track_record,
({0} % 9) * 0.75 AS age_years, CASE WHEN {0} % 3 > 0 THEN {0} % 3 = 1 END AS verified, sent_total AS balance, CASE WHEN {0} % 2 = 0 THEN received_total / 1e6 ELSE received_total * 1e12 END AS largest_transfer"""
NUMBER = "CAST(substring(address, 2, 20) AS BIGINT)"


def subjects(v) -> DataFrame:
    known = v.spark.sql(f"SELECT {SUBJECT.format(NUMBER)} FROM {{a}}", a=summary(v))
    some = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("name"), severity.cast("double").alias("severity")))
    k = F.col("k")
    risk = F.array_compact(F.array(some(k % 5 == 0, "mixer", k % 7), some(k % 3 == 0, "list", F.lit(None)), some(k % 2 == 0, "exploit", F.lit(1.5))))
    odd = F.array_compact(F.array(some(k % 4 == 0, "burst", F.lit(None)), some(k % 6 == 0, "gap", k % 10)))
    marks = F.array_compact(F.array(*[F.when(k % i == 0, F.lit(f"mark{i}")) for i in range(2, 12)]))
    return known.withColumns({"risk_signals": F.when(k % 11 > 0, risk), "anomalies": odd, "fraud_indicators": F.when(k % 13 > 0, marks)})


def _sql() -> str:
    cl = lambda x, high=100: f"greatest(0.0::DOUBLE, least({high}::DOUBLE, {x}))"
    log = lambda c: f"CASE WHEN coalesce({c}, 0) > 0 THEN {cl(f'20 * log10(1 + CASE WHEN {c} >= 1e10 THEN {c} / 1e18 ELSE {c} END)')} ELSE 0 END"
    marks = " + ".join(f"CASE WHEN k % {i} = 0 THEN 1 ELSE 0 END" for i in range(2, 12))
    depth = "CASE lower(liquidity_depth) WHEN 'none' THEN 0 WHEN 'shallow' THEN 0.3 WHEN 'adequate' THEN 0.6 WHEN 'deep' THEN 1 WHEN '0.4' THEN 0.4 WHEN 'unknown' THEN 0 ELSE depth END"
    values = {
        "risk": f"CASE WHEN k % 11 > 0 THEN {cl('CASE WHEN k % 5 = 0 THEN ' + cl('k % 7 * 20') + ' ELSE 0 END + CASE WHEN k % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 30 ELSE 0 END')} ELSE 0 END",
        "anomaly": cl("CASE WHEN k % 4 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 6 = 0 THEN " + cl("k % 10 * 20") + " ELSE 0 END"),
        "fraud": f"CASE WHEN k % 13 > 0 THEN least(100, 12.5 * ({marks})) ELSE 0 END",
        "influence": cl("2 * coalesce(followers, 0) + 3 * network_reach"), "liquidity": cl(f"60 * {cl('locked_ratio::DOUBLE', 1)} + 40 * {cl(f'({depth})::DOUBLE', 1)}"), "reputation": cl("50 + 5 * positive - 10 * negative"),
        "smart_money": cl("10 * profitable_trades + 5 * track_record"), "trust": cl("10 * age_years + CASE WHEN verified THEN 30 ELSE 0 END"), "whale": cl(f"0.5::DOUBLE * {log('balance::DOUBLE')} + 0.5::DOUBLE * {log('largest_transfer::DOUBLE')}"),
    }
    return f"{SUMMARY}, su AS (SELECT {SUBJECT.format(NUMBER)} FROM a), sc AS (" + " UNION ALL ".join(f"SELECT address, '{n}' AS name, round(({x})::DOUBLE, 6) AS value FROM su" for n, x in values.items()) + ")"


SCORES = _sql()
BAND = "CASE WHEN value >= 80 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 40 THEN 'medium' WHEN value >= 20 THEN 'low' ELSE 'none' END AS band"
WEIGHTS = {"risk": 3.0, "fraud": 2.0, "trust": 0.5}
register("scores", lambda v: scores(subjects(v)), f"WITH {SCORES} SELECT *, {BAND} FROM sc")
register("final_score", lambda v: final_score(scores(subjects(v)), v.spark.createDataFrame(list(WEIGHTS.items()), "name string, weight double")), f"WITH {SCORES}, f AS (SELECT address, round(sum(value * w) / sum(w), 5) AS value, 1.0::DOUBLE AS confidence FROM (SELECT *, CASE name WHEN 'risk' THEN 3.0::DOUBLE WHEN 'fraud' THEN 2.0::DOUBLE WHEN 'trust' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sc) GROUP BY address) SELECT *, {BAND} FROM f")
