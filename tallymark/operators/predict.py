"""Predictions for an asset that a narrative is about: measured moves, analogs of the past, regime of the market and risks.

A narrative's measured move is the return from its first mention to each horizon,
by as-of joins with the candles.  Analogs give an expectation and its range.  The
state of an asset has a level (by its volatility) and a trend (by the slope of
its closes against their spread); both come from sums over the candles.

Defined results: a narrative without candles for its asset is predicted by its
analogs alone, one without either has direction ``unknown``; null confidence and
coordination count as 0, a null verdict as unconfirmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import register
from .bundles import HORIZONS
from .market import NARR, closest, narrative_rows
from .windows import RET, asof, returns, tail_risk

#: Limits of a regime (percent an hour), of a flat move, of risks; weights and bounds of a probability.
CRISIS, HIGH, LOW, FLAT, TREND = 5.0, 2.0, 0.5, 0.1, 0.5
VAR_LIMIT, DRAWDOWN_LIMIT, UNSTABLE, FEW, POOR, UNSURE, COORDINATED = -3.0, 10.0, 2, 3, 0.5, 0.4, 60
VERIFIED, PAST, LEAST, MOST = 0.6, 0.4, 0.05, 0.95


def states(candles: DataFrame) -> DataFrame:
    """``asset, volatility, regime, trend, jumps, var95, drawdown`` (percent): the state of each asset."""
    moves = returns(candles)
    hours = F.unix_timestamp(F.col("open_time").cast("timestamp")) / 3600.0
    # A trend is what the slope makes of the whole span, against the spread of the closes.
    sums = moves.groupBy("symbol").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.regr_slope("close", hours).alias("slope"), F.stddev_pop("close").alias("spread"), (F.max(hours) - F.min(hours)).alias("span"))
    jumps = moves.join(sums, "symbol").groupBy("symbol").agg(F.count_if(F.abs(F.col("r") - F.col("m")) > F.greatest(3 * F.col("s"), F.lit(0.005))).alias("jumps"))
    vol, drift = F.col("s") * 100, F.col("slope") * F.col("span") / F.when(F.col("spread") > 0, F.col("spread"))
    regime = F.when(vol > CRISIS, "crisis").when(vol > HIGH, "high_vol").when(vol < LOW, "low_vol").otherwise("normal")
    trend = F.when(drift > TREND, "rising").when(drift < -TREND, "falling").otherwise("steady")
    tail = tail_risk(candles).select("symbol", F.round(F.col("var95") * 100, 5).alias("var95"), F.round(F.col("drawdown") * -100, 5).alias("drawdown"))
    return sums.join(jumps, "symbol").join(tail, "symbol", "left").select(F.col("symbol").alias("asset"), F.round(vol, 6).alias("volatility"), regime.alias("regime"), trend.alias("trend"), "jumps", "var95", "drawdown")


def measured(narratives: DataFrame, candles: DataFrame) -> DataFrame:
    """``narrative, move``: the return (percent) at the farthest horizon that has a candle of its own; null if none has."""
    at = F.explode(F.array(*[F.lit(h) for h in (0, *HORIZONS)])).alias("hours")
    points = narratives.select("narrative", F.col("asset").alias("symbol"), "first_seen", at).select("symbol", (F.col("narrative") * 100 + F.col("hours")).alias("point_id"), (F.col("first_seen") + F.make_dt_interval(F.lit(0), F.col("hours"))).alias("at_time"))
    # A candle counts for a horizon only if it opened after the first mention.
    opened = candles.select("symbol", "open_time", F.unix_micros(F.col("open_time").cast("timestamp")).cast("double").alias("close"))
    found = asof(points, candles).join(asof(points, opened).select("point_id", F.col("price").alias("opened")), "point_id")
    rows = found.select((F.expr("point_id div 100")).alias("narrative"), (F.col("point_id") % 100).alias("hours"), "price", "opened")
    base = rows.where("hours = 0").select("narrative", F.col("price").alias("base"), F.col("opened").alias("seen"))
    later = rows.where("hours > 0").join(base, "narrative").where(F.col("opened") > F.coalesce("seen", F.lit(-1.0)))
    return later.groupBy("narrative").agg(F.round((F.max_by("price", "hours") / F.max_by("base", "hours") - 1) * 100, 6).alias("move"))


def predict(narratives: DataFrame, candles: DataFrame, impacts: DataFrame, k: int = 3) -> DataFrame:
    """A prediction for each of ``narratives`` (``narrative`` number, ``asset, category, fomo_score, entity_type, first_seen, verdict, confidence, coordination``).

    ``direction, probability, low, mean, high`` (percent), ``similarity, used`` of
    its analogs, ``regime, trend`` of its asset, ``risks`` and the first of them.
    """
    mine, top = closest(narratives, impacts, k)
    kind = ["n_category", "n_bucket", "n_type"]
    weigh = F.sum(F.col("measured_return") * F.col("score")) / F.sum("score")
    past = top.groupBy(*kind).agg(
        weigh.alias("past"), ((F.max("measured_return") - F.min("measured_return")) / 2).alias("half"), F.count(F.lit(1)).alias("used"), F.round(F.avg("score") / 10, 3).alias("similarity"),
        F.least(F.lit(0.85), F.round(0.4 + 0.15 * F.count(F.lit(1)) / 3 + 0.1 * F.avg("score") / 10, 2)).alias("past_confidence"),
    )
    known = mine.join(past, kind, "left").join(measured(narratives, candles), "narrative", "left").join(states(candles), "asset", "left")
    mean = F.coalesce("move", F.round("past", 3))
    sure, coordination, verdict = F.coalesce("confidence", F.lit(0.0)), F.coalesce("coordination", F.lit(0)), F.coalesce("verdict", F.lit("unconfirmed"))
    chance = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), sure * VERIFIED + F.coalesce("past_confidence", F.lit(0.0)) * PAST))
    risk = lambda cond, name: F.when(cond, name)
    risks = F.array_compact(F.array(
        risk(verdict.isin("confirmed_false", "likely_false", "fabricated"), "likely false"), risk(verdict == "disputed", "disputed"), risk(verdict == "unconfirmed", "unverified"),
        risk(F.col("move").isNotNull() & (F.col("jumps") > UNSTABLE), "unstable"), risk(F.col("move").isNotNull() & (F.col("var95") < VAR_LIMIT), "tail"), risk(F.col("drawdown") > DRAWDOWN_LIMIT, "drawdown"), risk(F.col("jumps") > 0, "jumps"),
        risk(F.col("used").isNull(), "no analog"), risk(F.col("used") < FEW, "small sample"), risk((F.col("used") >= FEW) & (F.col("similarity") < POOR), "poor analog"), risk(sure < UNSURE, "low confidence"), risk(coordination > COORDINATED, "coordinated"),
    ))
    out = known.withColumns({"mean": mean, "risks": F.when(F.size(risks) > 0, risks).otherwise(F.array(F.lit("market")))})
    direction = F.when(F.col("mean").isNull(), "unknown").when(F.abs("mean") < FLAT, "flat").when(F.col("mean") > 0, "up").otherwise("down")
    return out.select(
        "narrative", "asset", direction.alias("direction"), F.round(chance, 2).alias("probability"), F.round(F.col("mean") - F.col("half"), 3).alias("low"), "mean", F.round(F.col("mean") + F.col("half"), 3).alias("high"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("used", F.lit(0)).cast("long").alias("used"), F.when(F.col("move").isNotNull(), F.col("regime")).otherwise("normal").alias("regime"), F.col("trend"), F.array_join("risks", "; ").alias("risks"), F.get("risks", F.lit(0)).alias("main_risk"),
    )


#: Stand-ins: narratives about an asset of the events (or one without candles), first seen while they ran.
ABOUT = [
    "CASE doc_id % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'error' WHEN 4 THEN 'signup' ELSE 'none' END AS asset",
    "TIMESTAMP '2024-01-01 00:30:00' + {hours} AS first_seen",
    "CASE doc_id % 8 WHEN 0 THEN 'disputed' WHEN 1 THEN 'likely_true' WHEN 2 THEN 'fabricated' WHEN 3 THEN 'confirmed_true' WHEN 4 THEN 'likely_false' WHEN 5 THEN 'confirmed_false' WHEN 6 THEN 'unconfirmed' END AS verdict",
    "CAST(doc_id * 37 % 101 AS INT) AS coordination",
]
stand_ins = lambda hours: [x.format(hours=hours) for x in ABOUT]
about = lambda v: narrative_rows(v).withColumn("doc_id", F.col("narrative")).selectExpr("narrative", "category", "fomo_score", "entity_type", "confidence", *stand_ins("make_interval(0, 0, 0, 0, CAST(doc_id % 1500 AS INT))")).withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz"))
H = {h: f"(SELECT arg_max(close, open_time) FROM candle c WHERE c.symbol = b.asset AND c.open_time > b.seen AND c.open_time <= b.first_seen + INTERVAL {h} HOURS)" for h in HORIZONS}
register("predict_asset", lambda v: predict(about(v), v.candle, v.impact), f"""WITH {NARR}, {RET}, b0 AS (SELECT n.*, {', '.join(stand_ins('INTERVAL 1 HOUR * CAST(doc_id % 1500 AS INT)'))} FROM (SELECT *, narrative AS doc_id FROM n) n),
b1 AS (SELECT b0.*, c.close AS base, coalesce(c.open_time, TIMESTAMP '1900-01-01 00:00:00') AS seen FROM b0 ASOF LEFT JOIN candle c ON c.symbol = b0.asset AND b0.first_seen >= c.open_time),
mv AS (SELECT b.narrative, (coalesce({', '.join(H[h] for h in sorted(HORIZONS, reverse=True))}) / base - 1) * 100 AS move FROM b1 b),
s0 AS (SELECT n.narrative, event_id, measured_return, least(10, CASE WHEN i.category = n.category THEN 5 WHEN n.category = 'general' THEN 2 ELSE 0 END + greatest(0, 3 - abs(least(4, i.fomo_score // 20) - least(4, n.fomo_score // 20))) + CASE WHEN status IN ('confirmed_true', 'likely_true') THEN 1 ELSE 0 END + CASE WHEN asset = entity_type THEN 1 ELSE 0 END) AS score FROM n, impact i),
s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY narrative ORDER BY score DESC, event_id) <= 3), pa AS (SELECT narrative, sum(measured_return * score) / sum(score) AS past, (max(measured_return) - min(measured_return)) / 2 AS half, count(*) AS used, round(avg(score) / 10, 3) AS similarity, least(0.85::DOUBLE, round(0.4::DOUBLE + 0.15::DOUBLE * count(*) / 3 + 0.1::DOUBLE * avg(score) / 10, 2)) AS pc FROM s1 WHERE score > 0 GROUP BY narrative),
o AS (SELECT symbol, avg(r) AS m, stddev_pop(r) AS s, regr_slope(close, epoch_us(open_time) / 3.6e9) AS slope, stddev_pop(close) AS spread, (epoch_us(max(open_time)) - epoch_us(min(open_time))) / 3.6e9 AS span FROM r GROUP BY symbol),
j AS (SELECT r.symbol, count(*) FILTER (WHERE abs(r - m) > greatest(3 * s, 0.005)) AS jumps FROM r JOIN o USING (symbol) GROUP BY r.symbol), k AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE r IS NOT NULL),
ta AS (SELECT symbol, round(max(r), 7) * 100 AS var95 FROM k WHERE k <= greatest(1, floor(n * 0.05)) GROUP BY symbol), dd AS (SELECT symbol, round(min(d), 7) * -100 AS drawdown FROM (SELECT symbol, close / max(close) OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS d FROM candle) GROUP BY symbol),
st AS (SELECT o.symbol, s * 100 AS vol, slope * span / CASE WHEN spread > 0 THEN spread END AS drift, jumps, var95, drawdown FROM o JOIN j USING (symbol) LEFT JOIN ta USING (symbol) LEFT JOIN dd USING (symbol)),
a AS (SELECT *, round(move, 6) AS mv, coalesce(round(move, 6), round(past, 3)) AS mean, coalesce(verdict, 'unconfirmed') AS v, coalesce(confidence, 0) AS sure FROM b0 LEFT JOIN mv USING (narrative) LEFT JOIN pa USING (narrative) LEFT JOIN st ON st.symbol = b0.asset),
q AS (SELECT *, list_filter([CASE WHEN v IN ('confirmed_false', 'likely_false', 'fabricated') THEN 'likely false' END, CASE WHEN v = 'disputed' THEN 'disputed' END, CASE WHEN v = 'unconfirmed' THEN 'unverified' END, CASE WHEN mv IS NOT NULL AND jumps > 2 THEN 'unstable' END, CASE WHEN mv IS NOT NULL AND var95 < -3 THEN 'tail' END, CASE WHEN drawdown > 10 THEN 'drawdown' END, CASE WHEN jumps > 0 THEN 'jumps' END,
  CASE WHEN used IS NULL THEN 'no analog' END, CASE WHEN used < 3 THEN 'small sample' END, CASE WHEN used >= 3 AND similarity < 0.5 THEN 'poor analog' END, CASE WHEN sure < 0.4 THEN 'low confidence' END, CASE WHEN coordination > 60 THEN 'coordinated' END], lambda x: x IS NOT NULL) AS risks FROM a)
SELECT narrative, asset, CASE WHEN mean IS NULL THEN 'unknown' WHEN abs(mean) < 0.1 THEN 'flat' WHEN mean > 0 THEN 'up' ELSE 'down' END AS direction, round(greatest(0.05::DOUBLE, least(0.95::DOUBLE, sure * 0.6::DOUBLE + coalesce(pc, 0) * 0.4::DOUBLE)), 2) AS probability, round(mean - half, 3) AS low, mean, round(mean + half, 3) AS high,
       coalesce(similarity, 0) AS similarity, coalesce(used, 0) AS used, CASE WHEN mv IS NULL THEN 'normal' WHEN vol > 5 THEN 'crisis' WHEN vol > 2 THEN 'high_vol' WHEN vol < 0.5 THEN 'low_vol' ELSE 'normal' END AS regime, CASE WHEN vol IS NULL THEN NULL WHEN drift > 0.5 THEN 'rising' WHEN drift < -0.5 THEN 'falling' ELSE 'steady' END AS trend,
       CASE WHEN len(risks) > 0 THEN array_to_string(risks, '; ') ELSE 'market' END AS risks, CASE WHEN len(risks) > 0 THEN risks[1] ELSE 'market' END AS main_risk FROM q""")
