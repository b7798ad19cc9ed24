"""All measures of an asset around a moment, and what of a memory is worth keeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register
from .windows import RET, returns

HORIZONS = (1, 6, 24)


def impact_bundle(candles: DataFrame, moment: str, around: int = 6) -> DataFrame:
    """Per symbol: returns at the horizons (hours) after ``moment``, volatility, volume surge and a severity label.

    A return is null if no candle opened after the moment and within the horizon.
    """
    t, at = F.lit(moment).cast("timestamp_ntz"), F.col("open_time")
    close_at = lambda when: F.max_by("close", F.when(when, at))
    later = {h: F.expr(f"timestamp_ntz'{moment}' + INTERVAL '{h}' HOUR") for h in HORIZONS}
    step = candles.groupBy("symbol").agg(close_at(at <= t).alias("base"), *[close_at((at > t) & (at <= x)).alias(f"c{h}") for h, x in later.items()])
    moves = step.select("symbol", *[F.round((F.col(f"c{h}") / F.col("base") - 1) * 100, 6).alias(f"return_{h}h") for h in HORIZONS])
    volatility = returns(candles).groupBy("symbol").agg(F.round(F.stddev_pop("r") * 100, 6).alias("volatility"))
    near = lambda when, order: candles.where(when).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(order))).where(F.col("k") <= around).groupBy("symbol").agg(F.avg("volume").alias("v"))
    before, after = near(at < t, F.desc("open_time")).withColumnRenamed("v", "before"), near(at >= t, F.asc("open_time")).withColumnRenamed("v", "after")
    every = moves.join(volatility, "symbol").join(before, "symbol", "left").join(after, "symbol", "left")
    primary = F.coalesce(*[F.col(f"return_{h}h") for h in sorted(HORIZONS, reverse=True)])
    scale = F.abs("primary_return") / F.when(F.col("volatility") > 0, F.col("volatility") * 3).otherwise(1.0)
    severity = F.when(F.col("primary_return").isNull(), "unknown").when(scale >= 2.0, "severe").when(scale >= 0.8, "moderate").otherwise("mild")
    return every.withColumn("primary_return", primary).select("symbol", *[f"return_{h}h" for h in HORIZONS], "primary_return", "volatility", F.round(F.col("after") / F.col("before"), 6).alias("surge"), severity.alias("severity"))


def retention(memories: DataFrame, keys: list[str], text: str, least: float) -> DataFrame:
    """``keys`` and ``reason``: why an entry goes (expired, low_importance, duplicate), or null if it stays.

    ``memories`` has ``importance, protected, expired``.  Protected entries stay;
    of equal texts (case and spaces aside) the most important one stays, ties by
    key.  A hot text is one group of an aggregate, never a sort.
    """
    same = F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")))
    reason = F.when(F.col("protected"), F.lit(None)).when(F.col("expired"), "expired").when(F.col("importance") < least, "low_importance")
    step = memories.select(*keys, "importance", "protected", same.alias("same"), reason.alias("reason"))
    rank = F.struct(~F.col("protected"), -F.col("importance"), *keys)
    best = step.where("reason is null").groupBy("same").agg(F.min_by(F.struct(*keys), rank).alias("best"))
    both = step.join(best, "same", "left")
    duplicate = F.when(F.col("reason").isNull() & ~F.col("protected") & (F.struct(*keys) != F.col("best")), "duplicate")
    return both.select(*keys, F.coalesce("reason", duplicate).alias("reason"))


MOMENT = "2024-01-15 00:30:00"
HOUR_SQL = ", ".join(f"round((arg_max(close, open_time) FILTER (WHERE open_time > m.t AND open_time <= m.t + INTERVAL {h} HOURS) / arg_max(close, open_time) FILTER (WHERE open_time <= m.t) - 1) * 100, 6) AS return_{h}h" for h in HORIZONS)
register("impact_bundle", lambda v: impact_bundle(v.candle, MOMENT), f"""WITH {RET}, m AS (SELECT TIMESTAMP '{MOMENT}' AS t), a AS (SELECT symbol, {HOUR_SQL} FROM candle, m GROUP BY symbol), o AS (SELECT symbol, round(stddev_pop(r) * 100, 6) AS volatility FROM r GROUP BY symbol),
k AS (SELECT symbol, volume, open_time < t AS early, row_number() OVER (PARTITION BY symbol, open_time < t ORDER BY abs(epoch_us(open_time) - epoch_us(t))) AS k FROM candle, m), s AS (SELECT symbol, round(avg(volume) FILTER (WHERE NOT early) / avg(volume) FILTER (WHERE early), 6) AS surge FROM k WHERE k <= 6 GROUP BY symbol),
p AS (SELECT *, coalesce(return_24h, return_6h, return_1h) AS primary_return FROM a JOIN o USING (symbol) JOIN s USING (symbol))
SELECT symbol, return_1h, return_6h, return_24h, primary_return, volatility, surge, CASE WHEN primary_return IS NULL THEN 'unknown' WHEN abs(primary_return) / CASE WHEN volatility > 0 THEN volatility * 3 ELSE 1 END >= 2 THEN 'severe' WHEN abs(primary_return) / CASE WHEN volatility > 0 THEN volatility * 3 ELSE 1 END >= 0.8 THEN 'moderate' ELSE 'mild' END AS severity FROM p""")
register("retention_filter", lambda v: retention(v.conversations.select("conv_id", "turn", "text", (F.length("text") % 97 / 100).alias("importance"), (F.col("role") == "system").alias("protected"), (F.col("conv_id") % 7 == 0).alias("expired")), ["conv_id", "turn"], "text", 0.25), r"""WITH m AS (SELECT conv_id, turn, role = 'system' AS protected, length(text) % 97 / 100 AS importance, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS same, CASE WHEN role = 'system' THEN NULL WHEN conv_id % 7 = 0 THEN 'expired' WHEN length(text) % 97 / 100 < 0.25 THEN 'low_importance' END AS reason FROM conversations),
k AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY same, reason IS NULL ORDER BY NOT protected, importance DESC, conv_id, turn) END AS r FROM m)
SELECT conv_id, turn, CASE WHEN reason IS NULL AND NOT protected AND r > 1 THEN 'duplicate' ELSE reason END AS reason FROM k""")
