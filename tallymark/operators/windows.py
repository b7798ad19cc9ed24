"""Analytic windows: outflow baselines, intervals, timelines, price measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register
from .order import medians
from .ledger import CANON, canonical, count_if


def outflow_windows(flows: DataFrame, n: int, reserve: int) -> DataFrame:
    """Contiguous windows of ``n`` blocks with their flows, and the reserve before each."""
    w = Window.partitionBy("chain", "address").orderBy("height")
    ahead = w.rowsBetween(0, n - 1)
    out = flows.select(
        "chain", "address", "height", F.sum("inflow").over(ahead).cast("decimal(38,0)").alias("win_in"), F.sum("outflow").over(ahead).cast("decimal(38,0)").alias("win_out"),
        (F.lit(reserve).cast("decimal(38,0)") + F.coalesce(F.sum(F.col("inflow") - F.col("outflow")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("decimal(38,0)").alias("reserve_before"),
        F.min("complete").over(ahead).alias("complete"), (F.lead("height", n - 1).over(w) - F.col("height") == n - 1).alias("whole"),
    )
    return out.where("whole").drop("whole").withColumn("fraction", F.when(F.col("reserve_before") > 0, F.round(F.col("win_out").cast("double") / F.col("reserve_before").cast("double"), 9)))


WIN = """ow AS (SELECT chain, address, height, (sum(inflow) OVER a)::BIGINT AS win_in, (sum(outflow) OVER a)::BIGINT AS win_out, (10000000 + coalesce(sum(inflow - outflow) OVER (PARTITION BY chain, address ORDER BY height ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS reserve_before, bool_and(complete) OVER a AS complete, lead(height, 2) OVER w - height = 2 AS whole
FROM flow WINDOW w AS (PARTITION BY chain, address ORDER BY height), a AS (PARTITION BY chain, address ORDER BY height ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
o AS (SELECT * EXCLUDE (whole), CASE WHEN reserve_before > 0 THEN round(win_out::DOUBLE / reserve_before::DOUBLE, 9) END AS fraction FROM ow WHERE whole)"""
register("outflow_windows", lambda v: outflow_windows(v.flow, 3, 10_000_000), f"WITH {WIN} SELECT * FROM o")


def baseline(windows: DataFrame) -> DataFrame:
    """Median, MAD, mean absolute deviation, mean and population deviation of known fractions."""
    known = windows.where("complete and fraction is not null")
    middle = known.groupBy("address").agg(F.median("fraction").alias("median"))
    return known.join(middle, "address").groupBy("address").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("median"), 9).alias("median"), F.round(F.median(F.abs(F.col("fraction") - F.col("median"))), 9).alias("mad"), F.round(F.avg(F.abs(F.col("fraction") - F.col("median"))), 8).alias("mean_dev"), F.round(F.avg("fraction"), 8).alias("mean"), F.round(F.stddev_pop("fraction"), 7).alias("stdev"))


BASE = f"{WIN}, m AS (SELECT address, median(fraction) AS med FROM o WHERE complete AND fraction IS NOT NULL GROUP BY address), bl AS (SELECT address, count(*) AS n, round(any_value(med), 9) AS median, round(median(abs(fraction - med)), 9) AS mad, round(avg(abs(fraction - med)), 8) AS mean_dev, round(avg(fraction), 8) AS mean, round(stddev_pop(fraction), 7) AS stdev FROM o JOIN m USING (address) WHERE complete AND fraction IS NOT NULL GROUP BY address)"
base_of = lambda v: baseline(outflow_windows(v.flow, 3, 10_000_000))
register("baseline", base_of, f"WITH {BASE} SELECT * FROM bl")


def measure_outflow(windows: DataFrame, base: DataFrame, least: int = 30, share: float = 0.30, z: float = 6.0) -> DataFrame:
    """Grade each window: robust z against the baseline (spread: MAD, else mean deviation, else 1e-6)."""
    spread = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).when(F.col("mean_dev") > 0, F.col("mean_dev") * 1.2533).otherwise(F.lit(1e-6))
    score = F.least(F.greatest((F.col("fraction") - F.col("median")) / spread, F.lit(-1000.0)), F.lit(1000.0))
    joined = windows.join(base, "address", "left")
    grade = F.when(F.col("fraction").isNull() | ~F.col("complete") | F.coalesce(F.col("n") < least, F.lit(True)), "undetermined").when((F.col("fraction") >= share) & (score >= z), "anomalous").otherwise("normal")
    return joined.select("address", "height", F.round(score, 5).alias("z"), grade.alias("grade"))


register(
    "det_outflow",
    lambda v: measure_outflow(outflow_windows(v.flow, 3, 10_000_000), base_of(v), 5, 0.0005, 2.0),
    f"WITH {BASE}, j AS (SELECT o.address, height, fraction, complete, n, least(greatest((fraction - median) / CASE WHEN mad > 0 THEN mad * 1.4826 WHEN mean_dev > 0 THEN mean_dev * 1.2533 ELSE 1e-6 END, -1000.0), 1000.0) AS z0 FROM o LEFT JOIN bl USING (address)) SELECT address, height, round(z0, 5) AS z, CASE WHEN fraction IS NULL OR NOT complete OR coalesce(n < 5, TRUE) THEN 'undetermined' WHEN fraction >= 0.0005 AND z0 >= 2.0 THEN 'anomalous' ELSE 'normal' END AS grade FROM j",
)


def interval_cv(transfers: DataFrame) -> DataFrame:
    """Regularity of a sender's outflows: variation of its height gaps and of its values, largest recipient share."""
    w = Window.partitionBy("from_address").orderBy("block_number", "tx_key")
    gaps = transfers.select("from_address", "value", (F.col("block_number") - F.lag("block_number").over(w)).alias("gap"))
    out = gaps.groupBy("from_address").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0)), 7).alias("gap_cv"), F.round(F.stddev_pop(F.col("value").cast("double")) / F.avg(F.col("value").cast("double")), 7).alias("value_cv"))
    to = transfers.where("to_address is not null").groupBy("from_address", "to_address").agg(F.count(F.lit(1)).alias("k")).groupBy("from_address").agg(F.round(F.max("k") / F.sum("k"), 9).alias("top_share"))
    return out.join(to, "from_address", "left")


register(
    "interval_cv",
    lambda v: interval_cv(canonical(v.txn, v.blk)),
    f"WITH {CANON}, g AS (SELECT from_address, value::DOUBLE AS value, block_number - lag(block_number) OVER (PARTITION BY from_address ORDER BY block_number, tx_key) AS gap FROM c), a AS (SELECT from_address, count(*) AS n, round(stddev_pop(gap) / nullif(avg(gap), 0), 7) AS gap_cv, round(stddev_pop(value) / avg(value), 7) AS value_cv FROM g GROUP BY ALL), t AS (SELECT from_address, round(max(k) / sum(k), 9) AS top_share FROM (SELECT from_address, to_address, count(*) AS k FROM c WHERE to_address IS NOT NULL GROUP BY ALL) GROUP BY ALL) SELECT a.*, top_share FROM a LEFT JOIN t USING (from_address)",
)
register(
    "deploy_interval",
    lambda v: canonical(v.txn, v.blk).withColumn("new", F.col("to_address").isNull()).withColumn("gap", F.when(F.col("new"), F.col("block_number") - F.lag(F.when(F.col("new"), F.col("block_number")), 1).over(Window.partitionBy("from_address", "new").orderBy("block_number", "tx_key")))).groupBy("from_address").agg(count_if(F.col("new")).alias("creations"), F.round(F.avg(F.col("new").cast("int")), 9).alias("ratio"), F.round(F.avg("gap"), 7).alias("mean_gap"), F.min(F.when(F.col("new"), F.col("block_number"))).alias("first_at"), F.max(F.when(F.col("new"), F.col("block_number"))).alias("last_at")),
    f"WITH {CANON}, g AS (SELECT *, to_address IS NULL AS new, CASE WHEN to_address IS NULL THEN block_number - lag(block_number) OVER (PARTITION BY from_address, to_address IS NULL ORDER BY block_number, tx_key) END AS gap FROM c) SELECT from_address, count(*) FILTER (WHERE new) AS creations, round(avg(new::INT), 9) AS ratio, round(avg(gap), 7) AS mean_gap, min(block_number) FILTER (WHERE new) AS first_at, max(block_number) FILTER (WHERE new) AS last_at FROM g GROUP BY from_address",
)


def first_mover(transfers: DataFrame) -> DataFrame:
    """Share of an actor's counterparties that it touched at or before the upper median of the others."""
    touch = transfers.where("to_address is not null").groupBy(F.col("to_address").alias("party"), F.col("from_address").alias("actor")).agg(F.min("block_number").alias("first"))
    w = Window.partitionBy("party")
    placed = touch.select("*", F.row_number().over(w.orderBy("first", "actor")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    # The others are the actors of the party without this one: element k // 2 of them, sorted.
    want = F.expr("(n - 1) div 2") + 1
    at = placed.select("*", F.when(want < F.col("r"), want).otherwise(want + 1).alias("at")).where("n > 1")
    median = placed.select("party", F.col("r").alias("at"), F.col("first").alias("median"))
    return at.join(median, ["party", "at"]).groupBy("actor").agg(F.count(F.lit(1)).alias("parties"), F.round(F.avg((F.col("first") <= F.col("median")).cast("int")), 9).alias("score"))


register(
    "first_mover",
    lambda v: first_mover(canonical(v.txn, v.blk)),
    f"WITH {CANON}, t AS (SELECT to_address AS party, from_address AS actor, min(block_number) AS f FROM c WHERE to_address IS NOT NULL GROUP BY ALL), l AS (SELECT party, list(struct_pack(f := f, a := actor) ORDER BY f, actor) AS xs FROM t GROUP BY party HAVING count(*) > 1), o AS (SELECT t.actor, t.f, list_filter(xs, lambda x: x.a <> t.actor) AS ys FROM t JOIN l USING (party)) SELECT actor, count(*) AS parties, round(avg((f <= ys[len(ys) // 2 + 1].f)::INT), 9) AS score FROM o GROUP BY actor",
)
register("size_cv", lambda v: canonical(v.txn, v.blk).where("value > 0").groupBy("from_address").agg(F.round(F.stddev_pop(F.col("value").cast("double")) / F.avg(F.col("value").cast("double")), 7).alias("cv")), f"WITH {CANON} SELECT from_address, round(stddev_pop(value::DOUBLE) / avg(value::DOUBLE), 7) AS cv FROM c WHERE value > 0 GROUP BY from_address")
register(
    "counterparty_profile",
    lambda v: canonical(v.txn, v.blk).where("to_address is not null").groupBy("from_address", "to_address").agg(F.count(F.lit(1)).alias("k")).groupBy("from_address").agg(F.count(F.lit(1)).alias("parties"), F.round(F.count(F.lit(1)) / F.sum("k"), 9).alias("diversity"), F.round(F.max("k") / F.sum("k"), 9).alias("top_share")),
    f"WITH {CANON} SELECT from_address, count(*) AS parties, round(count(*) / sum(k), 9) AS diversity, round(max(k) / sum(k), 9) AS top_share FROM (SELECT from_address, to_address, count(*) AS k FROM c WHERE to_address IS NOT NULL GROUP BY ALL) GROUP BY from_address",
)


def value_rank(transfers: DataFrame) -> DataFrame:
    """Percent of the chain's population strictly below each value: by counts of values, no global sort of rows."""
    w = Window.partitionBy("chain")
    counts = transfers.groupBy("chain", "value").agg(F.count(F.lit(1)).alias("n")).select("chain", "value", F.sum("n").over(w.orderBy("value")).alias("upto"), F.col("n"), F.sum("n").over(w).alias("all_n"))
    return transfers.join(counts.select("chain", "value", F.round((F.col("upto") - F.col("n")) / F.col("all_n") * 100, 7).alias("below")), ["chain", "value"])


register("value_rank", lambda v: value_rank(canonical(v.txn, v.blk)).select("tx_key", "below"), f"WITH {CANON} SELECT tx_key, round((rank() OVER (PARTITION BY chain ORDER BY value) - 1) / count(*) OVER (PARTITION BY chain) * 100, 7) AS below FROM c")
micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
by_time = lambda: Window.partitionBy("user_id").orderBy("ts", "event_id")
register("event_gaps", lambda v: v.events.withColumn("gap", micros("ts") - F.lag(micros("ts")).over(by_time())).groupBy("user_id").agg(F.count("gap").alias("gaps"), F.max("gap").alias("longest"), F.round((F.max(micros("ts")) - F.min(micros("ts"))) / 86_400_000_000, 7).alias("span_days")), "SELECT user_id, count(gap) AS gaps, max(gap) AS longest, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000, 7) AS span_days FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id")
register("bursts", lambda v: v.events.withColumn("gap", micros("ts") - F.lag(micros("ts")).over(by_time())).where("gap < 3600000000").select("event_id", "user_id", "gap"), "SELECT event_id, user_id, gap FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap < 3600000000")
register("milestones", lambda v: v.events.where(F.col("event_type").isin("signup", "purchase")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ",").alias("timeline")), "SELECT user_id, count(*) AS n, min(ts) AS first_at, string_agg(event_type, ',' ORDER BY ts, event_id) AS timeline FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id")


RANGE = "6 hours"


def asof(points: DataFrame, candles: DataFrame, width: str = RANGE) -> DataFrame:
    """``symbol, point_id, at_time, price``: the last close at or before each point's time, null if there is none.

    Time is dealt into ranges of ``width``, and within a range a running last
    value finds the close.  A point before its range's first candle takes what
    ranges carry over: the last close of each range, a row a range, so no task
    sees a whole symbol.  Candles of one moment: the greatest close counts.
    """
    span = lambda t: F.window(F.col(t).cast("timestamp"), width)["start"]
    a = points.select("symbol", span("at_time").alias("range"), "at_time", F.lit(1).alias("is_point"), F.lit(None).cast("double").alias("close"), "point_id")
    b = candles.select("symbol", span("open_time").alias("range"), F.col("open_time").alias("at_time"), F.lit(0).alias("is_point"), F.col("close").cast("double").alias("close"), F.lit(None).cast("long").alias("point_id"))
    w = Window.partitionBy("symbol", "range").orderBy("at_time", "is_point", "close").rowsBetween(Window.unboundedPreceding, 0)
    inside = a.unionByName(b).withColumn("own", F.last("close", ignorenulls=True).over(w)).where("is_point = 1")
    last = b.groupBy("symbol", "range").agg(F.max_by("close", F.struct("at_time", "close")).alias("last"))
    asked = a.select("symbol", "range").distinct().join(last, ["symbol", "range"], "full")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    return inside.join(asked.select("symbol", "range", before.alias("carried")), ["symbol", "range"], "left").select("symbol", "point_id", "at_time", F.coalesce("own", "carried").alias("price"))


register("price_asof", lambda v: asof(v.events.select(F.col("event_type").alias("symbol"), F.col("ts").alias("at_time"), F.col("event_id").alias("point_id")), v.candle).select("point_id", "price"), "SELECT e.event_id AS point_id, c.close AS price FROM events e ASOF LEFT JOIN candle c ON e.event_type = c.symbol AND e.ts >= c.open_time")
by_symbol = lambda: Window.partitionBy("symbol").orderBy("open_time")
returns = lambda c: c.withColumn("r", F.col("close") / F.lag("close").over(by_symbol()) - 1)
RET = "r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS r FROM candle)"
register("vol_std", lambda v: returns(v.candle).groupBy("symbol").agg(F.round(F.stddev_pop("r") * 100, 6).alias("vol"), F.round(F.sqrt(F.sum(F.col("r") * F.col("r"))) * F.sqrt(F.lit(24.0)), 5).alias("realized")), f"WITH {RET} SELECT symbol, round(stddev_pop(r) * 100, 6) AS vol, round(sqrt(sum(r * r)) * sqrt(24.0), 5) AS realized FROM r GROUP BY symbol")
register("jumps", lambda v: returns(v.candle).join(returns(v.candle).groupBy("symbol").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s")), "symbol").where(F.abs(F.col("r") - F.col("m")) > F.greatest(3 * F.col("s"), F.lit(0.005))).select("symbol", "open_time", F.round("r", 7).alias("ret")), f"WITH {RET}, s AS (SELECT symbol, avg(r) AS m, stddev_pop(r) AS s FROM r GROUP BY symbol) SELECT symbol, open_time, round(r, 7) AS ret FROM r JOIN s USING (symbol) WHERE abs(r - m) > greatest(3 * s, 0.005)")
T0 = "timestamp'2024-01-15 00:00:00'"
side = lambda c, cond, order: c.where(cond).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(order))).where("k <= 6").groupBy("symbol").agg(F.avg("volume").alias("v"))
register("volume_surge", lambda v: side(v.candle, f"open_time >= {T0}", F.asc("open_time")).withColumnRenamed("v", "after").join(side(v.candle, f"open_time < {T0}", F.desc("open_time")).withColumnRenamed("v", "before"), "symbol").select("symbol", F.round(F.col("after") / F.col("before"), 9).alias("surge")), "WITH a AS (SELECT symbol, avg(volume) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS k FROM candle WHERE open_time >= TIMESTAMP '2024-01-15 00:00:00') WHERE k <= 6 GROUP BY symbol), b AS (SELECT symbol, avg(volume) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM candle WHERE open_time < TIMESTAMP '2024-01-15 00:00:00') WHERE k <= 6 GROUP BY symbol) SELECT symbol, round(a.v / b.v, 9) AS surge FROM a JOIN b USING (symbol)")
register("liquidity_stats", lambda v: returns(v.candle).where("r is not null").groupBy("symbol").agg(F.round(F.avg(F.abs("r") / F.col("volume")), 7).alias("amihud"), F.round(F.sqrt(F.sum(F.col("volume") * F.col("r") * F.col("r")) / F.sum("volume")), 6).alias("weighted_vol")), f"WITH {RET} SELECT symbol, round(avg(abs(r) / volume), 7) AS amihud, round(sqrt(sum(volume * r * r) / sum(volume)), 6) AS weighted_vol FROM r WHERE r IS NOT NULL GROUP BY symbol")


def tail_risk(candles: DataFrame) -> DataFrame:
    """Value at risk and expected shortfall at 95 percent, and the deepest drawdown."""
    r = returns(candles).where("r is not null")
    w = Window.partitionBy("symbol")
    ranked = r.select("symbol", "r", F.row_number().over(w.orderBy("r")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    at = F.greatest(F.lit(1), F.floor(F.col("n") * 0.05))
    tail = ranked.where(F.col("k") <= at).groupBy("symbol").agg(F.round(F.max("r"), 7).alias("var95"), F.round(F.avg("r"), 7).alias("cvar95"))
    fall = candles.select("symbol", (F.col("close") / F.max("close").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("d")).groupBy("symbol").agg(F.round(F.min("d"), 7).alias("drawdown"))
    return tail.join(fall, "symbol")


register("tail_risk", lambda v: tail_risk(v.candle), f"WITH {RET}, k AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE r IS NOT NULL), t AS (SELECT symbol, round(max(r), 7) AS var95, round(avg(r), 7) AS cvar95 FROM k WHERE k <= greatest(1, floor(n * 0.05)) GROUP BY symbol), d AS (SELECT symbol, round(min(d), 7) AS drawdown FROM (SELECT symbol, close / max(close) OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS d FROM candle) GROUP BY symbol) SELECT * FROM t JOIN d USING (symbol)")


def vol_recursive(candles: DataFrame, decay: float = 0.94) -> DataFrame:
    """EWMA variance as a closed sum of weights over the time-ordered returns of a symbol."""
    r = returns(candles).where("r is not null")
    w = Window.partitionBy("symbol")
    aged = r.select("symbol", "r", (F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy("open_time"))).alias("age"), F.row_number().over(w.orderBy("open_time")).alias("k"))
    weight = F.when(F.col("k") == 1, F.pow(F.lit(decay), F.col("age"))).otherwise((1 - decay) * F.pow(F.lit(decay), F.col("age")))
    return aged.groupBy("symbol").agg(F.round(F.sqrt(F.sum(weight * F.col("r") * F.col("r"))), 6).alias("ewma"))


register("vol_recursive", lambda v: vol_recursive(v.candle), f"WITH {RET}, a AS (SELECT symbol, r, count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS age, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS k FROM r WHERE r IS NOT NULL) SELECT symbol, round(sqrt(sum(CASE WHEN k = 1 THEN pow(0.94, age) ELSE (1 - 0.94) * pow(0.94, age) END * r * r)), 6) AS ewma FROM a GROUP BY symbol")


def anomalies(population: DataFrame, least: int = 20) -> DataFrame:
    """Modified z-scores of log10 values per chain; no spread or few samples mean insufficient evidence."""
    logs = population.where("value > 0").select("chain", "tx_key", F.log10(F.col("value").cast("double")).alias("x"))
    middle = medians(logs, "chain", "x", F.floor(F.col("x") * 256), "m").withColumnRenamed("all_n", "n")
    off = logs.join(middle, "chain").withColumn("d", F.abs(F.col("x") - F.col("m")))
    spread = medians(off, "chain", "d", F.floor(F.col("d") * 4096), "mad").drop("all_n")
    z = F.col("d") * 0.6745 / F.col("mad")
    grade = F.when((F.col("n") < least) | (F.col("mad") == 0), "insufficient").when(z >= 8, "extreme").when(z >= 5, "strong").when(z >= 3.5, "anomalous").otherwise("normal")
    return off.join(spread, "chain").select("tx_key", grade.alias("grade"))


register("det_anomaly", lambda v: anomalies(canonical(v.txn, v.blk)).groupBy("grade").agg(F.count(F.lit(1)).alias("n")), f"WITH {CANON}, l AS (SELECT chain, log10(value::DOUBLE) AS x FROM c WHERE value > 0), m AS (SELECT chain, median(x) AS m, count(*) AS n FROM l GROUP BY chain), d AS (SELECT l.chain, n, abs(x - m) AS d FROM l JOIN m USING (chain)), s AS (SELECT chain, median(d) AS mad FROM d GROUP BY chain) SELECT CASE WHEN n < 20 OR mad = 0 THEN 'insufficient' WHEN d * 0.6745 / mad >= 8 THEN 'extreme' WHEN d * 0.6745 / mad >= 5 THEN 'strong' WHEN d * 0.6745 / mad >= 3.5 THEN 'anomalous' ELSE 'normal' END AS grade, count(*) AS n FROM d JOIN s USING (chain) GROUP BY 1")


def approval_replay(approvals: DataFrame) -> DataFrame:
    """The latest grant per key; live ones by owner, with unlimited and revoked counts."""
    key = F.when(F.col("kind") == "erc721_approval", F.concat_ws("|", "kind", "token", "owner", F.col("token_id").cast("string"))).otherwise(F.concat_ws("|", "kind", "token", "owner", "spender"))
    last = approvals.groupBy(key.alias("grant_key"), "owner").agg(F.max_by(F.struct("is_revocation", "allowance"), F.struct("block_number", "log_index")).alias("g"))
    return last.groupBy("owner").agg(count_if(~F.col("g.is_revocation")).alias("live"), count_if(F.col("g.is_revocation")).alias("revoked"), count_if(~F.col("g.is_revocation") & (F.col("g.allowance") >= 20000)).alias("large"))


register("approval_replay", lambda v: approval_replay(v.appr), "WITH k AS (SELECT *, CASE WHEN kind = 'erc721_approval' THEN concat_ws('|', kind, token, owner, token_id) ELSE concat_ws('|', kind, token, owner, spender) END AS grant_key FROM appr), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grant_key ORDER BY block_number DESC, log_index DESC) AS r FROM k) WHERE r = 1) SELECT owner, count(*) FILTER (WHERE NOT is_revocation) AS live, count(*) FILTER (WHERE is_revocation) AS revoked, count(*) FILTER (WHERE NOT is_revocation AND allowance >= 20000) AS large FROM l GROUP BY owner")
