"""Aggregates over blocks, transfers and labels; coverage and address-level profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register
from .ledger import BEST, CANON, ENT, GATE, best_labels, canonical, count_if, gated, total, with_entities

ABSENCE_BLOCKS = 3600  # an absence may be claimed only over so many contiguous, fully captured blocks


def height_window(blocks: DataFrame) -> DataFrame:
    """Coverage of each chain: how many blocks, how complete, how contiguous."""
    out = blocks.where("canonical").groupBy("chain").agg(
        F.count(F.lit(1)).alias("blocks"), count_if(F.col("complete")).alias("complete"), count_if(F.col("incomplete_reason") == "selective_capture").alias("selective"),
        F.min("number").alias("first_number"), F.max("number").alias("last_number"), F.max("capture_floor").alias("floor"),
    )
    return out.withColumn("span", F.col("last_number") - F.col("first_number") + 1).withColumn("contiguous", F.col("span") == F.col("blocks"))


def coverage(window: DataFrame, least: int = ABSENCE_BLOCKS) -> DataFrame:
    """May an absence be claimed, above which floor, and if not, why."""
    captured = F.col("complete") + F.col("selective") == F.col("blocks")
    limitation = F.when(~F.col("contiguous"), "gaps").when(~captured, "incomplete").when(F.col("span") < least, "short").when(F.col("selective") > 0, "bounded").otherwise("none")
    return window.select("chain", "blocks", "span", limitation.alias("limitation"), (F.col("contiguous") & captured & (F.col("span") >= least)).alias("absence"), F.when(F.col("selective") > 0, F.col("floor")).alias("absence_floor"))


def block_aggregates(transfers: DataFrame) -> DataFrame:
    """Per block: counts, totals, distinct parties (two-step), the material part."""
    key = ["chain", "block_number"]
    base = transfers.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), total("value").alias("total"), F.max("value").alias("largest"), count_if(F.col("reason") != "IMMATERIAL").alias("material"), total("value", F.col("reason") != "IMMATERIAL").alias("material_total"))
    distinct = lambda c, name: transfers.where(F.col(c).isNotNull()).select(*key, c).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    return base.join(distinct("from_address", "senders"), key, "left").join(distinct("to_address", "receivers"), key, "left").fillna(0, ["senders", "receivers"])


def address_summary(transfers: DataFrame) -> DataFrame:
    """One row per address: sent, received, first and last; a self-transfer counts on both sides."""
    sides = F.array(F.struct(F.col("from_address").alias("address"), F.lit(True).alias("out"), F.col("to_address").alias("other")), F.struct(F.col("to_address").alias("address"), F.lit(False).alias("out"), F.col("from_address").alias("other")))
    each = transfers.select("block_number", "happened_at", "value", F.explode(sides).alias("s")).select("*", "s.*").where("address is not null")
    base = each.groupBy("address").agg(
        count_if(F.col("out")).alias("sent"), total("value", F.col("out")).alias("sent_total"), count_if(~F.col("out")).alias("received"), total("value", ~F.col("out")).alias("received_total"),
        F.min("block_number").alias("first_number"), F.max("block_number").alias("last_number"), F.max(F.when(F.col("out"), F.col("happened_at"))).alias("last_outbound_at"),
    )
    others = each.where("other is not null").select("address", "other").distinct().groupBy("address").agg(F.count(F.lit(1)).alias("counterparties"))
    return base.join(others, "address", "left").fillna(0, ["counterparties"])


def token_flow(transfers: DataFrame) -> DataFrame:
    """Gross in and out per address and token; a self-transfer adds to both and is one transfer."""
    sides = F.array(F.struct(F.col("from_address").alias("address"), F.lit(True).alias("out")), F.struct(F.col("to_address").alias("address"), F.lit(False).alias("out")))
    each = transfers.select("token", "value", F.expr("from_address <=> to_address").alias("own"), F.explode(sides).alias("s")).select("*", "s.*")
    return each.groupBy("address", "token").agg(total("value", ~F.col("out")).alias("gross_in"), total("value", F.col("out")).alias("gross_out"), count_if(F.col("out") | ~F.col("own")).alias("transfers"))


def corroborate(labels: DataFrame) -> DataFrame:
    """Unverified labels whose entity two sources name become corroborated, at 0.75."""
    named = labels.select("address", "entity", "source").distinct().groupBy("address", "entity").agg(F.count(F.lit(1)).alias("sources")).where("sources >= 2").drop("sources").withColumn("twice", F.lit(True))
    up = F.col("twice").isNotNull() & (F.col("status") == "unverified")
    out = labels.join(named, ["address", "entity"], "left")
    return out.withColumn("confidence", F.when(up, 0.75).otherwise(F.col("confidence"))).withColumn("status", F.when(up, "corroborated").otherwise(F.col("status"))).drop("twice")


register("height_window", lambda v: height_window(v.blk), "SELECT *, last_number - first_number + 1 AS span, last_number - first_number + 1 = blocks AS contiguous FROM (SELECT chain, count(*) AS blocks, count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE incomplete_reason = 'selective_capture') AS selective, min(number) AS first_number, max(number) AS last_number, max(capture_floor)::BIGINT AS floor FROM blk WHERE canonical GROUP BY chain)")
HW = "w AS (SELECT chain, count(*) AS blocks, count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE incomplete_reason = 'selective_capture') AS selective, max(number) - min(number) + 1 AS span, max(capture_floor)::BIGINT AS floor FROM blk WHERE canonical GROUP BY chain)"
register("coverage", lambda v: coverage(height_window(v.blk), 500), f"WITH {HW} SELECT chain, blocks, span, CASE WHEN span <> blocks THEN 'gaps' WHEN complete + selective <> blocks THEN 'incomplete' WHEN span < 500 THEN 'short' WHEN selective > 0 THEN 'bounded' ELSE 'none' END AS limitation, span = blocks AND complete + selective = blocks AND span >= 500 AS absence, CASE WHEN selective > 0 THEN floor END AS absence_floor FROM w")
AGG = f"{GATE}, ba AS (SELECT chain, block_number, count(*) AS n, sum(value)::BIGINT AS total, max(value)::BIGINT AS largest, count(*) FILTER (WHERE reason <> 'IMMATERIAL') AS material, coalesce(sum(value) FILTER (WHERE reason <> 'IMMATERIAL'), 0)::BIGINT AS material_total, count(DISTINCT from_address) AS senders, count(DISTINCT to_address) AS receivers FROM g GROUP BY ALL)"
register("block_aggregate", lambda v: block_aggregates(gated(v)), f"WITH {AGG} SELECT * FROM ba")
register("selective_capture", lambda v: gated(v).where("reason <> 'IMMATERIAL'").select("tx_key", "chain", "block_number", "value", "reason", "floor"), f"WITH {GATE} SELECT g.tx_key, g.chain, g.block_number, g.value::BIGINT AS value, g.reason, fl.floor::BIGINT AS floor FROM g LEFT JOIN fl USING (chain) WHERE reason <> 'IMMATERIAL'")
register("window_totals", lambda v: block_aggregates(gated(v)).where("block_number between 200 and 1200").groupBy("chain").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n"), total("total").alias("total"), F.max("largest").alias("largest"), F.sum("material").alias("material")), f"WITH {AGG} SELECT chain, count(*) AS blocks, sum(n)::BIGINT AS n, sum(total)::BIGINT AS total, max(largest) AS largest, sum(material)::BIGINT AS material FROM ba WHERE block_number BETWEEN 200 AND 1200 GROUP BY chain")
register("hourly_rollup", lambda v: canonical(v.txn, v.blk).groupBy("chain", F.date_trunc("hour", "happened_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"), total("value").alias("total"), F.max("value").alias("largest")), f"WITH {CANON} SELECT chain, date_trunc('hour', happened_at) AS hour, count(*) AS n, sum(value)::BIGINT AS total, max(value)::BIGINT AS largest FROM c GROUP BY ALL")
SUMMARY = f"{CANON}, s AS (SELECT from_address AS address, TRUE AS out, to_address AS other, block_number, happened_at, value FROM c UNION ALL SELECT to_address, FALSE, from_address, block_number, happened_at, value FROM c WHERE to_address IS NOT NULL), a AS (SELECT address, count(*) FILTER (WHERE out) AS sent, coalesce(sum(value) FILTER (WHERE out), 0)::BIGINT AS sent_total, count(*) FILTER (WHERE NOT out) AS received, coalesce(sum(value) FILTER (WHERE NOT out), 0)::BIGINT AS received_total, min(block_number) AS first_number, max(block_number) AS last_number, max(happened_at) FILTER (WHERE out) AS last_outbound_at, count(DISTINCT other) AS counterparties FROM s GROUP BY address)"
summary = lambda v: address_summary(canonical(v.txn, v.blk))
register("address_summary", summary, f"WITH {SUMMARY} SELECT * FROM a")
register("entity_ledger", lambda v: summary(v).join(best_labels(v.lbl).select("address", "entity", "category"), "address", "left"), f"WITH {SUMMARY}, {BEST} SELECT a.*, entity, category FROM a LEFT JOIN best USING (address)")
TFLOW = "tf AS (SELECT address, token, coalesce(sum(value) FILTER (WHERE NOT out), 0)::BIGINT AS gross_in, coalesce(sum(value) FILTER (WHERE out), 0)::BIGINT AS gross_out, count(DISTINCT log_index) AS transfers FROM (SELECT from_address AS address, TRUE AS out, token, value, log_index FROM ttx UNION ALL SELECT to_address, FALSE, token, value, log_index FROM ttx) GROUP BY ALL)"
register("token_flow", lambda v: token_flow(v.ttx), f"WITH {TFLOW} SELECT * FROM tf")
register("nft_heuristic", lambda v: token_flow(v.ttx).groupBy("token").agg(total(F.col("gross_in")).alias("moved"), F.sum("transfers").alias("transfers")).select("token", (F.col("moved") <= F.col("transfers")).alias("like_nft")), f"WITH {TFLOW} SELECT token, sum(gross_in) <= sum(transfers) AS like_nft FROM tf GROUP BY token")
register("token_totals", lambda v: v.ttx.groupBy("token").agg(F.count(F.lit(1)).alias("transfers"), count_if(F.col("is_mint")).alias("mints"), count_if(F.col("is_burn")).alias("burns")), "SELECT token, count(*) AS transfers, count(*) FILTER (WHERE is_mint) AS mints, count(*) FILTER (WHERE is_burn) AS burns FROM ttx GROUP BY token")
register(
    "table_counts",
    lambda v: v.blk.where("canonical").select(F.lit("blocks").alias("name")).unionByName(canonical(v.txn, v.blk).select(F.lit("transfers").alias("name"))).unionByName(v.ttx.select(F.lit("tokens").alias("name"))).unionByName(v.appr.select(F.lit("approvals").alias("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {CANON} SELECT 'blocks' AS name, count(*) AS n FROM blk WHERE canonical UNION ALL SELECT 'transfers', count(*) FROM c UNION ALL SELECT 'tokens', count(*) FROM ttx UNION ALL SELECT 'approvals', count(*) FROM appr",
)
register("label_stats", lambda v: v.lbl.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.min("confidence").alias("least_confidence")), "SELECT source, status, count(*) AS n, count(DISTINCT entity) AS entities, min(confidence) AS least_confidence FROM lbl GROUP BY ALL")
register("label_corroborate", lambda v: corroborate(v.lbl), "SELECT chain, address, entity, category, source, CASE WHEN up THEN 0.75e0 ELSE confidence END AS confidence, CASE WHEN up THEN 'corroborated' ELSE status END AS status FROM (SELECT *, n >= 2 AND status = 'unverified' AS up FROM (SELECT l.*, n FROM lbl l JOIN (SELECT address, entity, count(DISTINCT source) AS n FROM lbl GROUP BY ALL) USING (address, entity)))")


def verify_labels(labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """Labels that the evidence names become verified, at 0.95; then distinct addresses by status."""
    named = evidence.select("address").distinct().withColumn("seen", F.lit(True))
    out = labels.join(named, "address", "left").withColumn("status", F.when(F.col("seen"), "verified").otherwise(F.col("status")))
    return out.select("address", "status").distinct().groupBy("status").agg(F.count(F.lit(1)).alias("addresses"))


register("label_verify", lambda v: verify_labels(v.lbl, v.lbl.where("source = 'src9'")), "SELECT status, count(DISTINCT address) AS addresses FROM (SELECT address, CASE WHEN address IN (SELECT address FROM lbl WHERE source = 'src9') THEN 'verified' ELSE status END AS status FROM lbl) GROUP BY status")

# Profiles.
register("network_health", lambda v: height_window(v.blk).join(v.blk.where("canonical").groupBy("chain").agg(count_if(~F.col("complete")).alias("incomplete")), "chain").select("chain", "contiguous", F.round(F.col("complete") / F.col("blocks"), 9).alias("completeness"), "incomplete"), f"WITH {HW} SELECT chain, span = blocks AS contiguous, round(complete / blocks, 9) AS completeness, blocks - complete AS incomplete FROM w")
register(
    "wallet_profile",
    lambda v: summary(v).select("address", (F.col("sent") + F.col("received")).alias("n"), F.when(F.col("sent") == 0, "receive_only").when(F.col("received") == 0, "send_only").otherwise("both").alias("posture"), F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("last_outbound_at")).alias("days_quiet")),
    f"WITH {SUMMARY} SELECT address, sent + received AS n, CASE WHEN sent = 0 THEN 'receive_only' WHEN received = 0 THEN 'send_only' ELSE 'both' END AS posture, CAST(datediff('day', last_outbound_at::DATE, DATE '2000-01-01') AS INT) AS days_quiet FROM a",
)


def native_flow(transfers: DataFrame) -> DataFrame:
    """Gross in and out per address (a self-transfer is out only), net direction, share of the largest."""
    sides = F.array_compact(F.array(F.struct(F.col("from_address").alias("address"), F.lit(True).alias("out")), F.when(~F.expr("from_address <=> to_address") & F.col("to_address").isNotNull(), F.struct(F.col("to_address").alias("address"), F.lit(False).alias("out")))))
    each = transfers.select("value", F.explode(sides).alias("s")).select("value", "s.*")
    out = each.groupBy("address").agg(total("value", ~F.col("out")).alias("gross_in"), total("value", F.col("out")).alias("gross_out"), F.max("value").alias("largest"), total("value").alias("moved"))
    sign = F.col("gross_in") - F.col("gross_out")
    return out.select("address", "gross_in", "gross_out", F.when(sign > 0, "in").when(sign < 0, "out").otherwise("flat").alias("direction"), F.round(F.col("largest").cast("double") / F.col("moved").cast("double"), 9).alias("concentration"))


register(
    "native_flow",
    lambda v: native_flow(canonical(v.txn, v.blk)),
    f"WITH {CANON}, s AS (SELECT from_address AS address, TRUE AS out, value FROM c UNION ALL SELECT to_address, FALSE, value FROM c WHERE to_address IS NOT NULL AND to_address <> from_address), a AS (SELECT address, coalesce(sum(value) FILTER (WHERE NOT out), 0)::BIGINT AS gross_in, coalesce(sum(value) FILTER (WHERE out), 0)::BIGINT AS gross_out, max(value) AS largest, sum(value) AS moved FROM s GROUP BY address) SELECT address, gross_in, gross_out, CASE WHEN gross_in > gross_out THEN 'in' WHEN gross_in < gross_out THEN 'out' ELSE 'flat' END AS direction, round(largest::DOUBLE / moved::DOUBLE, 9) AS concentration FROM a",
)
#: Fixed values for the token queries: face-dollar tokens with their decimals.
STABLE = [("t1", "USDA", 2), ("t5", "USDB", 3), ("t9", "USDC", 1)]
STABLE_SQL = "st AS (SELECT * FROM (VALUES ('t1', 'USDA', 2), ('t5', 'USDB', 3), ('t9', 'USDC', 1)) AS x(token, coin, decimals))"


def stablecoin_flow(flows: DataFrame, coins: DataFrame) -> DataFrame:
    """Face dollars in, out and net per coin."""
    scaled = flows.join(F.broadcast(coins), "token").groupBy("coin", "decimals").agg(total("gross_in").alias("i"), total("gross_out").alias("o"))
    unit = F.pow(F.lit(10.0), F.col("decimals"))
    return scaled.select("coin", F.round(F.col("i").cast("double") / unit, 6).alias("face_in"), F.round(F.col("o").cast("double") / unit, 6).alias("face_out"), F.round((F.col("i") - F.col("o")).cast("double") / unit, 6).alias("net"))


coins = lambda v: v.spark.createDataFrame(STABLE, "token string, coin string, decimals int")
register("stablecoin_flow", lambda v: stablecoin_flow(token_flow(v.ttx).where("address in ('u1','u2','u3')"), coins(v)), f"WITH {TFLOW}, {STABLE_SQL} SELECT coin, round(sum(gross_in)::DOUBLE / pow(10.0, decimals), 6) AS face_in, round(sum(gross_out)::DOUBLE / pow(10.0, decimals), 6) AS face_out, round((sum(gross_in) - sum(gross_out))::DOUBLE / pow(10.0, decimals), 6) AS net FROM tf JOIN st USING (token) WHERE address IN ('u1','u2','u3') GROUP BY coin, decimals")
register("stable_norm", lambda v: v.ttx.join(F.broadcast(coins(v)), "token").select("log_index", "coin", F.round(F.col("value").cast("double") / F.pow(F.lit(10.0), F.col("decimals")), 6).alias("face")), f"WITH {STABLE_SQL} SELECT log_index, coin, round(value::DOUBLE / pow(10.0, decimals), 6) AS face FROM ttx JOIN st USING (token)")
register("token_decimals", lambda v: v.ttx.select("token").distinct().join(F.broadcast(coins(v)), "token", "left").select("token", "decimals"), f"WITH {STABLE_SQL} SELECT DISTINCT token, decimals FROM ttx LEFT JOIN st USING (token)")
register("staking_signals", lambda v: v.ttx.groupBy("to_address").agg(count_if(F.col("token") == "t3").alias("deposits"), count_if(F.col("value") % 3200 == 0).alias("exact")), "SELECT to_address, count(*) FILTER (WHERE token = 't3') AS deposits, count(*) FILTER (WHERE value % 3200 = 0) AS exact FROM ttx GROUP BY to_address")
