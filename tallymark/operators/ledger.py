"""Canonical history, filters, top-k, joins to labels and the flow rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register
from .order import fine_log, nth_values

def total(value, when: Column | None = None) -> Column:
    """An exact sum of amounts; 0 where nothing counts."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)")


def count_if(when: Column) -> Column:
    return F.sum(F.when(when, 1).otherwise(0)).cast("long")


def canonical(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Facts of canonical blocks only."""
    keys = blocks.where("canonical").select("chain", F.col("number").alias("block_number"))
    return facts.join(keys, ["chain", "block_number"], "left_semi")


def best_labels(labels: DataFrame) -> DataFrame:
    """One label per address: the most confident, ties by source."""
    best = F.min_by(F.struct("entity", "category", "source", "confidence", "status"), F.struct(-F.col("confidence"), "source", "category")).alias("b")
    return labels.groupBy("address").agg(best).select("address", "b.*")


def with_entities(transfers: DataFrame, best: DataFrame) -> DataFrame:
    """Transfers with the entity of sender and recipient (null: unlabelled)."""
    one = best.select(F.col("address").alias("from_address"), F.col("entity").alias("from_entity"), F.col("category").alias("from_category"))
    two = best.select(F.col("address").alias("to_address"), F.col("entity").alias("to_entity"), F.col("category").alias("to_category"))
    return transfers.join(one, "from_address", "left").join(two, "to_address", "left")


def classify(joined: DataFrame) -> DataFrame:
    """deposit, withdrawal, internal or unrelated, and the operators concerned."""
    a, b = F.col("from_entity"), F.col("to_entity")
    kind = F.when(a.isNotNull() & b.isNotNull(), "internal").when(b.isNotNull(), "deposit").when(a.isNotNull(), "withdrawal").otherwise("unrelated")
    return joined.withColumn("flow_kind", kind).withColumn("operators", F.array_sort(F.array_distinct(F.array_compact(F.array(a, b)))))


def hour_quality(blocks: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "block_time").alias("hour")
    return blocks.where("canonical").groupBy("chain", hour).agg(F.count(F.lit(1)).alias("blocks"), count_if(F.col("complete")).alias("complete_blocks"), F.max("capture_floor").alias("floor"))


def flow_rollup(transfers: DataFrame, labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hourly flows of each operator, with distinct addresses in two steps and the hour's block quality."""
    flows = classify(with_entities(canonical(transfers, blocks), best_labels(labels))).where("flow_kind <> 'unrelated'")
    each = flows.select("chain", F.date_trunc("hour", "happened_at").alias("hour"), F.explode("operators").alias("entity"), "flow_kind", "value", "block_number", "from_address", "to_address")
    kind = F.col("flow_kind")
    sums = [f for k in ("deposit", "withdrawal", "internal") for f in (count_if(kind == k).alias(f"{k}_count"), total("value", kind == k).alias(f"{k}_value"))]
    rolled = each.groupBy("chain", "hour", "entity").agg(*sums, F.min("block_number").alias("first_number"), F.max("block_number").alias("last_number"))
    party = each.select("chain", "hour", "entity", F.explode(F.array_compact(F.array("from_address", "to_address"))).alias("a")).distinct()
    party = party.groupBy("chain", "hour", "entity").agg(F.count(F.lit(1)).alias("addresses"))
    quality = blocks.where("canonical").groupBy("chain", F.date_trunc("day", "block_time").alias("day")).agg(F.count(F.lit(1)).alias("day_blocks"), count_if(F.col("complete")).alias("day_complete"))
    out = rolled.join(party, ["chain", "hour", "entity"]).withColumn("day", F.date_trunc("day", "hour")).join(quality, ["chain", "day"], "left")
    return out.drop("day")


CANON = "c AS (SELECT t.* FROM txn t SEMI JOIN (SELECT chain, number FROM blk WHERE canonical) b ON t.chain = b.chain AND t.block_number = b.number)"
BEST = "best AS (SELECT address, entity, category, source, confidence, status FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY confidence DESC, source, category) AS r FROM lbl) WHERE r = 1)"
ENT = f"{CANON}, {BEST}, e AS (SELECT c.*, f.entity AS from_entity, f.category AS from_category, t.entity AS to_entity, t.category AS to_category FROM c LEFT JOIN best f ON c.from_address = f.address LEFT JOIN best t ON c.to_address = t.address)"
CLS = f"{ENT}, k AS (SELECT *, CASE WHEN from_entity IS NOT NULL AND to_entity IS NOT NULL THEN 'internal' WHEN to_entity IS NOT NULL THEN 'deposit' WHEN from_entity IS NOT NULL THEN 'withdrawal' ELSE 'unrelated' END AS flow_kind FROM e)"
OPS = f"{CLS}, o AS (SELECT *, date_trunc('hour', happened_at) AS hour, unnest(list_distinct(list_filter([from_entity, to_entity], lambda x: x IS NOT NULL))) AS entity FROM k WHERE flow_kind <> 'unrelated')"
KINDS = ", ".join(f"count(*) FILTER (WHERE flow_kind = '{k}') AS {k}_count, coalesce(sum(value) FILTER (WHERE flow_kind = '{k}'), 0)::BIGINT AS {k}_value" for k in ("deposit", "withdrawal", "internal"))

register("canonical_join", lambda v: canonical(v.txn, v.blk).groupBy("chain").agg(F.count(F.lit(1)).alias("n"), total("value").alias("total")), f"WITH {CANON} SELECT chain, count(*) AS n, sum(value)::BIGINT AS total FROM c GROUP BY chain")
register("label_set", lambda v: best_labels(v.lbl), f"WITH {BEST} SELECT * FROM best")
register(
    "label_join",
    lambda v: with_entities(canonical(v.txn, v.blk), best_labels(v.lbl)).groupBy("to_entity").agg(F.count(F.lit(1)).alias("n"), total("value").alias("total")),
    f"WITH {ENT} SELECT to_entity, count(*) AS n, sum(value)::BIGINT AS total FROM e GROUP BY to_entity",
)
register(
    "flow_classify",
    lambda v: classify(with_entities(canonical(v.txn, v.blk), best_labels(v.lbl))).select("tx_key", "flow_kind", F.array_join("operators", ",").alias("operators")),
    f"WITH {CLS} SELECT tx_key, flow_kind, array_to_string(list_sort(list_distinct(list_filter([from_entity, to_entity], lambda x: x IS NOT NULL))), ',') AS operators FROM k",
)
register(
    "flow_rollup",
    lambda v: flow_rollup(v.txn, v.lbl, v.blk),
    f"""WITH {OPS}, p AS (SELECT chain, hour, entity, count(DISTINCT a) AS addresses FROM (SELECT chain, hour, entity, unnest([from_address, to_address]) AS a FROM o) WHERE a IS NOT NULL GROUP BY ALL),
q AS (SELECT chain, date_trunc('day', block_time) AS day, count(*) AS day_blocks, count(*) FILTER (WHERE complete) AS day_complete FROM blk WHERE canonical GROUP BY ALL),
r AS (SELECT chain, hour, entity, {KINDS}, min(block_number) AS first_number, max(block_number) AS last_number FROM o GROUP BY ALL)
SELECT r.*, addresses, day_blocks, day_complete FROM r JOIN p USING (chain, hour, entity) LEFT JOIN q ON r.chain = q.chain AND date_trunc('day', r.hour) = q.day""",
)


def flow_stats(flows: DataFrame) -> DataFrame:
    """Totals over the window: each transfer counts once, undated ones included."""
    kind = F.col("flow_kind")
    out = flows.groupBy("chain").agg(*[f for k in ("deposit", "withdrawal", "internal") for f in (count_if(kind == k).alias(f"{k}_count"), total("value", kind == k).alias(f"{k}_value"))], count_if(kind == "unrelated").alias("unrelated_count"))
    net = F.col("deposit_value") - F.col("withdrawal_value")
    return out.withColumn("net", net.cast("decimal(38,0)")).withColumn("direction", F.when(F.col("net") > 0, "inflow").when(F.col("net") < 0, "outflow").otherwise("balanced"))


def flow_by_entity(hours: DataFrame) -> DataFrame:
    """Operators over all hours, by gross flow."""
    names = [f"{k}_{x}" for k in ("deposit", "withdrawal", "internal") for x in ("count", "value")]
    out = hours.groupBy("entity").agg(*[(total(n) if n.endswith("value") else F.sum(n)).alias(n) for n in names], F.count(F.lit(1)).alias("hours"))
    return out.withColumn("net", (F.col("deposit_value") - F.col("withdrawal_value")).cast("decimal(38,0)")).withColumn("gross", (F.col("deposit_value") + F.col("withdrawal_value")).cast("decimal(38,0)")).orderBy(F.desc("gross"), "entity")


HOURS = f"{OPS}, r AS (SELECT chain, hour, entity, {KINDS} FROM o GROUP BY ALL)"
SUMS = ", ".join(f"sum({k}_count)::BIGINT AS {k}_count, sum({k}_value)::BIGINT AS {k}_value" for k in ("deposit", "withdrawal", "internal"))
flows_of = lambda v: classify(with_entities(canonical(v.txn, v.blk), best_labels(v.lbl)))
hours_of = lambda v: flow_rollup(v.txn, v.lbl, v.blk)
register(
    "flow_stats",
    lambda v: flow_stats(flows_of(v)),
    f"""WITH {CLS}, s AS (SELECT chain, {KINDS}, count(*) FILTER (WHERE flow_kind = 'unrelated') AS unrelated_count FROM k GROUP BY chain)
SELECT *, (deposit_value - withdrawal_value)::BIGINT AS net, CASE WHEN deposit_value > withdrawal_value THEN 'inflow' WHEN deposit_value < withdrawal_value THEN 'outflow' ELSE 'balanced' END AS direction FROM s""",
)
register(
    "flow_by_entity",
    lambda v: flow_by_entity(hours_of(v)),
    f"WITH {HOURS}, s AS (SELECT entity, {SUMS}, count(*) AS hours FROM r GROUP BY entity) SELECT *, (deposit_value - withdrawal_value)::BIGINT AS net, (deposit_value + withdrawal_value)::BIGINT AS gross FROM s",
)
register(
    "flow_totals",
    lambda v: hours_of(v).where("hour >= timestamp'1996-01-01' and hour < timestamp'1997-01-01'").groupBy("chain", "entity").agg(*[(total(f"{k}_{x}") if x == "value" else F.sum(f"{k}_{x}")).alias(f"{k}_{x}") for k in ("deposit", "withdrawal", "internal") for x in ("count", "value")]),
    f"WITH {HOURS} SELECT chain, entity, {SUMS} FROM r WHERE hour >= TIMESTAMP '1996-01-01' AND hour < TIMESTAMP '1997-01-01' GROUP BY ALL",
)
register("flow_hours", lambda v: hours_of(v).where("entity = 'NATION_13'").select("chain", "hour", "entity", "deposit_count", "deposit_value").orderBy(F.desc("hour"), "chain"), f"WITH {HOURS} SELECT chain, hour, entity, deposit_count, deposit_value FROM r WHERE entity = 'NATION_13'")
register("flow_entities", lambda v: hours_of(v).groupBy("entity").agg(F.count(F.lit(1)).alias("hours"), F.max("hour").alias("latest_hour")), f"WITH {HOURS} SELECT entity, count(*) AS hours, max(hour) AS latest_hour FROM r GROUP BY entity")
register("hour_quality", lambda v: hour_quality(v.blk), "SELECT chain, date_trunc('hour', block_time) AS hour, count(*) AS blocks, count(*) FILTER (WHERE complete) AS complete_blocks, max(capture_floor)::BIGINT AS floor FROM blk WHERE canonical GROUP BY ALL")


# Upserts, as new snapshots of a table.


def insert_new(stored: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` and the rows of ``batch`` with new keys, the first of each key."""
    return stored.unionByName(batch.dropDuplicates(key).join(stored, key, "left_anti").select(stored.columns))


def upsert_labels(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Labels by (chain, address, source): new values win, the earliest ``first_seen`` stays."""
    key = ["chain", "address", "source"]
    values = [c for c in stored.columns if c not in (*key, "first_seen")]
    new = batch.select(*key, *[F.col(c).alias(f"new_{c}") for c in (*values, "first_seen")], F.lit(True).alias("is_new"))
    both = stored.withColumn("was", F.lit(True)).join(new, key, "full_outer")
    return both.select(*key, *[F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values], F.least("first_seen", "new_first_seen").alias("first_seen"), F.when(F.col("was") & F.col("is_new"), "replaced").when(F.col("is_new"), "inserted").otherwise("kept").alias("outcome"))


def withdraw(blocks: DataFrame, heights: DataFrame) -> DataFrame:
    """Mark the given (chain, number) as no longer canonical."""
    marked = heights.select("chain", "number").distinct().withColumn("gone", F.lit(True))
    return blocks.join(marked, ["chain", "number"], "left").withColumn("canonical", F.col("canonical") & F.col("gone").isNull()).drop("gone")


register(
    "insert_idempotent",
    lambda v: insert_new(v.blk.where("number % 2 = 0").select("block_key", "tx_count"), v.blk.where("number % 3 = 0").select("block_key", "tx_count"), ["block_key"]),
    "SELECT block_key, tx_count FROM blk WHERE number % 2 = 0 OR number % 3 = 0",
)
STAMPED = "SELECT chain, address, source, entity, confidence, {0} AS first_seen FROM lbl WHERE {1}"
register(
    "upsert_replace",
    lambda v: upsert_labels(
        v.lbl.where("source <> 'src9'").select("chain", "address", "source", "entity", "confidence", F.lit(10).alias("first_seen")),
        v.lbl.where("source in ('src1', 'src9')").select("chain", "address", "source", F.lower("entity").alias("entity"), F.lit(0.75).alias("confidence"), F.lit(5).alias("first_seen")),
    ),
    """SELECT chain, address, source, CASE WHEN source IN ('src1', 'src9') THEN lower(entity) ELSE entity END AS entity, CASE WHEN source IN ('src1', 'src9') THEN 0.75e0 ELSE confidence END AS confidence,
CASE WHEN source IN ('src1', 'src9') THEN 5 ELSE 10 END AS first_seen, CASE source WHEN 'src1' THEN 'replaced' WHEN 'src9' THEN 'inserted' ELSE 'kept' END AS outcome FROM lbl""",
)
register("orphan_filter", lambda v: v.txn.where("block_number % 7 <> 0").join(v.blk.where("canonical").select("chain", F.col("number").alias("block_number")), ["chain", "block_number"], "left_anti").groupBy("chain").agg(F.count(F.lit(1)).alias("orphaned")), "SELECT t.chain, count(*) AS orphaned FROM txn t ANTI JOIN (SELECT * FROM blk WHERE canonical) b ON t.chain = b.chain AND t.block_number = b.number WHERE t.block_number % 7 <> 0 GROUP BY t.chain")
register("withdraw", lambda v: withdraw(v.blk, v.blk.where("number % 9 = 0")).groupBy("chain", "canonical").agg(F.count(F.lit(1)).alias("n")), "SELECT chain, canonical AND number % 9 <> 0 AS canonical, count(*) AS n FROM blk GROUP BY ALL")
register("forget_source", lambda v: v.lbl.where(~F.col("source").eqNullSafe("src1")), "SELECT * FROM lbl WHERE source IS DISTINCT FROM 'src1'")

# Filters, sorts, top-k.
register("window_topk", lambda v: canonical(v.txn, v.blk).where("block_number between 100 and 900 and value >= 1000000").orderBy(F.desc("value"), "tx_key").limit(50).select("tx_key", "value"), f"WITH {CANON} SELECT tx_key, value::BIGINT AS value FROM c WHERE block_number BETWEEN 100 AND 900 AND value >= 1000000 ORDER BY value DESC, tx_key LIMIT 50")
register("scan_by_height", lambda v: canonical(v.txn, v.blk).where("block_number >= 500").orderBy("block_number", "tx_index", "tx_key").select("chain", "block_number", "tx_index", "tx_key", "value"), f"WITH {CANON} SELECT chain, block_number, tx_index, tx_key, value::BIGINT AS value FROM c WHERE block_number >= 500")
register("population", lambda v: canonical(v.txn, v.blk).where("value > 0").orderBy(F.desc("value"), "tx_key").limit(1000).select("value", "tx_key"), f"WITH {CANON} SELECT value::BIGINT AS value, tx_key FROM c WHERE value > 0 ORDER BY value DESC, tx_key LIMIT 1000")


def top_per(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


register("largest", lambda v: top_per(canonical(v.txn, v.blk), ["chain"], [F.desc("value"), "tx_key"], 10).select("chain", "rank", "tx_key", "value"), f"WITH {CANON} SELECT * FROM (SELECT chain, CAST(row_number() OVER (PARTITION BY chain ORDER BY value DESC, tx_key) AS INT) AS rank, tx_key, value::BIGINT AS value FROM c) WHERE rank <= 10")
both_sides = lambda t: t.select("*", F.explode(F.array_distinct(F.array_compact(F.array("from_address", "to_address")))).alias("address"))
register(
    "activity",
    lambda v: top_per(both_sides(canonical(v.txn, v.blk)), ["address"], [F.desc("block_number"), F.desc("tx_index"), "tx_key"], 5).select("address", "rank", "tx_key", "block_number"),
    f"WITH {CANON}, s AS (SELECT from_address AS address, * FROM c UNION ALL SELECT to_address, * FROM c WHERE to_address IS NOT NULL AND to_address <> from_address) SELECT * FROM (SELECT address, CAST(row_number() OVER (PARTITION BY address ORDER BY block_number DESC, tx_index DESC, tx_key) AS INT) AS rank, tx_key, block_number FROM s) WHERE rank <= 5",
)
register("tip", lambda v: v.blk.where("canonical").groupBy("chain").agg(F.max_by("block_key", "number").alias("tip_key"), F.max("number").alias("tip_number")), "SELECT chain, max_by(block_key, number) AS tip_key, max(number) AS tip_number FROM blk WHERE canonical GROUP BY chain")
register("rank_topn", lambda v: v.candle.groupBy("symbol").agg(F.max(F.when(F.col("symbol") != "view", F.col("high"))).alias("high")).orderBy(F.desc_nulls_last("high"), "symbol").limit(4), "SELECT symbol, max(CASE WHEN symbol <> 'view' THEN high END) AS high FROM candle GROUP BY symbol ORDER BY high DESC NULLS LAST, symbol LIMIT 4")
register("label_lookup", lambda v: v.lbl.where(F.col("chain").isin("evm", "ethereum") & (F.col("address") == "s5")).orderBy(F.desc("confidence"), "source"), "SELECT * FROM lbl WHERE chain IN ('evm', 'ethereum') AND address = 's5'")
register("approvals_owner", lambda v: v.appr.where("owner = 'u7'").orderBy("block_number", "log_index").select("owner", "block_number", "log_index", "kind", "spender"), "SELECT owner, block_number, log_index, kind, spender FROM appr WHERE owner = 'u7'")


# Joins and set operations.


def floor_of(transfers: DataFrame, percentile: float = 99.5, least: int = 200) -> DataFrame:
    """Nearest-rank percentile of positive values per chain, exact; null below ``least``."""
    at = nth_values(transfers.where("value > 0"), "chain", "value", fine_log(F.col("value")), {"floor": lambda n: F.greatest(F.lit(1), F.bround(F.lit(percentile) / 100 * n))})
    return at.select("chain", F.col("all_n").alias("population"), F.when(F.col("all_n") >= least, F.col("floor")).alias("floor"))


def gate(transfers: DataFrame, floor: DataFrame, best: DataFrame) -> DataFrame:
    """Why a transfer is material: its value, else a labelled party; or that it is not."""
    joined = with_entities(transfers, best).join(F.broadcast(floor), "chain", "left")  # a row per chain: its transfers are in no single task
    reason = F.when(F.col("value") >= F.col("floor"), "VALUE").when(F.col("from_entity").isNotNull() | F.col("to_entity").isNotNull(), "LABELLED").otherwise("IMMATERIAL")
    return joined.withColumn("reason", reason)


FLOOR = "fl AS (SELECT chain, count(*) AS population, CASE WHEN count(*) >= 200 THEN min(value) FILTER (WHERE r >= m) END AS floor FROM (SELECT chain, value, row_number() OVER (PARTITION BY chain ORDER BY value) AS r, greatest(1, round_even(0.995 * count(*) OVER (PARTITION BY chain), 0)) AS m FROM c WHERE value > 0) GROUP BY chain)"
XBEST = "xb AS (SELECT * FROM best WHERE category = 'exchange')"
GATE = f"{CANON}, {BEST}, {XBEST}, {FLOOR}, g AS (SELECT c.*, CASE WHEN c.value >= fl.floor THEN 'VALUE' WHEN f.entity IS NOT NULL OR t.entity IS NOT NULL THEN 'LABELLED' ELSE 'IMMATERIAL' END AS reason FROM c LEFT JOIN fl USING (chain) LEFT JOIN xb f ON c.from_address = f.address LEFT JOIN xb t ON c.to_address = t.address)"
exchanges = lambda v: best_labels(v.lbl).where("category = 'exchange'")
gated = lambda v: gate(canonical(v.txn, v.blk), floor_of(canonical(v.txn, v.blk)), exchanges(v))
register("floor", lambda v: floor_of(canonical(v.txn, v.blk)), f"WITH {CANON}, {FLOOR} SELECT chain, population, floor::BIGINT AS floor FROM fl")
register("gate", lambda v: gated(v).select("tx_key", "reason"), f"WITH {GATE} SELECT tx_key, reason FROM g")
register(
    "filter_stats",
    lambda v: gated(v).groupBy("chain").agg(F.count(F.lit(1)).alias("seen"), count_if(F.col("reason") != "IMMATERIAL").alias("kept"), total("value", F.col("reason") != "IMMATERIAL").alias("kept_value")).withColumn("kept_share", F.round(F.col("kept") / F.col("seen"), 9)),
    f"WITH {GATE} SELECT *, round(kept / seen, 9) AS kept_share FROM (SELECT chain, count(*) AS seen, count(*) FILTER (WHERE reason <> 'IMMATERIAL') AS kept, coalesce(sum(value) FILTER (WHERE reason <> 'IMMATERIAL'), 0)::BIGINT AS kept_value FROM g GROUP BY chain)",
)


def party_flow(transfers: DataFrame, best: DataFrame, category: str) -> DataFrame:
    """Transfers into and out of labelled operators of a category; between two of them does not count."""
    joined = with_entities(transfers, best.where(F.col("category") == category))
    a, b = F.col("from_entity").isNotNull(), F.col("to_entity").isNotNull()
    one = joined.where(a != b).withColumn("entity", F.coalesce("from_entity", "to_entity"))
    return one.groupBy("entity").agg(count_if(F.col("to_entity").isNotNull()).alias("in_count"), total("value", F.col("to_entity").isNotNull()).alias("in_value"), count_if(F.col("from_entity").isNotNull()).alias("out_count"), total("value", F.col("from_entity").isNotNull()).alias("out_value"))


def party_sql(category: str) -> str:
    return f"""WITH {CANON}, {BEST}, b AS (SELECT * FROM best WHERE category = '{category}'), j AS (SELECT c.value, f.entity AS fe, t.entity AS te FROM c LEFT JOIN b f ON c.from_address = f.address LEFT JOIN b t ON c.to_address = t.address)
SELECT coalesce(fe, te) AS entity, count(te) AS in_count, coalesce(sum(value) FILTER (WHERE te IS NOT NULL), 0)::BIGINT AS in_value, count(fe) AS out_count, coalesce(sum(value) FILTER (WHERE fe IS NOT NULL), 0)::BIGINT AS out_value
FROM j WHERE (fe IS NULL) <> (te IS NULL) GROUP BY 1"""


register("bridge_flow", lambda v: party_flow(canonical(v.txn, v.blk), best_labels(v.lbl), "bridge"), party_sql("bridge"))
register("mining_flow", lambda v: party_flow(canonical(v.txn, v.blk), best_labels(v.lbl), "mining_pool"), party_sql("mining_pool"))
register(
    "counterparty_union",
    lambda v: canonical(v.txn, v.blk).where("to_address is not null").select(F.explode(F.array(F.struct(F.col("from_address").alias("a"), F.col("to_address").alias("b")), F.struct(F.col("to_address").alias("a"), F.col("from_address").alias("b")))).alias("p")).select("p.*").distinct().groupBy(F.col("a").alias("address")).agg(F.count(F.lit(1)).alias("counterparties")),
    f"WITH {CANON}, u AS (SELECT from_address AS a, to_address AS b FROM c WHERE to_address IS NOT NULL UNION SELECT to_address, from_address FROM c WHERE to_address IS NOT NULL) SELECT a AS address, count(*) AS counterparties FROM u GROUP BY a",
)
register(
    "keyword_contracts",
    lambda v: top_per(with_entities(canonical(v.txn, v.blk), best_labels(v.lbl).where("category = 'contract' and lower(entity) rlike '[13579]$'")).where("to_entity is not null").groupBy("from_address", "to_entity").agg(F.count(F.lit(1)).alias("n"), total("value").alias("total")), ["from_address"], [F.desc("n"), "to_entity"], 10).drop("rank"),
    f"WITH {ENT} SELECT from_address, to_entity, n, total FROM (SELECT *, row_number() OVER (PARTITION BY from_address ORDER BY n DESC, to_entity) AS r FROM (SELECT from_address, to_entity, count(*) AS n, sum(value)::BIGINT AS total FROM e WHERE to_category = 'contract' AND regexp_matches(lower(to_entity), '[13579]$') GROUP BY ALL)) WHERE r <= 10",
)
register(
    "cross_chain",
    lambda v: both_sides(canonical(v.txn, v.blk)).groupBy("address", "chain").agg(F.count(F.lit(1)).alias("n")).groupBy("address").agg(F.count(F.lit(1)).alias("chains"), F.sum("n").alias("transfers"), F.max("n").alias("most_on_one")).where("chains > 1"),
    f"WITH {CANON}, s AS (SELECT from_address AS address, chain, tx_key FROM c UNION ALL SELECT to_address, chain, tx_key FROM c WHERE to_address IS NOT NULL AND to_address <> from_address), p AS (SELECT address, chain, count(*) AS n FROM s GROUP BY ALL) SELECT address, count(*) AS chains, sum(n)::BIGINT AS transfers, max(n) AS most_on_one FROM p GROUP BY address HAVING count(*) > 1",
)
