"""Links between subjects, consensus and evidence."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register
from .ledger import BEST, CANON, best_labels, canonical, count_if
from .windows import asof


# How far each kind of link is trusted.
TRUST = {"counterparty": 0.6, "co_spend": 0.8, "mih": 0.7, "bridge_linked": 0.65, "entity": 0.8, "exchange": 0.85, "github": 0.75, "social": 0.6, "shared_pattern": 0.5}


def link_rows(pairs: DataFrame, kind: str, relation: Column | None = None) -> DataFrame:
    """``a, b, confidence, relation, evidence``: pairs (``x, y, evidence``) in order of name, each once a relation, with the least evidence."""
    least = F.min("evidence")
    if dict(pairs.dtypes)["evidence"] == "binary":  # keys in half their length until they are handed on
        least = F.concat(F.lit("0x"), F.lower(F.hex(least)))
    named = pairs.where("x is not null and y is not null and x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *([] if relation is None else [relation.alias("relation")]), "evidence")
    each = named.groupBy("a", "b", *([] if relation is None else ["relation"])).agg(least.alias("evidence"))
    return each.select("a", "b", F.lit(TRUST[kind]).alias("confidence"), (F.lit(kind) if relation is None else F.col("relation")).alias("relation"), "evidence")


def stars(members: DataFrame) -> DataFrame:
    """Pairs of each member of a group (``key, node``) with the least one: as many as members, however large a group is."""
    hub = members.groupBy("key").agg(F.min("node").alias("x"))
    return members.distinct().join(hub, "key").select("x", F.col("node").alias("y"), F.col("key").alias("evidence"))


def patterns(transfers: DataFrame) -> DataFrame:
    """``key, node``: senders by how often, where and over how long they send."""
    span = F.expr("(max(block_number) - min(block_number)) div 400")
    sums = transfers.groupBy("from_address").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chain").alias("chains"), span.alias("span"))
    return sums.select(F.concat_ws("/", F.expr("n div 4").cast("string"), F.col("chains").cast("string"), F.col("span").cast("string")).alias("key"), F.col("from_address").alias("node"))


def bridge_pairs(outs: DataFrame, ins: DataFrame, days: int = 3) -> DataFrame:
    """Pairs of who sends into a bridge and who receives on another chain: ``leg`` (a number of its own, below 2^53), ``chain, address, amount`` key, ``at``.

    Each arrival takes the latest departure of its amount on each other chain, no
    more than ``days`` earlier (ties: the greatest number): as-of joins by
    ranges of time, so a common amount is no single task.
    """
    chains = outs.select("amount", F.col("chain").alias("from_chain")).distinct()  # of an amount, a row a chain
    asks = ins.join(chains, "amount").where("chain <> from_chain").select(F.concat_ws("|", F.col("amount").cast("string"), "from_chain").alias("symbol"), F.col("leg").alias("point_id"), F.col("at").alias("at_time"))
    gone = outs.select(F.concat_ws("|", F.col("amount").cast("string"), "chain").alias("symbol"), F.col("at").alias("open_time"), F.col("leg").cast("double").alias("close"))
    met = asof(asks, gone, "1 day").where("price is not null").select("point_id", "at_time", F.col("price").cast("long").alias("out_leg"))
    both = met.join(outs.select(F.col("leg").alias("out_leg"), F.col("address").alias("x"), F.col("at").alias("out_at")), "out_leg").join(ins.select(F.col("leg").alias("point_id"), F.col("address").alias("y")), "point_id")
    late = F.unix_micros(F.col("at_time").cast("timestamp")) - F.unix_micros(F.col("out_at").cast("timestamp"))
    return both.where(late <= days * 86_400_000_000).select("x", "y", F.concat_ws(":", F.lit("legs"), F.col("out_leg").cast("string"), F.col("point_id").cast("string")).alias("evidence"))


def linkers(transfers: DataFrame, labels: DataFrame, spends: DataFrame | None = None, inputs: DataFrame | None = None, outs: DataFrame | None = None, ins: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """All links between addresses and what identifies them, with the evidence of each.

    From ``transfers`` (``tx_key`` as text, or as the bytes that it spells in hexadecimal):
    counterparties, deposits at labelled exchanges, shared patterns of senders.  From ``labels``: the entity of an address.  From groups
    ``key, node``: ``spends`` of one transaction, ``inputs`` of one transfer.  From
    the legs of bridges: departures and arrivals that fit.  From ``profiles``
    (``address, github, platform, handle``): accounts of their owners.  Groups are
    linked as stars around their least member, never as all pairs.
    """
    direct = transfers.select(F.col("from_address").alias("x"), F.col("to_address").alias("y"), F.col("tx_key").alias("evidence"))
    named = labels.select(F.col("address").alias("x"), F.concat(F.lit("entity:"), "entity").alias("y"), F.concat(F.lit("label:"), "source").alias("evidence"))
    markets = labels.where("category = 'exchange'").select(F.col("address").alias("y"), "entity")
    deposits = direct.join(markets, "y")
    found = [link_rows(direct, "counterparty"), link_rows(named, "entity", F.lit("entity_name")), link_rows(deposits, "exchange", F.concat(F.lit("exchange_"), "entity")), link_rows(stars(patterns(transfers)), "shared_pattern")]
    found += [link_rows(stars(g), kind) for g, kind in ((spends, "co_spend"), (inputs, "mih")) if g is not None]
    if outs is not None and ins is not None:
        found.append(link_rows(bridge_pairs(outs, ins), "bridge_linked"))
    if profiles is not None:
        found.append(link_rows(profiles.select(F.col("address").alias("x"), F.concat(F.lit("github:"), "github").alias("y"), F.lit("profile").alias("evidence")), "github"))
        found.append(link_rows(profiles.select(F.col("address").alias("x"), F.concat_ws(":", "platform", F.when(F.col("handle").isNotNull(), F.col("handle"))).alias("y"), F.lit("profile").alias("evidence"), "platform", "handle").where("platform is not null and handle is not null"), "social", F.concat(F.lit("social_"), "platform")))
    return functools.reduce(DataFrame.unionByName, found)


#: Stand-ins for what the tables lack: transactions with several inputs, legs of bridges, profiles.
SPENDS = "SELECT DISTINCT concat('tx:', block_number, ':', token) AS key, from_address AS node FROM ttx"
INPUTS = "SELECT DISTINCT concat('in:', CAST(floor(block_number / 24) AS BIGINT), ':', to_address) AS key, from_address AS node FROM ttx"
LEGS = "SELECT (((c.okey * 8 + c.tx_index) * 1024 + c.skey) * 32768 + c.pkey) * 2 + c.dup - 1 AS leg, c.chain, c.from_address AS address, CAST(c.value AS BIGINT) {div} 100000 AS amount, c.happened_at AS at FROM c JOIN best ON best.address = c.to_address AND best.category = 'bridge' WHERE c.tx_index % 2 = {odd}"
PROFILES = "SELECT concat('c', c_custkey) AS address, CASE WHEN c_custkey % 9 = 0 THEN concat('dev', c_custkey {div} 18) END AS github, CASE WHEN c_custkey % 5 = 0 THEN 'x' WHEN c_custkey % 7 = 0 THEN 'forum' END AS platform, CASE WHEN c_custkey % 10 <> 5 THEN concat('h', c_custkey {div} 20) END AS handle FROM customer"


def all_links(v) -> DataFrame:
    from .graph import written

    # Five kinds of links read the transfers; what names one is its digest, in 16 bytes.
    c = written(canonical(v.txn, v.blk).withColumn("tx_key", F.unhex(F.substring("tx_key", 3, 32))))
    best = best_labels(v.lbl)
    legs = lambda odd: v.spark.sql(LEGS.format(div="DIV", odd=odd).replace("FROM c ", "FROM {c} c ").replace("JOIN best ON", "JOIN {best} best ON"), c=c, best=best)
    ttx = lambda sql: v.spark.sql(sql.replace("FROM ttx", "FROM {ttx}"), ttx=v.ttx)
    return linkers(c, best, ttx(SPENDS), ttx(INPUTS), legs(0), legs(1), v.spark.sql(PROFILES.format(div="DIV").replace("FROM customer", "FROM {customer}"), customer=v.customer))


LINKS = f"""{CANON}, {BEST}, p0 AS (SELECT from_address AS x, to_address AS y, tx_key AS e, 0.6::DOUBLE AS confidence, 'counterparty' AS relation FROM c
UNION ALL SELECT address, 'entity:' || entity, 'label:' || source, 0.8::DOUBLE, 'entity_name' FROM best
UNION ALL SELECT c.from_address, c.to_address, c.tx_key, 0.85::DOUBLE, 'exchange_' || entity FROM c JOIN best ON address = c.to_address AND category = 'exchange'
UNION ALL SELECT min(node) OVER (PARTITION BY key), node, key, 0.5::DOUBLE, 'shared_pattern' FROM (SELECT concat_ws('/', count(*) // 4, count(DISTINCT chain), (max(block_number) - min(block_number)) // 400) AS key, from_address AS node FROM c GROUP BY from_address)
UNION ALL SELECT min(node) OVER (PARTITION BY key), node, key, 0.8::DOUBLE, 'co_spend' FROM ({SPENDS})
UNION ALL SELECT min(node) OVER (PARTITION BY key), node, key, 0.7::DOUBLE, 'mih' FROM ({INPUTS})
UNION ALL SELECT x, y, concat('legs:', lo, ':', li), 0.65::DOUBLE, 'bridge_linked' FROM (SELECT i.leg AS li, arg_max(o.leg, (o.at, o.leg)) AS lo, arg_max(o.address, (o.at, o.leg)) AS x, any_value(i.address) AS y, any_value(i.at) AS arrived, max(o.at) AS oat FROM ({LEGS.format(div='//', odd=1)}) i JOIN ({LEGS.format(div='//', odd=0)}) o ON o.amount = i.amount AND o.chain <> i.chain AND o.at <= i.at GROUP BY i.leg, o.chain) WHERE arrived - oat <= INTERVAL 3 DAYS
UNION ALL SELECT address, 'github:' || github, 'profile', 0.75::DOUBLE, 'github' FROM ({PROFILES.format(div='//')})
UNION ALL SELECT address, platform || ':' || handle, 'profile', 0.6::DOUBLE, 'social_' || platform FROM ({PROFILES.format(div='//')})),
links AS (SELECT least(x, y) AS a, greatest(x, y) AS b, confidence, relation, min(e) AS evidence FROM p0 WHERE x <> y GROUP BY ALL)"""
register("linkers", all_links, f"WITH {LINKS} SELECT * FROM links")


def consensus(checks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Weighted share of the checks that confirm each claim."""
    share = F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0.0)) / F.sum("weight")
    return checks.groupBy("claim").agg(F.count(F.lit(1)).alias("checks"), F.round(share, 8).alias("agreement"), F.bool_and("ok").alias("unanimous")).withColumn("consensus", F.col("agreement") >= threshold)


register("consensus", lambda v: consensus(v.evalcase.select(F.col("detector").alias("claim"), F.col("label").alias("ok"), (F.col("confidence") + 0.1).alias("weight"))), "SELECT *, agreement >= 0.5 AS consensus FROM (SELECT detector AS claim, count(*) AS checks, round(sum(CASE WHEN label THEN confidence + 0.1 ELSE 0 END) / sum(confidence + 0.1), 8) AS agreement, bool_and(label) AS unanimous FROM evalcase GROUP BY detector)")


register("heuristics", lambda v: v.lbl.groupBy("entity", "category").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best")).groupBy("entity").agg(F.max_by("category", F.struct("n", "best", "category")).alias("category"), F.round(F.max("best") * F.max("n") / F.sum("n"), 9).alias("confidence")), "WITH g AS (SELECT entity, category, count(*) AS n, max(confidence) AS best FROM lbl GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, best DESC, category DESC) AS r FROM g) SELECT entity, max(category) FILTER (WHERE r = 1) AS category, round(max(best) * max(n) / sum(n), 9) AS confidence FROM k GROUP BY entity")
