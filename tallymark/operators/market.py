"""Measured impact of events on assets: scans, pairing of assets, analogs, exports; merging of skills and lineage of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register
from .graph import written
from .ledger import CANON, best_labels, canonical
from .windows import first_mover, interval_cv


def impact_scan(impacts: DataFrame, asset: str | None = None, category: str | None = None, limit: int = 100) -> DataFrame:
    """The newest impact events of an asset or category."""
    some = impacts
    if asset is not None:
        some = some.where(F.col("asset") == asset)
    if category is not None:
        some = some.where(F.col("category") == category)
    return some.orderBy(F.desc("first_seen"), "event_id").limit(limit)


def nearest_other(impacts: DataFrame, hours: int = 24) -> DataFrame:
    """``asset_a, asset_b, event_a, return_a, return_b``: each event with the nearest one of every other asset, less than ``hours`` away (ties: the earlier).

    Inside an hour the neighbours are found in order of time; beyond it, only the
    last and the first event of an hour can be nearest, so an hour hands on two
    rows and no task sees more than an hour of an asset or all hours of a pair.
    """
    each = impacts.select("asset", "event_id", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("t"), "measured_return").withColumn("hour", F.expr("t div 3600000000"))
    assets = each.select("asset").distinct()  # one row per asset
    point = F.struct("t", "event_id", "measured_return")
    tasks = each.select("asset", "hour", point.alias("p"))
    mine = tasks.select(F.col("asset").alias("asset_a"), "hour", "p", F.lit(None).cast(tasks.schema["p"].dataType).alias("q")).join(assets.withColumnRenamed("asset", "asset_b"), F.col("asset_a") != F.col("asset_b"))
    theirs = tasks.select(F.col("asset").alias("asset_b"), "hour", F.lit(None).cast(tasks.schema["p"].dataType).alias("p"), F.col("p").alias("q")).join(assets.withColumnRenamed("asset", "asset_a"), F.col("asset_a") != F.col("asset_b"))
    both = mine.unionByName(theirs).withColumn("at", F.coalesce("p", "q")).withColumn("own", F.col("p").isNotNull())
    # Of events at one moment the least is last, both ways; both frames only grow, so an hour costs its sort.
    hour = Window.partitionBy("asset_a", "asset_b", "hour").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda time: F.last("q", ignorenulls=True).over(hour.orderBy(time, F.col("own"), F.desc("at.event_id")))
    inside = both.select("*", so_far(F.asc("at.t")).alias("before"), so_far(F.desc("at.t")).alias("after")).where("own")
    ends = each.groupBy(F.col("asset").alias("asset_b"), F.col("hour").alias("h")).agg(F.min(point).alias("first"), F.max_by(point, F.struct("t", -F.col("event_id"))).alias("last"))
    hours_of = each.select(F.col("asset").alias("asset_a"), "hour").distinct()
    reach = hours_of.select("asset_a", "hour", F.explode(F.sequence(F.col("hour") - hours, F.col("hour") + hours)).alias("h")).where("h <> hour").join(ends, "h").where("asset_a <> asset_b")
    reach = reach.groupBy("asset_a", "asset_b", "hour").agg(F.max(F.when(F.col("h") < F.col("hour"), F.col("last"))).alias("back"), F.min(F.when(F.col("h") > F.col("hour"), F.col("first"))).alias("forth"))
    far = inside.join(reach, ["asset_a", "asset_b", "hour"], "left")
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("p.t")).alias("gap"), F.col(f"{c}.t").alias("t"), F.col(f"{c}.event_id").alias("id"), F.col(f"{c}.measured_return").alias("r")))
    near = F.array_min(F.array_compact(F.array(*[gap(c) for c in ("before", "after", "back", "forth")])))
    out = far.select("asset_a", "asset_b", F.col("p.event_id").alias("event_a"), F.col("p.measured_return").alias("return_a"), near.alias("n"))
    return out.where(F.col("n.gap") < hours * 3_600_000_000).select("asset_a", "asset_b", "event_a", "return_a", F.col("n.r").alias("return_b"))


def correlations(pairs: DataFrame, least: int = 5) -> DataFrame:
    """``asset_a, asset_b, n, corr`` of paired returns; null below ``least`` pairs."""
    return pairs.groupBy("asset_a", "asset_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("return_a", "return_b"), 6).alias("corr")).withColumn("corr", F.when(F.col("n") >= least, F.col("corr")))


def propagate(predictions: DataFrame, corr: DataFrame, least: float = 0.5) -> DataFrame:
    """Predictions ``asset, direction, probability, mean_pct`` carried over to correlated assets; a negative correlation turns them round."""
    turned = F.when(F.col("direction") == "up", "down").when(F.col("direction") == "down", "up").otherwise("flat")
    both = predictions.join(corr, F.col("asset") == F.col("asset_a")).where(F.abs("corr") >= least)
    return both.select("asset", F.col("asset_b").alias("to_asset"), F.when(F.col("corr") > 0, F.col("direction")).otherwise(turned).alias("direction"), F.round(F.col("probability") * F.abs("corr"), 3).alias("probability"), F.round(F.col("mean_pct") * F.col("corr"), 4).alias("expected_pct"), F.when(F.abs("corr") < 0.7, "low").otherwise("medium").alias("confidence"))


TRUE = ["confirmed_true", "likely_true"]


def closest(narratives: DataFrame, impacts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Narratives with their kind, and for each kind the ``k`` most similar events with ``score`` (ties: the older event).

    What counts of an event is its class (category, tenth of attention, whether
    it was true), of which there are ten a category, and whether its asset is the
    narrative's.  So the ``k`` oldest events of each class meet the kinds, and
    those of each class of an asset meet the kinds that name it.
    """
    level = lambda c: F.least(F.lit(4), F.expr(f"cast({c} as int) div 20"))
    events = impacts.select("event_id", "measured_return", "category", level("fomo_score").alias("bucket"), F.col("status").isin(TRUE).alias("good"), "asset")
    oldest = lambda *cls: events.select("*", F.row_number().over(Window.partitionBy(*cls).orderBy("event_id")).alias("r")).where(F.col("r") <= k)
    mine = narratives.withColumns({"n_category": F.col("category"), "n_bucket": level("fomo_score"), "n_type": F.coalesce("entity_type", F.lit(""))})
    kinds = mine.select("n_category", "n_bucket", "n_type").distinct()
    cls = ["category", "bucket", "good"]
    any_asset = kinds.join(F.broadcast(oldest(*cls)), F.lit(True))  # ten times k rows a category, and categories are those of a list of rules
    own_asset = kinds.join(oldest(*cls, "asset"), F.col("asset") == F.col("n_type"))
    # Points of a tenth, kept whole.
    score = (
        F.when(F.col("category") == F.col("n_category"), 5).when(F.col("n_category") == "general", 2).otherwise(0) + F.greatest(F.lit(0), 3 - F.abs(F.col("bucket") - F.col("n_bucket"))) + F.when(F.col("good"), 1).otherwise(0) + F.when(F.col("asset") == F.col("n_type"), 1).otherwise(0)
    )
    kind = ["n_category", "n_bucket", "n_type"]
    met = any_asset.unionByName(own_asset).withColumn("score", F.least(F.lit(10), score)).dropDuplicates([*kind, "event_id"])
    top = met.select("*", F.row_number().over(Window.partitionBy(*kind).orderBy(F.desc("score"), "event_id")).alias("nth")).where((F.col("nth") <= k) & (F.col("score") > 0))
    return mine, top.select(*kind, "event_id", "measured_return", "score")


def analogs(narratives: DataFrame, impacts: DataFrame, k: int = 3) -> DataFrame:
    """``narrative, mean, used, similarity``: the ``k`` most similar events of each narrative and their weighted return."""
    mine, top = closest(narratives, impacts, k)
    kind = ["n_category", "n_bucket", "n_type"]
    found = top.groupBy(*kind).agg(F.round(F.sum(F.col("measured_return") * F.col("score")) / F.sum("score"), 3).alias("mean"), F.count(F.lit(1)).alias("used"), F.round(F.avg("score") / 10, 3).alias("similarity"))
    return mine.join(found, kind).select("narrative", "mean", "used", "similarity")


def training_rows(impacts: DataFrame, narratives: DataFrame, least: float = 0.6) -> DataFrame:
    """Resolved events joined to their narrative, as labelled rows; unresolved or unsure ones are left out."""
    label = F.when(F.col("status").isin(TRUE), 1).when(F.col("status").isin("confirmed_false", "likely_false"), 0)
    return impacts.join(narratives.select("narrative", "title", "confidence"), "narrative").where(F.col("confidence") >= least).select("event_id", "narrative", "title", "asset", "measured_return", label.alias("label")).where("label is not null")


def narrative_items(narratives: DataFrame, items: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each narrative with its items, and each item with the entities that it mentions, both in order."""
    named = mentions.groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("entities"))
    each = items.join(named, "item", "left").select("narrative", F.struct("item", F.coalesce("entities", F.lit("")).alias("entities")).alias("x"))
    got = each.groupBy("narrative").agg(F.array_sort(F.collect_list("x")).alias("items"))
    return narratives.join(got, "narrative", "left").select("narrative", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.array_join(F.transform("items", lambda x: F.concat(x["item"].cast("string"), F.lit(":"), x["entities"])), ";").alias("items"))


def composite_merge(outputs: DataFrame) -> DataFrame:
    """Skill outputs ``subject, key, value, rank, coverage`` merged: the first writer (least rank) wins, conflicts are flagged, the weakest coverage stays."""
    return outputs.groupBy("subject", "key").agg(F.min_by("value", F.struct("rank", "value")).alias("value"), (F.count_distinct("value") > 1).alias("conflict"), F.min("coverage").alias("coverage"))


def lineage(nodes: DataFrame, edges: DataFrame, limit: int = 64) -> DataFrame:
    """``node, ancestors, roots, grounded``: how many nodes and roots lie above each node of ``edges (node, parent)``.

    Grounded: all roots above (or the node itself, if a root) are ``observed``.
    Paths double in each turn; a cycle raises.
    """
    known = reach = written(edges.select("node", F.col("parent").alias("above")).distinct())
    for _ in range(limit):
        # reach: pairs exactly as far apart as known goes, so no turn joins all pairs with all.
        far = reach.select(F.col("node").alias("above"), F.col("above").alias("far"))
        longer = lambda pairs: pairs.join(far, "above").select("node", F.col("far").alias("above"))  # noqa: E731, B023
        more = written(known.union(longer(known)).distinct())
        if not more.where("node = above").isEmpty():
            raise ValueError("evidence supports itself")
        reach, known = written(longer(reach).distinct()), more
        if reach.isEmpty():
            break
    root = nodes.join(edges.select("node").distinct(), "node", "left_anti").select(F.col("node").alias("above"), "observed")
    every = known.union(nodes.select("node", F.col("node")))
    roots = every.join(root, "above").groupBy("node").agg(F.count(F.lit(1)).alias("roots"), F.bool_and("observed").alias("grounded"))
    return nodes.select("node").join(known.groupBy("node").agg(F.count(F.lit(1)).alias("ancestors")), "node", "left").join(roots, "node", "left").select("node", F.coalesce("ancestors", F.lit(0)).alias("ancestors"), "roots", "grounded")


def smart_money(transfers: DataFrame, labels: DataFrame) -> DataFrame:
    """Each sender with its label, first-mover score and regularity; unlabelled senders keep null."""
    early, regular = first_mover(transfers), interval_cv(transfers)
    return regular.join(early.withColumnRenamed("actor", "from_address"), "from_address", "left").join(labels.select(F.col("address").alias("from_address"), "entity"), "from_address", "left").select("from_address", "entity", "n", "gap_cv", "score")


def attribution(labels: DataFrame) -> DataFrame:
    """Entity of each address, the tier of the claim and what else it may be."""
    best = best_labels(labels)
    tier = F.when((F.col("status") == "verified") & (F.col("confidence") >= 0.9), "confirmed").when(F.col("confidence") >= 0.7, "probable").otherwise("possible")
    other = labels.join(best.select("address", F.col("category").alias("best")), "address").where("category <> best").groupBy("address").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("alternatives"))
    return best.select("address", "entity", "category", tier.alias("tier")).join(other, "address", "left").withColumn("alternatives", F.coalesce("alternatives", F.lit("")))


narrative_rows = lambda v: v.documents.selectExpr("doc_id AS narrative", "substring(text, 1, 80) AS title", "CASE doc_id % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'hack' WHEN 2 THEN 'listing' ELSE 'regulation' END AS category", "doc_id % 101 AS fomo_score", "CASE doc_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' END AS entity_type", "CAST(doc_id % 11 AS DOUBLE) / 10 AS confidence")
NARR = "n AS (SELECT doc_id AS narrative, substring(text, 1, 80) AS title, CASE doc_id % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'hack' WHEN 2 THEN 'listing' ELSE 'regulation' END AS category, doc_id % 101 AS fomo_score, CASE doc_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' END AS entity_type, CAST(doc_id % 11 AS DOUBLE) / 10 AS confidence FROM documents)"
PAIRS = "p AS (SELECT a.asset AS asset_a, b.asset AS asset_b, a.event_id, a.measured_return AS ra, b.measured_return AS rb FROM impact a JOIN impact b ON a.asset <> b.asset AND abs(epoch_us(a.first_seen) - epoch_us(b.first_seen)) < 86400000000 QUALIFY row_number() OVER (PARTITION BY a.event_id, b.asset ORDER BY abs(epoch_us(a.first_seen) - epoch_us(b.first_seen)), b.first_seen, b.event_id) = 1), co AS (SELECT asset_a, asset_b, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(corr(ra, rb), 6) END AS corr FROM p GROUP BY ALL)"
register("impact_scan", lambda v: impact_scan(v.impact, "click", None, 50).select("event_id", "category", "measured_return"), "SELECT event_id, category, measured_return FROM impact WHERE asset = 'click' ORDER BY first_seen DESC, event_id LIMIT 50")
register("nearest_join", lambda v: correlations(nearest_other(v.impact)), f"WITH {PAIRS} SELECT * FROM co")
said = lambda v: v.spark.createDataFrame([("click", "up", 0.6, 2.0), ("view", "down", 0.7, -1.5)], "asset string, direction string, probability double, mean_pct double")
register("propagate", lambda v: propagate(said(v), correlations(nearest_other(v.impact)), 0.01), f"""WITH {PAIRS}, s(asset, direction, probability, mean_pct) AS (VALUES ('click', 'up', 0.6::DOUBLE, 2.0::DOUBLE), ('view', 'down', 0.7::DOUBLE, -1.5::DOUBLE))
SELECT asset, asset_b AS to_asset, CASE WHEN corr > 0 THEN direction WHEN direction = 'up' THEN 'down' ELSE 'up' END AS direction, round(probability * abs(corr), 3) AS probability, round(mean_pct * corr, 4) AS expected_pct, CASE WHEN abs(corr) < 0.7 THEN 'low' ELSE 'medium' END AS confidence FROM s JOIN co ON asset = asset_a WHERE abs(corr) >= 0.01""")
register("analogs", lambda v: analogs(narrative_rows(v), v.impact), f"""WITH {NARR}, s AS (SELECT narrative, event_id, measured_return, least(10, CASE WHEN i.category = n.category THEN 5 WHEN n.category = 'general' THEN 2 ELSE 0 END + greatest(0, 3 - abs(least(4, i.fomo_score // 20) - least(4, n.fomo_score // 20))) + CASE WHEN status IN ('confirmed_true', 'likely_true') THEN 1 ELSE 0 END + CASE WHEN asset = entity_type THEN 1 ELSE 0 END) AS score FROM n, impact i),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY narrative ORDER BY score DESC, event_id) <= 3) SELECT narrative, round(sum(measured_return * score) / sum(score), 3) AS mean, count(*) AS used, round(avg(score) / 10, 3) AS similarity FROM t WHERE score > 0 GROUP BY narrative""")
told = lambda v: v.impact.withColumn("narrative", F.col("event_id") % 300)
register("training_export", lambda v: training_rows(told(v), narrative_rows(v)).select("event_id", "narrative", "asset", "measured_return", "label"), f"WITH {NARR} SELECT event_id, narrative, asset, measured_return, CASE WHEN status IN ('confirmed_true', 'likely_true') THEN 1 ELSE 0 END AS label FROM impact JOIN n ON narrative = event_id % 300 WHERE confidence >= 0.6 AND status <> 'unverified'")
register("narrative_items", lambda v: narrative_items(v.documents.select(F.col("doc_id").alias("narrative")), v.impact.select((F.col("event_id") % 300).alias("narrative"), F.col("event_id").alias("item")), v.impact.where("event_id % 2 = 0").select(F.col("event_id").alias("item"), F.explode(F.array("asset", "category")).alias("entity"))), """WITH m AS (SELECT event_id AS item, CASE WHEN asset < category THEN concat(asset, ',', category) ELSE concat(category, ',', asset) END AS entities FROM impact WHERE event_id % 2 = 0), x AS (SELECT event_id % 300 AS narrative, event_id AS item, coalesce(entities, '') AS entities FROM impact LEFT JOIN m ON event_id = item)
SELECT d.doc_id AS narrative, count(x.item)::INT AS n_items, string_agg(concat(x.item, ':', x.entities), ';' ORDER BY x.item) FILTER (WHERE x.item IS NOT NULL) AS items FROM documents d LEFT JOIN x ON x.narrative = d.doc_id GROUP BY d.doc_id""")
register("composite_merge", lambda v: composite_merge(v.lbl.selectExpr("address AS subject", "'entity' AS key", "entity AS value", "1 AS rank", "confidence AS coverage").unionByName(v.lbl.selectExpr("address AS subject", "'category' AS key", "category AS value", "CASE source WHEN 'src9' THEN 2 ELSE 1 END AS rank", "confidence AS coverage"))), """WITH o AS (SELECT address AS subject, 'entity' AS key, entity AS value, 1 AS rank, confidence AS coverage FROM lbl UNION ALL SELECT address, 'category', category, CASE source WHEN 'src9' THEN 2 ELSE 1 END, confidence FROM lbl)
SELECT subject, key, first(value ORDER BY rank, value) AS value, count(DISTINCT value) > 1 AS conflict, min(coverage) AS coverage FROM o GROUP BY ALL""")
register("evidence_lineage", lambda v: lineage(v.part.selectExpr("p_partkey AS node", "p_size % 2 = 0 AS observed"), v.part.selectExpr("p_partkey AS node", "explode(array(p_partkey div 3, p_partkey div 5)) AS parent").where("parent > 2").distinct()), """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS node, unnest([p_partkey // 3, p_partkey // 5]) AS parent FROM part), d AS (SELECT * FROM e WHERE parent > 2), a AS (SELECT node, parent AS above FROM d UNION SELECT a.node, d.parent FROM a JOIN d ON d.node = a.above),
r AS (SELECT p_partkey AS node, p_size % 2 = 0 AS observed FROM part WHERE p_partkey NOT IN (SELECT node FROM d)), s AS (SELECT * FROM a UNION ALL SELECT p_partkey, p_partkey FROM part)
SELECT p_partkey AS node, (SELECT count(*) FROM a WHERE a.node = p_partkey) AS ancestors, count(r.node) AS roots, bool_and(r.observed) AS grounded FROM part LEFT JOIN s ON s.node = p_partkey LEFT JOIN r ON r.node = s.above GROUP BY p_partkey""")
register("attribution", lambda v: attribution(v.lbl), """WITH b AS (SELECT * FROM lbl QUALIFY row_number() OVER (PARTITION BY address ORDER BY confidence DESC, source, category) = 1), o AS (SELECT l.address, string_agg(DISTINCT l.category, ',' ORDER BY l.category) AS alternatives FROM lbl l JOIN b USING (address) WHERE l.category <> b.category GROUP BY l.address)
SELECT b.address, entity, category, CASE WHEN status = 'verified' AND confidence >= 0.9 THEN 'confirmed' WHEN confidence >= 0.7 THEN 'probable' ELSE 'possible' END AS tier, coalesce(alternatives, '') AS alternatives FROM b LEFT JOIN o USING (address)""")
register("smart_money", lambda v: smart_money(canonical(v.txn, v.blk), best_labels(v.lbl)).select("from_address", "entity", "n", "gap_cv", "score"), f"""WITH {CANON}, g AS (SELECT from_address, block_number - lag(block_number) OVER (PARTITION BY from_address ORDER BY block_number, tx_key) AS gap FROM c), a AS (SELECT from_address, count(*) AS n, round(stddev_pop(gap) / nullif(avg(gap), 0), 7) AS gap_cv FROM g GROUP BY from_address),
t AS (SELECT to_address AS party, from_address AS actor, min(block_number) AS f FROM c WHERE to_address IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY f, actor) AS r, count(*) OVER (PARTITION BY party) AS n FROM t), w AS (SELECT *, (n - 1) // 2 + 1 AS want FROM k WHERE n > 1), x AS (SELECT w.actor, w.f <= m.f AS early FROM w JOIN k m ON m.party = w.party AND m.r = CASE WHEN w.want < w.r THEN w.want ELSE w.want + 1 END),
s AS (SELECT actor, round(avg(early::INT), 9) AS score FROM x GROUP BY actor), b AS (SELECT address, entity FROM lbl QUALIFY row_number() OVER (PARTITION BY address ORDER BY confidence DESC, source, category) = 1) SELECT a.from_address, entity, n, gap_cv, score FROM a LEFT JOIN s ON actor = from_address LEFT JOIN b ON address = from_address""")
