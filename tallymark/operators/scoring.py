"""Detectors over subjects, scores, decisions and the evaluation of detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register
from .graph import written
from .ledger import CANON, CLS, best_labels, canonical, classify, count_if, total, with_entities
from .order import fine_log, nth_values
from .rollups import ABSENCE_BLOCKS, HW, SUMMARY, coverage, height_window, summary


def div(a: Column, b: Column) -> Column:
    """A ratio, null on a zero denominator."""
    return F.round(a / F.nullif(b, F.lit(0)), 9)


def confusion(cases: DataFrame) -> DataFrame:
    """Counts and rates per detector."""
    p, y = F.col("predicted"), F.col("label")
    out = cases.groupBy("detector").agg(count_if(p & y).alias("tp"), count_if(p & ~y).alias("fp"), count_if(~p & y).alias("fn"), count_if(~p & ~y).alias("tn"))
    c = F.col
    return out.select("*", div(c("tp"), c("tp") + c("fp")).alias("precision"), div(c("tp"), c("tp") + c("fn")).alias("recall"), div(c("fp"), c("fp") + c("tn")).alias("fpr"), div(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"))


def calibration(cases: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability per bin, the last bin closed at 1; expected and largest error on each row's detector."""
    b = F.least(F.floor(F.col("confidence") * bins + 1e-9), F.lit(bins - 1)).cast("int")
    each = cases.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.round(F.avg(F.col("label").cast("int")), 9).alias("observed"))
    every = each.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(each, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "observed", F.round(F.abs(F.col("mean_confidence") - F.col("observed")), 8).alias("error"))


CONF = "cf AS (SELECT detector, count(*) FILTER (WHERE predicted AND label) AS tp, count(*) FILTER (WHERE predicted AND NOT label) AS fp, count(*) FILTER (WHERE NOT predicted AND label) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT label) AS tn FROM evalcase GROUP BY detector)"
register("confusion", lambda v: confusion(v.evalcase), f"WITH {CONF} SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(fp / nullif(fp + tn, 0), 9) AS fpr, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM cf")
CAL = "cb AS (SELECT CAST(least(floor(confidence * 10 + 1e-9), 9) AS INT) AS bin, count(*) AS n, round(avg(confidence), 9) AS mean_confidence, round(avg(label::INT), 9) AS observed FROM evalcase GROUP BY 1)"
register("calibration", lambda v: calibration(v.evalcase), f"WITH {CAL} SELECT CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n, mean_confidence, observed, round(abs(mean_confidence - observed), 8) AS error FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN cb USING (bin)")
register("outcome_calibration", lambda v: v.evalcase.where("confidence < 1.0").groupBy(F.floor(F.col("confidence") * 4 + 1e-9).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("label").cast("int")), 9).alias("observed")), "SELECT CAST(floor(confidence * 4 + 1e-9) AS INT) AS bin, count(*) AS n, round(avg(label::INT), 9) AS observed FROM evalcase WHERE confidence < 1.0 GROUP BY 1")
register("outcome_metrics", lambda v: v.evalcase.groupBy("detector").agg(F.round(F.avg((F.col("predicted") == F.col("label")).cast("int")), 9).alias("accuracy"), F.round(F.avg(F.pow(F.col("confidence") - F.col("label").cast("int"), 2)), 8).alias("brier"), F.round(F.avg(F.abs(F.col("confidence") - F.col("label").cast("int"))), 8).alias("mae"), F.round(F.avg(F.col("confidence") - F.col("label").cast("int")), 8).alias("bias")), "SELECT detector, round(avg((predicted = label)::INT), 9) AS accuracy, round(avg(pow(confidence - label::INT, 2)), 8) AS brier, round(avg(abs(confidence - label::INT)), 8) AS mae, round(avg(confidence - label::INT), 8) AS bias FROM evalcase GROUP BY detector")
register("sample_eval", lambda v: v.evalcase.select("detector", F.when(F.col("predicted") & F.col("label"), "HIT").when(F.col("predicted"), "FP").when(F.col("label"), F.when(F.col("confidence") >= 0.5, "WEAK").otherwise("FN")).otherwise("PASS").alias("outcome")).groupBy("detector", "outcome").agg(F.count(F.lit(1)).alias("n")), "SELECT detector, CASE WHEN predicted AND label THEN 'HIT' WHEN predicted THEN 'FP' WHEN label THEN CASE WHEN confidence >= 0.5 THEN 'WEAK' ELSE 'FN' END ELSE 'PASS' END AS outcome, count(*) AS n FROM evalcase GROUP BY ALL")


#: What a detector needs to be promoted, how far off confidences may be.
CASES, OVERCONFIDENT, MISCALIBRATED = 100, 0.05, 0.10


def backtest(cases: DataFrame, bins: int = 10) -> DataFrame:
    """Per detector (``detector, predicted, label, confidence``): cases, rates, calibration, and what blocks its promotion.

    It is promoted with 100 cases, a false-positive rate that is defined, and confidences
    that exceed the observed rate by no more than 0.05.  Nulls: not predicted, not true, confidence 0.
    """
    no, sure = F.lit(False), F.coalesce("confidence", F.lit(0.0))
    c = cases.select("detector", F.coalesce("predicted", no).alias("p"), F.coalesce("label", no).alias("y"), sure.alias("sure"), F.least(F.floor(sure * bins + 1e-9), F.lit(bins - 1)).alias("bin"))
    p, y = F.col("p"), F.col("y")
    by_bin = c.groupBy("detector", "bin").agg(F.count(F.lit(1)).alias("n"), count_if(p & y).alias("tp"), count_if(p & ~y).alias("fp"), count_if(~p & y).alias("fn"), count_if(~p & ~y).alias("tn"), (F.sum("sure") - count_if(y)).alias("gap"))
    out = by_bin.groupBy("detector").agg(*[F.sum(x).alias(x) for x in ("n", "tp", "fp", "fn", "tn")], F.sum("gap").alias("signed"), F.sum(F.abs("gap")).alias("off"))
    x = F.col
    out = out.select("detector", x("n").alias("cases"), div(x("tp"), x("tp") + x("fp")).alias("precision"), div(x("tp"), x("tp") + x("fn")).alias("recall"), div(x("fp"), x("fp") + x("tn")).alias("fpr"), F.round(x("off") / x("n"), 8).alias("calibration_error"), F.round(x("signed") / x("n"), 8).alias("excess"))
    blocks = F.array_compact(F.array(F.when(x("cases") < CASES, F.lit("too few cases")), F.when(x("fpr").isNull(), F.lit("no negative cases")), F.when(x("excess") > OVERCONFIDENT, F.lit("overconfident"))))
    return out.select("*", F.array_join(blocks, "; ").alias("blockers"), (F.size(blocks) == 0).alias("promotable"), ((x("excess") <= OVERCONFIDENT) & (x("calibration_error") > MISCALIBRATED)).alias("underconfident"))


#: Stand-ins by number: detectors of three kinds of confidence, a rare one, and one without negative cases.
TRIAL = """SELECT concat(detector, CASE WHEN case_id % 17 = 0 AND label THEN '/positive' WHEN case_id % 40 = 1 THEN '/rare' WHEN case_id % 3 = 0 THEN '/sharp' WHEN case_id % 3 = 1 THEN '/even' ELSE '/bold' END) AS detector, predicted, label,
CASE WHEN case_id % 3 = 0 THEN CASE WHEN label THEN 0.8e0 ELSE 0.1e0 END WHEN case_id % 3 = 1 THEN confidence ELSE least(1e0, confidence + 0.4e0) END AS confidence FROM """
ALL_TRIAL = TRIAL.replace("concat(detector, ", "concat('all', ")
register("backtest", lambda v: backtest(v.spark.sql(f"{TRIAL} {{e}} UNION ALL {ALL_TRIAL} {{e}}", e=v.evalcase)), f"""WITH t AS ({TRIAL} evalcase UNION ALL {ALL_TRIAL} evalcase), b AS (SELECT detector, least(floor(confidence * 10 + 1e-9), 9) AS bin, count(*) AS n, sum(confidence) - count(*) FILTER (WHERE label) AS gap FROM t GROUP BY ALL), c AS (SELECT detector, sum(gap) / sum(n) AS excess, sum(abs(gap)) / sum(n) AS off FROM b GROUP BY detector),
m AS (SELECT detector, count(*) AS cases, count(*) FILTER (WHERE predicted AND label) AS tp, count(*) FILTER (WHERE predicted AND NOT label) AS fp, count(*) FILTER (WHERE NOT predicted AND label) AS fn, count(*) FILTER (WHERE NOT label) AS neg FROM t GROUP BY detector),
r AS (SELECT detector, cases, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(fp / nullif(neg, 0), 9) AS fpr, round(off, 8) AS calibration_error, round(excess, 8) AS excess FROM m JOIN c USING (detector)), k AS (SELECT *, concat_ws('; ', CASE WHEN cases < 100 THEN 'too few cases' END, CASE WHEN fpr IS NULL THEN 'no negative cases' END, CASE WHEN excess > 0.05 THEN 'overconfident' END) AS blockers FROM r)
SELECT *, blockers = '' AS promotable, excess <= 0.05 AND calibration_error > 0.1 AS underconfident FROM k""")


def whales(transfers: DataFrame, percent: float = 99.0) -> DataFrame:
    """Transfers at or above a percentile of their chain's population, strictly-below rank; with the direction's party."""
    # With m rows or more strictly below, a value lies above the m-th one.
    edge = nth_values(transfers, "chain", "value", fine_log(F.greatest("value", F.lit(1))), {"edge": lambda n: F.ceil(F.lit(percent) * n / 100)}).select("chain", "all_n", "edge")
    return transfers.join(F.broadcast(edge), "chain").where((F.col("all_n") >= F.ceil(100 / (100 - F.lit(percent)))) & (F.col("value") > F.col("edge")))


WHALE = f"WITH {CANON}, r AS (SELECT *, (rank() OVER (PARTITION BY chain ORDER BY value) - 1) / count(*) OVER (PARTITION BY chain) * 100 AS below, count(*) OVER (PARTITION BY chain) AS n FROM c)"
register("det_whale", lambda v: whales(canonical(v.txn, v.blk)).select("tx_key", "chain", "value"), f"{WHALE} SELECT tx_key, chain, value::BIGINT AS value FROM r WHERE n >= 100 AND below >= 99")
register("whale_entries", lambda v: whales(canonical(v.txn, v.blk)).groupBy("from_address").agg(F.count(F.lit(1)).alias("n"), total("value").alias("total")), f"{WHALE} SELECT from_address, count(*) AS n, sum(value)::BIGINT AS total FROM r WHERE n >= 100 AND below >= 99 GROUP BY from_address")


def dormant(addresses: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Addresses by days since their last outbound transfer."""
    quiet = F.datediff(F.lit(as_of).cast("date"), F.to_date("last_outbound_at"))
    return addresses.select("address", quiet.alias("days"), F.when(quiet.isNull(), "never_sent").when(quiet >= 5 * days, "ancient").when(quiet >= days, "dormant").otherwise("active").alias("band"))


register("det_dormant", lambda v: dormant(summary(v), "1999-01-01"), f"WITH {SUMMARY}, d AS (SELECT address, CAST(datediff('day', last_outbound_at::DATE, DATE '1999-01-01') AS INT) AS days FROM a) SELECT address, days, CASE WHEN days IS NULL THEN 'never_sent' WHEN days >= 1825 THEN 'ancient' WHEN days >= 365 THEN 'dormant' ELSE 'active' END AS band FROM d")


def exchange_direction(flows: DataFrame, labels: DataFrame, window: DataFrame, least: int = 10, imbalance: float = 0.20, concentration: float = 0.80) -> DataFrame:
    """Which way flow at labelled exchanges leans, if there is enough of it, and the operator that carries most of it.

    ``flows`` are classified by ``labels`` (one of an address).  Transfers between
    exchanges are attributed, but lean nowhere.  Without any, "no flow" is said
    only where labels are known and ``window`` (of ``coverage``) licenses an absence
    without a floor.  A direction is trusted no more than the weakest label.
    """
    kind, c = F.col("flow_kind"), F.col
    # A row per pair of operators, so transfers are read once.
    pairs = written(flows.groupBy("chain", "flow_kind", "from_entity", "to_entity").agg(F.count(F.lit(1)).alias("n"), total("value").alias("value")))
    attributed = F.coalesce(F.sum(F.when(kind != "unrelated", c("n"))), F.lit(0)).alias("attributed")
    sums = pairs.groupBy("chain").agg(attributed, total("value", kind == "deposit").alias("i"), total("value", kind == "withdrawal").alias("o"))
    each = pairs.where(kind != "unrelated").select("chain", F.explode(F.array_distinct(F.array_compact(F.array("from_entity", "to_entity")))).alias("entity"), F.when(kind != "internal", c("value")).alias("value"))
    volumes = each.groupBy("chain", "entity").agg(total("value").alias("volume"))
    top = volumes.groupBy("chain").agg(F.count(F.lit(1)).alias("seen"), F.min(F.when(c("volume") > 0, F.struct((-c("volume")).alias("less"), "entity"))).alias("top"))
    known = labels.agg(F.min("confidence").alias("weakest"))
    licensed = window.where("limitation = 'none'").select("chain", F.lit(True).alias("licensed"))
    all_of = sums.join(top, "chain", "left").join(licensed, "chain", "left").join(F.broadcast(known), F.lit(True))  # one row
    gross = c("i") + c("o")
    lean = (c("i") - c("o")).cast("double") / F.nullif(gross.cast("double"), F.lit(0.0))
    share = F.least(F.lit(1.0), -c("top.less").cast("double") / gross.cast("double"))
    verdict = F.when((c("attributed") == 0) & c("licensed") & c("weakest").isNotNull(), "no flow").when((c("attributed") < least) | lean.isNull(), "insufficient").when(lean >= imbalance, "inflow").when(lean <= -imbalance, "outflow").otherwise("balanced")
    judged = all_of.select("chain", "attributed", F.round(lean, 9).alias("imbalance"), verdict.alias("verdict"), c("top.entity").alias("top_entity"), F.round(share, 9).alias("top_share"), (share >= concentration).alias("concentrated"), F.coalesce("seen", F.lit(0)).alias("operators"), c("weakest").alias("confidence"))
    enough = c("verdict").isin("inflow", "outflow", "balanced")
    only = {n: F.when(enough, c(n)) for n in ("top_entity", "top_share", "concentrated")} | {"confidence": F.when(c("verdict").isin("inflow", "outflow"), c("confidence"))}
    return judged.withColumns(only)


EX_CLS = CLS.replace("FROM lbl)", "FROM lbl WHERE category = 'exchange')")
EX = f"""WITH {EX_CLS}, s AS (SELECT chain, count(*) FILTER (WHERE flow_kind <> 'unrelated') AS n, coalesce(sum(value) FILTER (WHERE flow_kind = 'deposit'), 0)::DOUBLE AS i, coalesce(sum(value) FILTER (WHERE flow_kind = 'withdrawal'), 0)::DOUBLE AS o FROM k GROUP BY chain),
o AS (SELECT chain, flow_kind, value, unnest(list_distinct(list_filter([from_entity, to_entity], lambda x: x IS NOT NULL))) AS entity FROM k WHERE flow_kind <> 'unrelated'), g AS (SELECT chain, entity, coalesce(sum(value) FILTER (WHERE flow_kind <> 'internal'), 0)::BIGINT AS volume FROM o GROUP BY ALL),
t AS (SELECT chain, count(*) AS operators FROM g GROUP BY chain), m AS (SELECT chain, entity, volume FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY volume DESC, entity) AS r FROM g WHERE volume > 0) WHERE r = 1), {HW},
l AS (SELECT s.chain, n, (i - o) / nullif(i + o, 0) AS lean, m.entity, least(1, m.volume / nullif(i + o, 0)) AS share, coalesce(operators, 0) AS operators, (SELECT min(confidence) FROM best) AS weakest, coalesce(w.span = w.blocks AND w.complete = w.blocks AND w.span >= {ABSENCE_BLOCKS}, false) AS licensed FROM s LEFT JOIN t ON t.chain = s.chain LEFT JOIN m ON m.chain = s.chain LEFT JOIN w ON w.chain = s.chain),
j AS (SELECT *, CASE WHEN n = 0 AND licensed AND weakest IS NOT NULL THEN 'no flow' WHEN n < 10 OR lean IS NULL THEN 'insufficient' WHEN lean >= 0.2 THEN 'inflow' WHEN lean <= -0.2 THEN 'outflow' ELSE 'balanced' END AS verdict FROM l)"""
EX_OUT = "SELECT chain, n AS attributed, round(lean, 9) AS imbalance, verdict, CASE WHEN verdict IN ('inflow', 'outflow', 'balanced') THEN entity END AS top_entity, CASE WHEN verdict IN ('inflow', 'outflow', 'balanced') THEN round(share, 9) END AS top_share, CASE WHEN verdict IN ('inflow', 'outflow', 'balanced') THEN share >= 0.8 END AS concentrated, operators, CASE WHEN verdict IN ('inflow', 'outflow') THEN weakest END AS confidence FROM j"


def exchange_direction_of(v) -> DataFrame:
    best = best_labels(v.lbl.where("category = 'exchange'"))
    return exchange_direction(classify(with_entities(canonical(v.txn, v.blk), best)), best, coverage(height_window(v.blk)))


register("det_exchange", exchange_direction_of, f"{EX} {EX_OUT}")


#: What is dust, how much of it tells, and when one counterparty is too much.
DUST, DUST_LEAST, TOP_SHARE, TOP_LEAST = 10**14, 3, 0.8, 5


def security(transfers: DataFrame, mixers: DataFrame) -> DataFrame:
    """Flags of each address over all transfers that it takes part in, on either side: contact with a mixer (``mixers``: ``address``), dust, one counterparty in more than 0.8 of more than 5.

    A transfer to oneself counts once, with oneself as the counterparty; one without a receiver has none.
    """
    sides = F.array(F.struct(F.col("from_address").alias("address"), F.col("to_address").alias("other")), F.when(~F.col("to_address").eqNullSafe(F.col("from_address")), F.struct(F.col("to_address").alias("address"), F.col("from_address").alias("other"))))
    each = transfers.select(F.explode(F.array_compact(sides)).alias("s"), ((F.col("value") > 0) & (F.col("value") < DUST)).alias("dust")).select("s.*", "dust").where("address is not null")
    pair = each.groupBy("address", "other").agg(F.count(F.lit(1)).alias("k"), count_if(F.col("dust")).alias("dust"))
    known = mixers.select(F.col("address").alias("other"), F.lit(True).alias("mixer")).distinct()
    pair = pair.join(known, "other", "left")
    out = pair.groupBy("address").agg(F.sum("k").alias("n"), F.sum("dust").alias("dust"), F.coalesce(F.sum(F.when(F.col("mixer"), F.col("k"))), F.lit(0)).alias("mixer"), F.coalesce(F.max(F.when(F.col("other").isNotNull(), F.col("k"))), F.lit(0)).alias("top"))
    share = F.col("top") / F.col("n")
    flags = F.array_compact(F.array(F.when(F.col("mixer") > 0, F.lit("mixer")), F.when(F.col("dust") > DUST_LEAST, F.lit("dust")), F.when((share > TOP_SHARE) & (F.col("n") > TOP_LEAST), F.lit("concentrated"))))
    return out.select("address", "n", "mixer", "dust", F.round(share, 4).alias("top_share"), F.array_join(flags, ",").alias("flags"))


#: Stand-ins: token transfers in the smallest unit, every fifth sender nearly always to one hub, some without a receiver.
MOVES = "SELECT from_address, CASE WHEN log_index % 9 > 0 AND CAST(substring(from_address, 2) AS BIGINT) % 5 = 0 THEN concat('hub', from_address) WHEN log_index % 31 = 0 THEN NULL WHEN log_index % 37 = 0 THEN from_address ELSE to_address END AS to_address, CAST(CAST(value AS BIGINT) * 30000000000 AS DECIMAL(38,0)) AS value FROM "
MIXERS = "SELECT DISTINCT from_address AS address FROM {0} WHERE CAST(substring(from_address, 2) AS BIGINT) % 17 = 3"
register("security_scan", lambda v: security(v.spark.sql(MOVES + "{t}", t=v.ttx), v.spark.sql(MIXERS.replace("{0}", "{t}"), t=v.ttx)), f"""WITH m AS ({MOVES}ttx), x AS ({MIXERS.format('ttx')}), e AS (SELECT from_address AS address, to_address AS other, value FROM m WHERE from_address IS NOT NULL UNION ALL SELECT to_address, from_address, value FROM m WHERE to_address <> from_address),
p AS (SELECT address, other, count(*) AS k, count(*) FILTER (WHERE value > 0 AND value < 100000000000000) AS dust, bool_or(other IN (SELECT address FROM x)) AS mixer FROM e GROUP BY ALL), s AS (SELECT address, sum(k)::BIGINT AS n, coalesce(sum(k) FILTER (WHERE mixer), 0)::BIGINT AS mixer, sum(dust)::BIGINT AS dust, coalesce(max(k) FILTER (WHERE other IS NOT NULL), 0) AS top FROM p GROUP BY address)
SELECT address, n, mixer, dust, round(top / n, 4) AS top_share, concat_ws(',', CASE WHEN mixer > 0 THEN 'mixer' END, CASE WHEN dust > 3 THEN 'dust' END, CASE WHEN top / n > 0.8 AND n > 5 THEN 'concentrated' END) AS flags FROM s""")
register("metric_analyzers", lambda v: v.part.select("p_partkey", F.when(F.col("p_retailprice") >= 1500, "deep").when(F.col("p_retailprice") >= 1000, "fair").otherwise("thin").alias("depth"), F.when(F.col("p_size") > 40, "concentrated").when(F.col("p_size") > 20, "mixed").otherwise("spread").alias("holding")), "SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 'deep' WHEN p_retailprice >= 1000 THEN 'fair' ELSE 'thin' END AS depth, CASE WHEN p_size > 40 THEN 'concentrated' WHEN p_size > 20 THEN 'mixed' ELSE 'spread' END AS holding FROM part")


def alerts(found: DataFrame, budget: int = 5) -> DataFrame:
    """Alerts within a daily budget per subscription, the rest as a digest's count."""
    w = Window.partitionBy("subscription", "day").orderBy(F.desc("score"), "event_id")
    placed = found.withColumn("r", F.row_number().over(w))
    return placed.groupBy("subscription", "day").agg(count_if(F.col("r") <= budget).alias("sent"), count_if(F.col("r") > budget).alias("digest"), F.round(F.min(F.when(F.col("r") <= budget, F.col("score"))), 6).alias("least_sent"))


register("alerts", lambda v: alerts(v.events.where("value > 50").select(F.col("event_type").alias("subscription"), F.to_date("ts").cast("string").alias("day"), F.col("value").alias("score"), "event_id")), "WITH p AS (SELECT event_type AS subscription, ts::DATE::VARCHAR AS day, value AS score, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY value DESC, event_id) AS r FROM events WHERE value > 50) SELECT subscription, day, count(*) FILTER (WHERE r <= 5) AS sent, count(*) FILTER (WHERE r > 5) AS digest, round(min(score) FILTER (WHERE r <= 5), 6) AS least_sent FROM p GROUP BY ALL")


def triggers(rows: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """One row per rule that a row meets."""
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, cond, s in rules]))
    return rows.select("*", F.explode(hits).alias("h")).select(*rows.columns, "h.*")


register("triggers", lambda v: triggers(v.events.select("event_id", "event_type", "value"), [("large", F.col("value") > 90, "high"), ("error", F.col("event_type") == "error", "low")]).select("event_id", "rule", "severity"), "SELECT event_id, 'large' AS rule, 'high' AS severity FROM events WHERE value > 90 UNION ALL SELECT event_id, 'error', 'low' FROM events WHERE event_type = 'error'")
register("conclusions", lambda v: confusion(v.evalcase).select("detector", F.when(F.col("tp") + F.col("fp") == 0, "UNDETERMINED").when(F.col("precision") >= 0.5, "AFFIRMED").otherwise("NEGATED").alias("stance"), F.least(F.coalesce("precision", F.lit(0.0)), F.lit(0.9)).alias("confidence")), f"WITH {CONF} SELECT detector, CASE WHEN tp + fp = 0 THEN 'UNDETERMINED' WHEN round(tp / nullif(tp + fp, 0), 9) >= 0.5 THEN 'AFFIRMED' ELSE 'NEGATED' END AS stance, least(coalesce(round(tp / nullif(tp + fp, 0), 9), 0.0::DOUBLE), 0.9::DOUBLE) AS confidence FROM cf")
register("rank_decisions", lambda v: confusion(v.evalcase).select("detector", F.col("tp").alias("priority")).orderBy(F.desc("priority"), "detector"), f"WITH {CONF} SELECT detector, tp AS priority FROM cf")
register("recommend", lambda v: v.blk.where("incomplete_reason <> ''").groupBy("chain", F.when(F.col("incomplete_reason") == "selective_capture", "lower_floor").otherwise("fetch_logs").alias("action")).agg(F.count(F.lit(1)).alias("weight")), "SELECT chain, CASE WHEN incomplete_reason = 'selective_capture' THEN 'lower_floor' ELSE 'fetch_logs' END AS action, count(*) AS weight FROM blk WHERE incomplete_reason <> '' GROUP BY ALL")
register("st_backfill", lambda v: v.blk.groupBy("chain").agg(F.min("number").alias("a"), F.max("number").alias("b")).select("chain", F.explode(F.sequence("a", "b")).alias("number")).join(v.blk.select("chain", "number"), ["chain", "number"], "left_anti").groupBy("chain").agg(F.count(F.lit(1)).alias("missing"), F.min("number").alias("first_missing")), "WITH r AS (SELECT chain, unnest(range(min(number), max(number) + 1)) AS number FROM blk GROUP BY chain) SELECT r.chain, count(*) AS missing, CAST(min(r.number) AS INT) AS first_missing FROM r ANTI JOIN blk b ON r.chain = b.chain AND r.number = b.number GROUP BY r.chain")
