"""What evidence is worth: confidence of claims, tests of hypotheses, the signal score, forecasts and scenarios.

Defined results: null confidences count as 0, null statuses as active, null
tiers as the one with the lowest ceiling, sources that are not known as worth
nothing; of equally sure artifacts of a group the least one stands for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register
from .graph import components
from .ledger import count_if

# Ceilings of tiers, reliability of sources, and what lowers a confidence.
CEILINGS = {"structural": 0.95, "attribution": 0.40, "operator": 0.30}
RELIABILITY = {"on_chain": 1.0, "explorer": 0.95, "government": 0.9, "documentation": 0.85, "market": 0.8, "github": 0.75, "news": 0.6, "social": 0.35, "analyst": 0.7, "ai": 0.4, "inferred": 0.2}
UNMEASURED, CONTRADICTED, EXPIRED = 0.60, 0.85, 0.9
# Tests of hypotheses.
TIER_WEIGHT = {"structural": 0.5, "attribution": 1.0, "operator": 1.0}
SUPPORTS, PENALTY, VERIFIED, REJECTED = 0.6, 0.2, 0.6, 0.3
# Points and bands of the signal score.
WHALE, DEPOSIT, DORMANT, GRADES = 40.0, 25.0, {"high": 35.0, "medium": 20.0, "low": 10.0}, {"HIGH_RISK_PATTERN": 30.0, "SUSPICIOUS": 20.0, "UNUSUAL": 10.0}
DIRECTION, IMBALANCE, CONCENTRATED, BANDS = 15.0, 10.0, 5.0, [("critical", 80), ("high", 60), ("medium", 35)]
# Horizons and how forecasts fade.
HORIZONS, FADE, LEAST, MARGIN, SURE = ("24h", "7d", "30d"), 0.8, 0.05, 0.01, {"market": 0.45, "wallet": 0.5, "anomaly": 0.4}


def looked_up(c: Column, table: dict[str, float], other: float) -> Column:
    out = F
    for k, x in table.items():
        out = out.when(c == k, F.lit(x))
    return out.otherwise(F.lit(other))


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def evidence_confidence(artifacts: DataFrame, now: str, tier: str | None = None) -> DataFrame:
    """Confidence of each claim with how it came about, over all artifacts or those of one ``tier``.

    ``artifacts``: ``claim, artifact, tier, source, confidence, measured, status,
    expires_at, derivation`` (parents).  Contradicted and expired ones support nothing and
    damp the rest; supporting ones that share an ancestor, at any remove, count once, by the surest.
    """
    rows = artifacts if tier is None else artifacts.where(F.col("tier") == tier)
    status = F.coalesce("status", F.lit("active"))
    against, ceiling = status == "contradicted", looked_up(F.col("tier"), CEILINGS, min(CEILINGS.values()))
    late = (status == "expired") | F.coalesce(F.col("expires_at") <= F.lit(now).cast("timestamp"), F.lit(False))
    own = F.least(unit(F.coalesce("confidence", F.lit(0.0))), ceiling, F.when(F.coalesce("measured", F.lit(False)), 1.0).otherwise(UNMEASURED))
    rows = rows.select("claim", "artifact", "derivation", against.alias("against"), (~against & late).alias("late"), ceiling.alias("ceiling"), own.alias("own"), looked_up(F.col("source"), RELIABILITY, 0.0).alias("reliability"), F.coalesce("measured", F.lit(False)).alias("measured"))
    totals = rows.groupBy("claim").agg(F.count(F.lit(1)).alias("artifacts"), count_if(F.col("against")).alias("contradicted"), count_if(F.col("late")).alias("expired"))
    node = lambda key: F.to_json(F.struct(F.col("claim").alias("c"), F.col(key).cast("string").alias("k")))
    good = rows.where("not against and not late").withColumn("node", node("artifact"))
    parents = good.select("claim", "node", F.explode("derivation").alias("parent")).where("parent is not null")
    comp = components(parents.select(F.col("node").alias("src"), node("parent").alias("dst")))
    group = good.join(comp, "node", "left").withColumn("group", F.coalesce("comp", "node"))
    best = group.groupBy("claim", "group").agg(F.min_by(F.struct("own", "reliability", "ceiling", "measured"), F.struct(-F.col("own"), F.col("artifact"))).alias("r"), F.count(F.lit(1)).alias("members"))
    sums = best.groupBy("claim").agg(F.sum(F.col("r.own") * F.col("r.reliability")).alias("num"), F.sum("r.reliability").alias("den"), F.min("r.ceiling").alias("ceiling"), F.sum("members").alias("supporting"), (F.sum("members") - F.count(F.lit(1))).alias("collapsed"), count_if(~F.col("r.measured")).alias("unmeasured"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("supporting", "collapsed", "unmeasured")}
    out = totals.join(sums, "claim", "left").withColumns(zero).withColumn("ceiling", F.lit(CEILINGS[tier]) if tier else F.coalesce("ceiling", F.lit(0.0)))
    value = unit(F.col("num") / F.col("den")) * F.pow(F.lit(CONTRADICTED), "contradicted") * F.pow(F.lit(EXPIRED), "expired")
    out = out.withColumn("confidence", F.when(F.coalesce("den", F.lit(0.0)) > 0, F.round(F.greatest(F.lit(0.0), F.least("ceiling", value)), 6)).otherwise(0.0))
    return out.select("claim", "artifacts", "supporting", "contradicted", "expired", "collapsed", "unmeasured", "ceiling", "confidence", ((F.col("confidence") >= F.col("ceiling")) & (F.col("ceiling") > 0)).alias("binding"))


def hypotheses(evidence: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Each hypothesis tested by its evidence (``subject, hypothesis, tier, confidence, status``), whether it stays, and its rank for the subject."""
    conf, against = F.coalesce("confidence", F.lit(0.0)), F.coalesce("status", F.lit("active")) == "contradicted"
    e = evidence.select("subject", "hypothesis", conf.alias("confidence"), against.alias("against"), ((conf >= SUPPORTS) & ~against).alias("supports"), looked_up(F.col("tier"), TIER_WEIGHT, 1.0).alias("weight"))
    sums = e.groupBy("subject", "hypothesis").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("supports")).alias("supporting"), count_if(F.col("against")).alias("opposing"), F.sum(F.when(F.col("supports"), F.col("weight") * F.col("confidence"))).alias("s"), F.sum(F.when(F.col("supports"), F.col("weight"))).alias("w"))
    value = F.coalesce(F.col("s") / F.col("w"), F.lit(0.0)) * F.col("supporting") / F.col("n") - PENALTY * F.col("opposing") / F.col("n")
    tested = sums.select("subject", "hypothesis", "supporting", "opposing", unit(F.round(value, 4)).alias("confidence"))
    verdict = F.when(F.col("supporting") == 0, "rejected").when(F.col("confidence") >= VERIFIED, "verified").when(F.col("confidence") <= REJECTED, "rejected").otherwise("inconclusive")
    order = Window.partitionBy("subject").orderBy(F.desc("confidence"), "hypothesis")  # the hypotheses of one subject are few
    return tested.select("*", verdict.alias("status"), (F.col("confidence") > threshold).alias("stays"), F.row_number().over(order).cast("long").alias("rank"))


def signal_score(findings: DataFrame, confidences: DataFrame) -> DataFrame:
    """Points of the four detectors for each subject with evidence (``confidences``: ``claim, confidence``), 0 for one without.

    ``findings``: ``claim, is_whale, exchange_signal, reactivated, severity, is_anomalous, grade, is_directional, imbalance, concentrated``.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    whale = F.when(yes("is_whale"), WHALE + F.when(F.col("exchange_signal") == "deposit_to_exchange", DEPOSIT).otherwise(0.0)).otherwise(0.0)
    dormant = F.when(yes("reactivated"), looked_up(F.col("severity"), DORMANT, DORMANT["low"])).otherwise(0.0)
    odd = F.when(yes("is_anomalous"), looked_up(F.col("grade"), GRADES, GRADES["UNUSUAL"])).otherwise(0.0)
    lean = F.when(yes("is_directional"), DIRECTION + IMBALANCE * F.least(F.lit(1.0), F.coalesce("imbalance", F.lit(0.0))) + F.when(yes("concentrated"), CONCENTRATED).otherwise(0.0)).otherwise(0.0)
    parts = F.when(F.col("confidence").isNotNull(), F.array(whale, dormant, odd, lean)).otherwise(F.array(*[F.lit(0.0)] * 4))
    out = findings.join(confidences.select("claim", "confidence"), "claim", "left").select("claim", parts.alias("p"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    named = [F.round(F.col("p")[i], 2).alias(n) for i, n in enumerate(("whale", "dormant", "anomaly", "direction"))]
    out = out.select("claim", *named, F.least(F.lit(100.0), F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).alias("raw"), "confidence")
    band = F
    for name, least in BANDS:
        band = band.when(F.col("raw") >= least, name)
    return out.select("claim", "whale", "dormant", "anomaly", "direction", F.round("raw", 2).alias("value"), "confidence", band.when(F.col("raw") > 0, "low").otherwise("none").alias("band"))


def forecasts(subjects: DataFrame, key: str = "symbol") -> DataFrame:
    """``key, kind, horizon, value, confidence, lower_bound, upper_bound``: trend with fading confidence and growing bounds, market, wallet and anomaly forecasts.

    ``subjects``: ``base_value, trend_slope, confidence, price, drift, average_activity, activity_momentum, baseline, risk_factor``; a null is the
    default of its kind.
    """
    n = lambda c, other=0.0: F.coalesce(F.col(c).cast("double"), F.lit(other))
    points = []
    for i, horizon in enumerate(HORIZONS, start=1):
        trend, spread = n("base_value") + n("trend_slope") * i, F.abs(n("trend_slope")) * i * 0.5 + MARGIN
        fade = F.round(F.greatest(F.lit(LEAST), n("confidence", 0.5) * FADE ** (i - 1)), 4)
        point = lambda kind, value, sure, low=None, high=None: F.struct(F.lit(kind).alias("kind"), F.lit(horizon).alias("horizon"), F.round(value, 6).alias("value"), sure.alias("confidence"), (F.lit(None).cast("double") if low is None else F.round(low, 4)).alias("lower_bound"), (F.lit(None).cast("double") if high is None else F.round(high, 4)).alias("upper_bound"))  # noqa: E731, B023
        points += [
            point("trend", trend, fade, trend - spread, trend + spread), point("market", F.greatest(F.lit(0.0), n("price") * (1 + n("drift") * i)), F.lit(SURE["market"])),
            point("wallet", F.greatest(F.lit(0.0), n("average_activity") + n("activity_momentum") * i), F.lit(SURE["wallet"])), point("anomaly", unit(n("baseline", 0.2) * n("risk_factor", 1.0) * (1.0 + 0.2 * (i - 1))), F.lit(SURE["anomaly"])),
        ]
    return subjects.select(key, F.explode(F.array(*points)).alias("p")).select(key, "p.*")


def scenarios(definitions: DataFrame) -> DataFrame:
    """Scenarios of a subject (``subject, place, name, probability``) with probabilities that sum to 1: even if none has one; the last takes what rounding leaves."""
    w = Window.partitionBy("subject")  # the scenarios of one subject are few
    given = F.greatest(F.lit(0.0), F.coalesce("probability", F.lit(0.0)))
    out = definitions.select("subject", "place", "name", given.alias("g")).select("*", F.sum("g").over(w).alias("total"), F.count(F.lit(1)).over(w).alias("n"), F.max("place").over(w).alias("last"))
    out = out.withColumn("share", F.round(F.when(F.col("total") > 0, F.col("g") / F.col("total")).otherwise(1.0 / F.col("n")), 4))
    rest = F.round(1.0 - F.sum(F.when(F.col("place") < F.col("last"), F.col("share")).otherwise(0.0)).over(w), 4)
    return out.select("subject", "place", "name", F.when(F.col("place") < F.col("last"), F.col("share")).otherwise(F.greatest(F.lit(0.0), rest)).alias("probability"))


#: Stand-ins by number of the case: seven cases are the artifacts of a claim, ten claims the hypotheses of a subject.
ART = """SELECT concat(case_id {div} 7, '') AS claim, concat(case_id {div} 70, '') AS subject, case_id AS artifact, CASE (case_id {div} 7) % 4 WHEN 0 THEN 'structural' WHEN 1 THEN CASE WHEN case_id % 2 = 0 THEN 'structural' ELSE 'attribution' END WHEN 2 THEN CASE case_id % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'attribution' ELSE 'structural' END END AS tier,
{source} AS source, CASE WHEN case_id % 29 <> 0 THEN confidence * 1.1e0 END AS confidence, CASE WHEN case_id % 5 > 0 THEN case_id % 5 > 1 END AS measured, CASE WHEN predicted AND NOT label THEN 'contradicted' WHEN case_id % 11 = 0 OR (case_id {div} 7) % 23 = 0 THEN 'expired' WHEN case_id % 3 = 0 THEN 'active' END AS status,
CASE WHEN case_id % 13 = 0 THEN TIMESTAMP '2023-01-01 00:00:00' WHEN case_id % 2 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' END AS expires_at, CASE WHEN case_id % 4 = 3 THEN concat(case_id - 1, '') WHEN case_id % 6 = 1 THEN concat('p', case_id % 2) END AS one, CASE WHEN case_id % 12 = 7 THEN concat('p', case_id % 3) END AS two FROM """
NAMES = [*RELIABILITY, "other"]
FIND = """SELECT concat(case_id {div} 7, '') AS claim, min(case_id) % 3 > 0 AS is_whale, CASE WHEN min(case_id) % 2 = 0 THEN 'deposit_to_exchange' END AS exchange_signal, min(case_id) % 5 = 1 AS reactivated, CASE min(case_id) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS severity, min(case_id) % 4 < 2 AS is_anomalous,
CASE min(case_id) % 7 WHEN 0 THEN 'HIGH_RISK_PATTERN' WHEN 1 THEN 'SUSPICIOUS' WHEN 2 THEN 'UNUSUAL' END AS grade, CASE WHEN min(case_id) % 11 > 0 THEN min(case_id) % 6 = 0 END AS is_directional, max(confidence) * 1.5e0 AS imbalance, max(case_id) % 2 = 0 AS concentrated FROM """
SUBJECT = """SELECT symbol, max_by(close, open_time) AS base_value, regr_slope(close, h) AS trend_slope, CASE WHEN symbol <> 'click' THEN count(*) / (count(*) + 50e0) END AS confidence, max_by(close, open_time) AS price, regr_slope(close, h) * -400e0 AS drift, avg(volume) AS average_activity, regr_slope(volume, h) AS activity_momentum,
CASE WHEN symbol <> 'view' THEN avg(CASE WHEN high > 95 THEN 1e0 ELSE 0e0 END) END AS baseline, CASE WHEN symbol <> 'error' THEN max(high) / 50e0 END AS risk_factor FROM (SELECT *, datediff({hour}, TIMESTAMP {ntz}'2024-01-01 00:00:00', open_time) * 1e0 AS h FROM """
SCEN = "SELECT concat(user_id, '') AS subject, event_id AS place, event_type AS name, CASE WHEN user_id % 7 <> 0 THEN value - 20 END AS probability FROM "


def artifacts(v) -> DataFrame:
    pick = f"element_at(array({', '.join(map(repr, NAMES))}), CAST(1 + case_id % {len(NAMES)} AS INT))"
    a = v.spark.sql(ART.format(div="DIV", source=pick) + "{e}", e=v.evalcase)
    return a.withColumn("derivation", F.array_compact(F.array("one", "two"))).drop("one", "two")


def scored(v, tier: str | None = None) -> DataFrame:
    return evidence_confidence(artifacts(v), "2024-01-01", tier)


AE = f"""ae AS ({ART.format(div='//', source='(' + repr(NAMES) + f')[1 + case_id % {len(NAMES)}]')}evalcase),
r AS (SELECT *, coalesce(status, '') = 'contradicted' AS against, coalesce(status, '') <> 'contradicted' AND (coalesce(status, '') = 'expired' OR coalesce(expires_at <= TIMESTAMP '2024-01-01 00:00:00', false)) AS late, CASE tier WHEN 'structural' THEN 0.95::DOUBLE WHEN 'attribution' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS ceiling,
CASE source {' '.join(f"WHEN '{k}' THEN {x}::DOUBLE" for k, x in RELIABILITY.items())} ELSE 0 END AS rel, coalesce(measured, false) AS known FROM ae),
g AS (SELECT *, least(greatest(0::DOUBLE, least(1::DOUBLE, coalesce(confidence, 0))), ceiling, CASE WHEN known THEN 1::DOUBLE ELSE 0.6::DOUBLE END) AS own FROM r WHERE NOT against AND NOT late)"""
WALK = """k AS (SELECT claim, artifact, artifact::VARCHAR AS key FROM g UNION SELECT claim, artifact, one FROM g WHERE one IS NOT NULL UNION SELECT claim, artifact, two FROM g WHERE two IS NOT NULL),
p AS (SELECT DISTINCT a.claim, a.artifact AS x, b.artifact AS y FROM k a JOIN k b ON a.claim = b.claim AND a.key = b.key),
w AS (SELECT claim, x, y FROM p UNION SELECT w.claim, w.x, p.y FROM w JOIN p ON w.claim = p.claim AND w.y = p.x),
c AS (SELECT claim, x AS artifact, min(y) AS grp FROM w GROUP BY ALL),
b AS (SELECT claim, grp, count(*) AS members, arg_min(own, (-own, artifact)) AS own, arg_min(rel, (-own, artifact)) AS rel, arg_min(ceiling, (-own, artifact)) AS ceiling, arg_min(known, (-own, artifact)) AS known FROM g JOIN c USING (claim, artifact) GROUP BY ALL),
s AS (SELECT claim, sum(own * rel) AS num, sum(rel) AS den, min(ceiling) AS ceiling, sum(members)::BIGINT AS supporting, (sum(members) - count(*))::BIGINT AS collapsed, count(*) FILTER (WHERE NOT known) AS unmeasured FROM b GROUP BY claim),
t AS (SELECT claim, count(*) AS artifacts, count(*) FILTER (WHERE against) AS contradicted, count(*) FILTER (WHERE late) AS expired FROM r GROUP BY claim),
ec AS (SELECT claim, artifacts, coalesce(supporting, 0) AS supporting, contradicted, expired, coalesce(collapsed, 0) AS collapsed, coalesce(unmeasured, 0) AS unmeasured, coalesce(ceiling, 0) AS ceiling, CASE WHEN den > 0 THEN round(greatest(0::DOUBLE, least(ceiling, num / den * pow(0.85::DOUBLE, contradicted) * pow(0.9::DOUBLE, expired))), 6) ELSE 0 END AS confidence FROM t LEFT JOIN s USING (claim))"""
register("evidence_confidence", scored, f"WITH RECURSIVE {AE}, {WALK} SELECT *, confidence >= ceiling AND ceiling > 0 AS binding FROM ec")
register("hypothesis", lambda v: hypotheses(artifacts(v).withColumnRenamed("claim", "hypothesis")), f"""WITH {AE}, e AS (SELECT subject, claim AS hypothesis, coalesce(confidence, 0) AS confidence, against, coalesce(confidence, 0) >= 0.6 AND NOT against AS supports, CASE tier WHEN 'structural' THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS weight FROM r),
s AS (SELECT subject, hypothesis, count(*) FILTER (WHERE supports) AS supporting, count(*) FILTER (WHERE against) AS opposing, greatest(0::DOUBLE, least(1::DOUBLE, round(coalesce(sum(weight * confidence) FILTER (WHERE supports) / sum(weight) FILTER (WHERE supports), 0) * count(*) FILTER (WHERE supports) / count(*) - 0.2::DOUBLE * count(*) FILTER (WHERE against) / count(*), 4))) AS confidence FROM e GROUP BY ALL)
SELECT *, CASE WHEN supporting = 0 THEN 'rejected' WHEN confidence >= 0.6 THEN 'verified' WHEN confidence <= 0.3 THEN 'rejected' ELSE 'inconclusive' END AS status, confidence > 0.3 AS stays, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, hypothesis) AS rank FROM s""")
register("signal_score", lambda v: signal_score(v.spark.sql(FIND.format(div="DIV") + "{e} GROUP BY case_id DIV 7", e=v.evalcase), scored(v).where("artifacts > supporting")), f"""WITH RECURSIVE {AE}, {WALK}, f AS ({FIND.format(div='//')}evalcase GROUP BY case_id // 7), q AS (SELECT f.*, ec.confidence AS c FROM f LEFT JOIN ec ON ec.claim = f.claim AND artifacts > supporting),
d AS (SELECT claim, coalesce(c, 0) AS confidence, CASE WHEN c IS NOT NULL AND is_whale THEN CASE WHEN exchange_signal IS NULL THEN 40 ELSE 65 END ELSE 0 END::DOUBLE AS whale, CASE WHEN c IS NOT NULL AND reactivated THEN CASE severity WHEN 'high' THEN 35 WHEN 'medium' THEN 20 ELSE 10 END ELSE 0 END::DOUBLE AS dormant, CASE WHEN c IS NOT NULL AND is_anomalous THEN CASE grade WHEN 'HIGH_RISK_PATTERN' THEN 30 WHEN 'SUSPICIOUS' THEN 20 ELSE 10 END ELSE 0 END::DOUBLE AS anomaly,
CASE WHEN c IS NOT NULL AND is_directional THEN 15::DOUBLE + 10 * least(1::DOUBLE, imbalance) + CASE WHEN concentrated THEN 5 ELSE 0 END ELSE 0 END AS direction FROM q), z AS (SELECT *, least(100::DOUBLE, whale + dormant + anomaly + direction) AS raw FROM d)
SELECT claim, whale, dormant, anomaly, round(direction, 2) AS direction, round(raw, 2) AS value, confidence, CASE WHEN raw >= 80 THEN 'critical' WHEN raw >= 60 THEN 'high' WHEN raw >= 35 THEN 'medium' WHEN raw > 0 THEN 'low' ELSE 'none' END AS band FROM z""")
register("forecasts", lambda v: forecasts(v.spark.sql(SUBJECT.format(hour="hour", ntz="") + "{c}) GROUP BY symbol", c=v.candle)), f"""WITH s AS ({SUBJECT.format(hour="'hour'", ntz='')}candle) GROUP BY symbol), h AS (SELECT s.*, x.i, x.horizon FROM s, (VALUES (1, '24h'), (2, '7d'), (3, '30d')) x(i, horizon))
SELECT symbol, 'trend' AS kind, horizon, round(base_value + trend_slope * i, 6) AS value, round(greatest(0.05::DOUBLE, coalesce(confidence, 0.5::DOUBLE) * pow(0.8::DOUBLE, i - 1)), 4) AS confidence, round(base_value + trend_slope * i - abs(trend_slope) * i * 0.5::DOUBLE - 0.01::DOUBLE, 4) AS lower_bound, round(base_value + trend_slope * i + abs(trend_slope) * i * 0.5::DOUBLE + 0.01::DOUBLE, 4) AS upper_bound FROM h
UNION ALL SELECT symbol, 'market', horizon, round(greatest(0, price * (1 + drift * i)), 6), 0.45, NULL, NULL FROM h UNION ALL SELECT symbol, 'wallet', horizon, round(greatest(0, average_activity + activity_momentum * i), 6), 0.5, NULL, NULL FROM h
UNION ALL SELECT symbol, 'anomaly', horizon, round(greatest(0, least(1, coalesce(baseline, 0.2::DOUBLE) * coalesce(risk_factor, 1) * (1 + 0.2::DOUBLE * (i - 1)))), 6), 0.4, NULL, NULL FROM h""")
register("scenarios", lambda v: scenarios(v.spark.sql(SCEN + "{e}", e=v.events)), f"""WITH d AS (SELECT subject, place, name, greatest(0, coalesce(probability, 0)) AS g FROM ({SCEN}events)), t AS (SELECT *, sum(g) OVER w AS total, count(*) OVER w AS n, max(place) OVER w AS last FROM d WINDOW w AS (PARTITION BY subject)), u AS (SELECT *, round(CASE WHEN total > 0 THEN g / total ELSE 1::DOUBLE / n END, 4) AS share FROM t)
SELECT subject, place, name, CASE WHEN place < last THEN share ELSE greatest(0, round(1 - coalesce(sum(share) FILTER (WHERE place < last) OVER (PARTITION BY subject), 0), 4)) END AS probability FROM u""")
