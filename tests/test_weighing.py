"""Evidence, hypotheses, signals and scenarios on small rows against plain Python."""

import datetime as dt
import itertools

from tallymark.operators import weighing

SCHEMA = "claim string, artifact long, tier string, source string, confidence double, measured boolean, status string, expires_at timestamp, derivation array<string>"
OLD, NEW = dt.datetime(2023, 1, 1), dt.datetime(2025, 1, 1)


def plain(rows, tier=None):
    """Confidence of one claim by groups grown one artifact at a time."""
    ceiling = lambda t: weighing.CEILINGS.get(t, 0.3)
    rows = [r for r in rows if tier in (None, r[2])]
    bad = [r for r in rows if r[6] in ("contradicted", "expired") or (r[7] and r[7] <= dt.datetime(2024, 1, 1))]
    good = [r for r in rows if r not in bad]
    groups = []
    for r in good:
        keys = {str(r[1])} | {d for d in r[8] or [] if d}
        met = [g for g in groups if g[0] & keys]
        groups = [g for g in groups if g not in met] + [(keys.union(*(g[0] for g in met)), [r, *itertools.chain(*(g[1] for g in met))])]
    own = lambda r: min(max(0.0, min(1.0, r[4] or 0.0)), ceiling(r[2]), 1.0 if r[5] else 0.6)
    best = [min(g[1], key=lambda r: (-own(r), r[1])) for g in groups]
    den = sum(weighing.RELIABILITY.get(r[3], 0.0) for r in best)
    if not den:
        return 0.0
    against = sum(r[6] == "contradicted" for r in bad)
    value = sum(own(r) * weighing.RELIABILITY.get(r[3], 0.0) for r in best) / den * 0.85**against * 0.9 ** (len(bad) - against)
    return round(min(weighing.CEILINGS[tier] if tier else min(ceiling(r[2]) for r in best), value), 6)


def test_confidence_equals_plain_python(spark):
    import random

    random.seed(5)
    rows = []
    for claim in range(40):
        for i in range(random.randint(1, 7)):
            parents = [random.choice(["p", "q", "r", str(i - 1), None]) for _ in range(random.randint(0, 2))] or None
            rows.append((f"c{claim}", i, random.choice([*weighing.CEILINGS, None]), random.choice([*weighing.RELIABILITY, "?", None]), random.choice([None, -0.5, 0.2, 0.55, 0.9, 3.0]), random.choice([True, False, None]), random.choice(["active", None, "contradicted", "expired", None]), random.choice([None, OLD, NEW]), parents))
    df = spark.createDataFrame(rows, SCHEMA)
    for tier in (None, "attribution"):
        got = {r.claim: r.confidence for r in weighing.evidence_confidence(df, "2024-01-01", tier).collect()}
        for c in {r[0] for r in rows if tier in (None, r[2])}:
            assert abs(got[c] - plain([r for r in rows if r[0] == c], tier)) < 2e-6, c
    assert weighing.evidence_confidence(df.limit(0), "2024-01-01").count() == 0


def test_hypotheses(spark):
    rows = [("s", "a", "structural", 0.9, None), ("s", "a", "attribution", 0.6, "active"), ("s", "b", "operator", 0.59, None), ("s", "c", None, 0.8, "contradicted"), ("s", "d", "operator", 0.7, None), ("s", "d", "operator", None, None), ("s", "e", "operator", 1.0, "contradicted"), ("s", "e", "operator", 1.0, None)]
    got = {r.hypothesis: (r.confidence, r.status, r.stays, r["rank"]) for r in weighing.hypotheses(spark.createDataFrame(rows, "subject string, hypothesis string, tier string, confidence double, status string")).collect()}
    assert got == {"a": (0.7, "verified", True, 1), "e": (0.4, "inconclusive", True, 2), "d": (0.35, "inconclusive", True, 3), "b": (0.0, "rejected", False, 4), "c": (0.0, "rejected", False, 5)}


def test_signals_and_scenarios(spark):
    find = [("a", True, "deposit_to_exchange", True, "high", True, None, True, 7.0, True), ("b", None, None, None, None, None, None, None, None, None), ("c", True, None, False, "high", False, None, False, 1.0, True), ("d", False, None, True, None, True, "SUSPICIOUS", True, None, None)]
    schema = "claim string, is_whale boolean, exchange_signal string, reactivated boolean, severity string, is_anomalous boolean, grade string, is_directional boolean, imbalance double, concentrated boolean"
    sure = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("d", 0.0)], "claim string, confidence double")
    got = {r.claim: (r.value, r.band, r.confidence) for r in weighing.signal_score(spark.createDataFrame(find, schema), sure).collect()}
    assert got == {"a": (100.0, "critical", 0.5), "b": (0.0, "none", 0.1), "c": (0.0, "none", 0.0), "d": (45.0, "medium", 0.0)}
    rows = [("x", 1, "p", 0.4), ("x", 2, "q", 0.4), ("x", 3, "r", 0.2), ("y", 1, "p", -1.0), ("y", 2, "q", None), ("y", 3, "r", 0.0), ("z", 9, "one", 0.0)]
    out = {(r.subject, r.name): r.probability for r in weighing.scenarios(spark.createDataFrame(rows, "subject string, place int, name string, probability double")).collect()}
    assert out == {("x", "p"): 0.4, ("x", "q"): 0.4, ("x", "r"): 0.2, ("y", "p"): 0.3333, ("y", "q"): 0.3333, ("y", "r"): 0.3334, ("z", "one"): 1.0}


def test_forecasts_have_defaults(spark):
    df = spark.createDataFrame([("s", 10.0, -20.0, None, 5.0, -0.9, 1.0, -1.0, 0.9, None), ("n", *[None] * 9)], "symbol string, base_value double, trend_slope double, confidence double, price double, drift double, average_activity double, activity_momentum double, baseline double, risk_factor double")
    got = {(r.symbol, r.kind, r.horizon): (r.value, r.confidence, r.lower_bound, r.upper_bound) for r in weighing.forecasts(df).collect()}
    assert got["s", "trend", "7d"] == (-30.0, 0.4, -50.01, -9.99) and got["n", "trend", "24h"] == (0.0, 0.5, -0.01, 0.01)
    assert got["s", "market", "7d"][0] == 0.0 and got["s", "wallet", "30d"][0] == 0.0 and got["s", "anomaly", "30d"][0] == 1.0 and abs(got["n", "anomaly", "30d"][0] - 0.28) < 1e-9
