"""Verdicts, calibration, as-of joins and predictions against brute force."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from tallymark.operators import predict, verification, windows

ITEM = "narrative long, item long, tier int, stance string, title string, content string, extra int"


def judged(rows, coordination):
    """One narrative, rule by rule, with every pair of a denial and a support."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[5] or "title:" + (r[4] or "")].append(r)
    tier = lambda r: 6 if r[2] is None else r[2]
    best = [min(g, key=lambda r: (tier(r), r[1])) for g in groups.values()]
    sources = [(tier(r), r[3] or "neutral", f"{r[5] or ''} {r[4] or ''}".lower()) for r in best]
    says = lambda *s: [x for x in sources if x[1] in s]
    credible, denies, supports = [x for x in sources if x[0] <= 3], says("deny"), says("support")
    asserted = [x for x in credible if x[1] in ("support", "neutral")]
    official = Counter(x[1] for x in sources if x[0] == 1)
    if any("hoax" in f"{r[4] or ''} {r[5] or ''}".lower() for r in rows):
        return "fabricated", 0.85 if coordination else 0.7
    if official["deny"]:
        out = "confirmed_false", 0.85
    elif len(denies) > 1:
        out = "confirmed_false", 0.85 if credible else 0.7
    elif denies and not supports:
        out = ("disputed", 0.5) if asserted else ("likely_false", 0.7)
    elif denies:
        out = "disputed", 0.5
    elif official["support"] + official["neutral"]:
        out = "confirmed_true", 0.92 if official["support"] + official["neutral"] > 1 else 0.85
    elif all(x[0] >= 4 for x in sources) and coordination >= 60 and len(rows) >= 3:
        out = "likely_false", 0.65
    elif asserted:
        out = "likely_true", 0.75 if len(asserted) > 1 else 0.65
    elif any(x[1] == "question" and "reportedly" in x[2] for x in credible):
        out = "likely_true", 0.65
    elif says("question") and not supports:
        out = "unconfirmed", 0.35
    else:
        out = "unconfirmed", 0.35 if len(supports) > 1 else 0.3
    for d in denies:
        for s in supports:
            if (d[0] - s[0] < -2 and out[0].endswith("_true")) or (d[0] - s[0] > 2 and out[0].endswith("_false")):
                out = "disputed", out[1] * 0.5
    return out


def test_verdicts(spark):
    rng, rows = random.Random(1), []
    for n in range(400):
        for _ in range(rng.randint(1, 5)):
            text = rng.choice([f"text {rng.randint(0, 400)}", f"Reportedly {rng.randint(0, 99)}", None] + ["a Hoax"] * (n % 40 == 0))
            rows.append((n, len(rows), rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice(["deny", "support", "question", "neutral", None] + ["support"] * (n % 3)), rng.choice(["t", None]), text, 0))
    coordination = {n: n * 37 % 101 for n in range(0, 400, 2)}
    got = verification.verify(spark.createDataFrame(rows, ITEM), spark.createDataFrame(list(coordination.items()), "narrative long, coordination int")).collect()
    want = {n: judged([r for r in rows if r[0] == n], coordination.get(n, 0)) for n in range(400)}
    assert {r.narrative: (r.verdict, r.raw) for r in got} == {n: (v, round(x, 6)) for n, (v, x) in want.items()}
    assert {v for v, _ in want.values()} == {"fabricated", *verification.TRUE, *verification.FALSE, *verification.UNSURE}
    for r in got:
        unsure = r.verdict in verification.UNSURE
        assert abs(r.confidence - (r.raw if not unsure else r.raw * 0.7 if r.raw <= 0.5 else 0.35 + (r.raw - 0.5) / 2)) < 1e-6
    assert verification.verify(spark.createDataFrame([], ITEM)).count() == 0


def test_pooling_is_the_best_rising_fit():
    rng = random.Random(2)
    for size in (0, 1, 2, 7, 60):
        n = np.array([rng.randint(1, 5) for _ in range(size)])
        hits = np.array([rng.randint(0, k) for k in n.tolist()])
        got = verification.pooled(n, hits)
        mean = lambda a, b: hits[a : b + 1].sum() / n[a : b + 1].sum()  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(i, size)) for a in range(i + 1)) for i in range(size)]
        assert np.allclose(got, want)


@pytest.mark.parametrize("kind", ["mixed", "apart", "one", "all"])
def test_logistic_is_at_its_least(kind):
    rng = np.random.default_rng(3)
    x = np.array([0.4]) if kind == "one" else np.arange(0, 1001, 20) / 1000
    n = rng.integers(1, 30, len(x))
    hits = {"mixed": rng.binomial(n, 1 / (1 + np.exp(-6 * x + 2))), "apart": n * (x > 0.5), "one": n // 2, "all": n}[kind]
    a, b = verification.logistic(x, n, hits)
    high, low = (hits.sum() + 1) / (hits.sum() + 2), 1 / ((n - hits).sum() + 2)
    loss = lambda a, b: float((hits * (-high * -np.logaddexp(0, a * x + b) + (1 - high) * np.logaddexp(0, -a * x - b)) + (n - hits) * (low * np.logaddexp(0, a * x + b) + (1 - low) * np.logaddexp(0, -a * x - b))).sum())
    here = loss(a, b)
    assert all(loss(a + da, b + db) >= here - 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_calibration(spark):
    rng = random.Random(5)
    past = [("likely_true", s, rng.random() < s) for s in (rng.random() for _ in range(300))] + [("disputed", 0.5, True)] * 5 + [("likely_true", None, True), ("likely_true", 0.5, None)]
    history = spark.createDataFrame(past, "verdict string, score double, held boolean")
    cases = spark.createDataFrame([("likely_true", 0.65, 0.65), ("likely_true", 0.0, 0.0), ("disputed", 0.5, 0.35)], "verdict string, raw double, confidence double")
    fit = {r.bucket: r.value for r in verification.isotonic(history).where("verdict = 'likely_true'").collect()}
    got = {(r.verdict, r.raw): r.confidence for r in verification.calibrate(cases, history).collect()}
    assert got["disputed", 0.5] == 0.35  # too little history
    assert got["likely_true", 0.65] == round(fit[max(b for b in fit if b <= 650)], 6) and got["likely_true", 0.0] == round(fit[min(fit)], 6)
    curve = verification.platt(history).where("verdict = 'likely_true'").first()
    platt = {(r.verdict, r.raw): r.confidence for r in verification.calibrate(cases, history, "platt").collect()}
    assert abs(platt["likely_true", 0.65] - 1 / (1 + math.exp(curve.a * 0.65 + curve.b))) < 1e-6 and 0.5 < platt["likely_true", 0.65] < 0.8


def test_asof_across_ranges(spark):
    rng, t0 = random.Random(6), datetime(2024, 1, 1)
    candles = [(s, t0 + timedelta(minutes=rng.randint(0, 20_000)), rng.choice([None, 1.0, 2.5, rng.random()])) for s in ("a", "b") for _ in range(40)]
    points = [(rng.choice("abc"), k, t0 + timedelta(minutes=rng.randint(-500, 25_000))) for k in range(300)] + [(c[0], 1000 + i, c[1]) for i, c in enumerate(candles)]
    df = windows.asof(spark.createDataFrame(points, "symbol string, point_id long, at_time timestamp_ntz"), spark.createDataFrame([c for c in candles if c[2] is not None], "symbol string, open_time timestamp_ntz, close double"))
    want = {}
    for s, k, t in points:
        seen = [(c[1], c[2]) for c in candles if c[0] == s and c[1] <= t and c[2] is not None]
        want[k] = max(seen)[1] if seen else None
    assert {r.point_id: r.price for r in df.collect()} == want


def test_predictions_without_candles_or_past(spark):
    about = spark.createDataFrame([(1, "x", "hack", 50, "x", datetime(2024, 1, 2), None, None, None)], "narrative long, asset string, category string, fomo_score int, entity_type string, first_seen timestamp_ntz, verdict string, confidence double, coordination int")
    candles = spark.createDataFrame([], "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double")
    impacts = spark.createDataFrame([], "event_id long, measured_return double, category string, fomo_score int, status string, asset string")
    r = predict.predict(about, candles, impacts).first()
    assert (r.direction, r.probability, r.low, r.used, r.regime, r.main_risk) == ("unknown", 0.05, None, 0, "normal", "unverified")
    assert r.risks == "unverified; no analog; low confidence"
