"""Security flags and promotion of detectors on small rows."""

from pyspark.sql import functions as F

from tallymark.operators import scoring
from tallymark.operators.ledger import canonical, classify, with_entities
from tallymark.views import Views


def test_security_flags(spark):
    rows = [("a", "b", 1)] * 5 + [("a", None, 10**15), ("a", "a", 0), ("m", "a", 10**14), (None, "c", 5), ("d", "e", None)] + [("f", "g", 10**15)] * 9 + [("h", "f", 10**15)]
    t = spark.createDataFrame(rows, "from_address string, to_address string, value long")
    m = spark.createDataFrame([("m",), ("m",), (None,)], "address string")
    got = {r.address: (r.n, r.mixer, r.dust, r.top_share, r.flags) for r in scoring.security(t, m).collect()}
    assert got["a"] == (8, 1, 5, 0.625, "mixer,dust") and got["b"] == (5, 0, 5, 1.0, "dust") and got["c"] == (1, 0, 1, 0.0, "")
    assert got["f"] == (10, 0, 0, 0.9, "concentrated") and got["g"][4] == "concentrated" and got["e"][4] == "" and set(got) == set("abcdefghm")
    assert scoring.security(t.limit(0), m).count() == 0


def test_promotion(spark):
    rows = [("good", i % 2 == 0, i % 2 == 0, 0.95 if i % 2 == 0 else 0.05) for i in range(100)] + [("few", True, i % 2 == 0, 0.5) for i in range(99)] + [("all", True, True, 1.0)] * 100
    rows += [("bold", True, i % 2 == 0, 0.9) for i in range(100)] + [("shy", True, i % 10 > 0, 0.5) for i in range(100)] + [("null", None, None, None)]
    got = {r.detector: r for r in scoring.backtest(spark.createDataFrame(rows, "detector string, predicted boolean, label boolean, confidence double")).collect()}
    assert {d: r.blockers for d, r in got.items()} == {"good": "", "few": "too few cases", "all": "no negative cases", "bold": "overconfident", "shy": "", "null": "too few cases"}
    assert [d for d, r in got.items() if r.underconfident] == ["shy"] and got["bold"].excess == 0.4 and got["shy"].calibration_error == 0.4 and got["good"].promotable


def test_exchange_flow_of_one_operator(spark):
    """Who carries the flow, flow between exchanges, and when its absence may be said."""
    labels = spark.createDataFrame([(f"x{i}", f"op{i // 2}", 0.5 + i / 10) for i in range(4)], "address string, entity string, confidence double").selectExpr("*", "'exchange' AS category")
    rows = [("one", "u", "x0", 9)] * 9 + [("one", "u", "x2", 1)] * 2 + [("both", "u", "x0", 5)] * 6 + [("both", "x2", "u", 4)] * 6 + [("own", "x0", "x2", 7)] * 12
    rows += [("few", "u", "x0", 7)] * 9 + [("void", "u", "x0", 0)] * 12 + [("none", "u", "w", 3), ("gap", "u", "w", 3)] + [("tie", "u", "x0", 2), ("tie", "u", "x2", 2)] * 5
    t = spark.createDataFrame(rows, "chain string, from_address string, to_address string, value long").withColumn("value", F.col("value").cast("decimal(38,0)"))
    window = spark.createDataFrame([("none", "none"), ("gap", "gaps"), ("one", "none")], "chain string, limitation string")
    judge = lambda known: {r.chain: tuple(r)[1:] for r in scoring.exchange_direction(classify(with_entities(t, known)), known, window).collect()}
    got = judge(labels)
    assert got["one"] == (11, 1.0, "inflow", "op0", round(81 / 83, 9), True, 2, 0.5)
    assert got["both"] == (12, round(6 / 54, 9), "balanced", "op0", round(30 / 54, 9), False, 2, None)
    assert got["own"] == (12, None, "insufficient", None, None, None, 2, None) and got["few"] == (9, 1.0, "insufficient", None, None, None, 1, None)
    assert got["void"] == (12, None, "insufficient", None, None, None, 1, None) and got["tie"][3:6] == ("op0", 0.5, False)
    assert got["none"] == (0, None, "no flow", None, None, None, 0, None) and got["gap"][2] == "insufficient"
    assert {r[2] for r in judge(labels.limit(0)).values()} == {"insufficient"}


def test_exchange_flow_knows_exchanges_only(spark):
    """Bridges, pools and contracts are no exchanges, and each chain names the operator that carries most."""
    v = Views(spark, "/root/testdata/sf0.001")
    exchanges = {r.address for r in v.lbl.where("category = 'exchange'").collect()}
    sides = [(r.chain, r.to_address in exchanges or r.from_address in exchanges) for r in canonical(v.txn, v.blk).collect()]
    got = {r.chain: r for r in scoring.exchange_direction_of(v).collect()}
    assert {c: r.attributed for c, r in got.items()} == {c: sum(x for d, x in sides if d == c) for c in got}
    assert all(0 < r.top_share <= 1 and r.top_entity for r in got.values() if r.attributed >= 10)
