"""Small literal cases at the borders of the operators."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallymark.operators import columns, graph, ledger, scoring, search, windows
from tallymark.streaming import streams


def test_quantities_addresses_and_keys(spark):
    df = spark.createDataFrame([("0xff",), ("12",), ("0x",), ("-3",), (None,), ("0x" + "f" * 31,)], "q string")
    got = [r[0] for r in df.select(columns.hex_quantity(F.col("q")).cast("string")).collect()]
    assert got == ["255", "12", None, None, None, str(16**31 - 1)]
    a = spark.createDataFrame([("0X" + "A" * 40,), ("0x12",), ("Abcdefgh12345678",), ("abcdefgh12345678",)], "a string")
    assert [r[0] for r in a.select(columns.parse_address(F.col("a"))).collect()] == ["0x" + "a" * 40, None, "Abcdefgh12345678", "abcdefgh12345678"]


def test_self_transfer_counts_on_both_sides(spark):
    from tallymark.operators.rollups import address_summary, native_flow

    t = spark.createDataFrame([("a", "a", 5, dt.datetime(2024, 1, 1), Decimal(7)), ("a", None, 6, dt.datetime(2024, 1, 2), Decimal(1))], "from_address string, to_address string, block_number int, happened_at timestamp, value decimal(38,0)")
    r = address_summary(t).first()
    assert (r.sent, r.received, int(r.sent_total), int(r.received_total), r.counterparties) == (2, 1, 8, 7, 1)
    n = native_flow(t).first()
    assert (int(n.gross_in), int(n.gross_out)) == (0, 8)


def test_floor_and_gate_without_population(spark):
    t = spark.createDataFrame([("x", Decimal(10)), ("x", Decimal(0))], "chain string, value decimal(38,0)")
    assert [tuple(r) for r in ledger.floor_of(t).collect()] == [("x", 1, None)]
    assert int(ledger.floor_of(t, least=1).first().floor) == 10


def test_calibration_closes_the_last_bin(spark):
    cases = spark.createDataFrame([(0.0, True), (0.5, True), (1.0, False)], "confidence double, label boolean")
    got = {r.bin: r.n for r in scoring.calibration(cases).collect()}
    assert got[0] == 1 and got[5] == 1 and got[9] == 1 and len(got) == 10


def test_components_and_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "d"), ("a", "d")], "src string, dst string")
    assert {tuple(r) for r in graph.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
    assert graph.shortest_path(e, "b", "d").first().path == "b>a>d"
    assert graph.shortest_path(e, "a", "x").count() == 0


def test_outflow_reserve_and_gaps(spark):
    rows = [("s", "t", h, Decimal(10), Decimal(0), True) for h in (1, 2, 3, 5)]
    f = spark.createDataFrame(rows, "chain string, address string, height int, outflow decimal(38,0), inflow decimal(38,0), complete boolean")
    got = windows.outflow_windows(f, 2, 15).orderBy("height").collect()
    assert [(r.height, int(r.reserve_before)) for r in got] == [(1, 15), (2, 5)]
    assert windows.outflow_windows(f, 2, 0).first().fraction is None


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, vec_id int, rank int")
    got = {r.vec_id: r.score for r in search.fuse([a, a.where("rank = 1")]).collect()}
    assert got == {10: round(2 / 61, 9), 11: round(1 / 62, 9)}


def test_streams_over_landed_files(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    for i, ids in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(k, t0 + dt.timedelta(minutes=k)) for k in ids], "id long, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = streams.run_once(streams.deduped(streams.ingest(spark, str(tmp_path / "in"), schema), "id", "ts", "1 day"))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]


def test_search_keeps_a_top_k_per_slice(spark):
    rows = [(i, [float((i * 7) % 5 - 2), float((i * 3) % 11 - 5), 1.0]) for i in range(90)] + [(200, None), (201, [1.0]), (202, [0.0, 0.0, 0.0]), (205, [1.0, 2.0, 3.0]), (206, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search.ranked(df.where("vec_id % 5 = 0"), df, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "Broadcast" not in plan
    cos = lambda x, y: round(sum(a * b for a, b in zip(x, y)) / sum(a * a for a in x) ** 0.5 / sum(b * b for b in y) ** 0.5, 6) if x and y and len(x) == len(y) and any(x) and any(y) else None
    want = []
    for i, x in rows:
        if i % 5 == 0:
            best = sorted(((cos(x, y), j) for j, y in rows if j != i), key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))[:4]
            want += [(i, j, s, n) for n, (s, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got.select("query_id", "vec_id", "score", "rank").collect()) == sorted(want)


def test_clusters_hold_all_links(spark):
    from tallymark.operators.evidence import all_links

    e = spark.createDataFrame([("a", "b", 0.6, "x"), ("b", "c", 0.8, "y"), ("p", "q", 0.7, "x"), ("p", "q", 0.9, "x")], "a string, b string, confidence double, relation string")
    got = {r.comp: (r.size, r.confidence, r.links, r.relations) for r in graph.clusters(e).collect()}
    assert got == {"a": (3, 0.6, 2, "x,y"), "p": (2, 0.7, 2, "x")}
    from tallymark.catalog import QUERIES
    from tallymark.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    links, up = all_links(v).collect(), {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in links:
        hi, lo = max(find(r.a), find(r.b)), min(find(r.a), find(r.b))
        up[hi] = lo
    want = {}
    for x in list(up):
        want[find(x)] = want.get(find(x), 0) + 1
    assert {r.comp: r["size"] for r in QUERIES["clusters"](spark, "/root/testdata/sf0.001").collect()} == want


def test_stored_tables_are_dealt_by_chain(spark, tmp_path):
    """Rows are dealt anew before they are written: a small chain is one file, not one of each task that the join had."""
    from tallymark.operators.mentions import stored_table

    rows = spark.range(0, 400, 1, 8).select(F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("chain"), "id")
    got = stored_table(rows, str(tmp_path), 1)
    assert sorted((r.chain, r.id) for r in got.collect()) == sorted((f"c{i % 5}", i) for i in range(400))
    assert [len(list(d.glob("*.parquet"))) for d in sorted((tmp_path / "v1").glob("chain=*"))] == [1] * 5
