"""What the steps of large jobs must hold: ties, odd orders, many rows of one moment."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.catalog import QUERIES
from tallymark.operators import graph
from tallymark.operators.evidence import all_links, linkers
from tallymark.operators.ledger import best_labels, canonical
from tallymark.operators.market import lineage, nearest_other
from tallymark.operators.pages import STEP, extract
from tallymark.streaming import reorg
from tallymark.streaming.reorg import Recent
from tallymark.streaming.streams import run_once
from tallymark.views import Views

SF = "/root/testdata/sf0.001"


def test_nearest_other_takes_the_least_of_events_at_one_moment(spark):
    rng, day = random.Random(3), 1_704_067_200
    rows = [(i, rng.choice("xyz"), day + rng.choice((0, 5, 3599, 3600, 9000, 90_000, 200_000)), float(i)) for i in rng.sample(range(400), 120)]
    df = spark.createDataFrame(rows, "event_id long, asset string, s long, measured_return double").selectExpr("event_id", "asset", "timestamp_seconds(s) AS first_seen", "measured_return")
    want = set()
    for i, a, s, _ in rows:
        for other in {"x", "y", "z"} - {a}:
            near = min(((abs(s - t), t, j) for j, b, t, _ in rows if b == other and abs(s - t) < 86_400), default=None)
            if near:
                want.add((a, other, i, float(near[2])))
    assert {(r.asset_a, r.asset_b, r.event_a, r.return_b) for r in nearest_other(df).collect()} == want


def test_nearest_other_reads_an_hour_once(spark):
    df = spark.sql("SELECT id AS event_id, concat('a', id % 2) AS asset, timestamp_seconds(id) AS first_seen, 0D AS measured_return FROM range(10)")
    assert "unboundedfollowing" not in nearest_other(df)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_rows_of_a_chain_are_not_shuffled_by_chain(spark):
    for name in ("gate", "selective_capture", "det_whale"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan
        assert not [j for j in re.findall(r"Join [^\n]*", plan) if re.search(r"\(chain#\d+ = chain#\d+\)(?! AND)", j.replace("((", "(")) and "strategy=broadcast" not in j and "block_number" not in j and "number" not in j]


def test_lines_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Views(spark, SF).txn._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(l_orderkey#\d+L, l_linenumber", plan)  # copies are numbered where the order's lines meet


def test_links_read_transfers_once(spark):
    plan = all_links(Views(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_pages_are_handed_on_in_small_steps(spark, tmp_path):
    """A task that reads 300 pages never has as many alive."""
    rows = spark.range(300).repartition(1).selectExpr("id AS page_id", "'http://a/' AS url", "CASE WHEN id % 50 = 7 THEN NULL ELSE concat('<title>t', id, '</title><meta name=k content=v', id, '><a href=/', id, '>x</a>') END AS html")
    got = {r.page_id: r for r in extract(rows, "page_id", "url", "html").collect()}
    assert len(got) == 300 and got[8].title == "t8" and got[8].meta == {"k": "v8"} and got[8].links == ["http://a/8"] and got[7].meta == {} and got[7].links == []
    # The batches that a task hands on, as Arrow sees them.
    sizes = extract(rows, "page_id", "url", "html").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) <= 10_000 and STEP < 300


def test_reorgs_are_judged_the_same_in_steps(spark, tmp_path, monkeypatch):
    """A batch that comes out of order and is cut into small steps, with finality, against all at once."""
    rng, rows = random.Random(5), []
    for a in range(60):
        n = rng.choice((a, a, a, max(a - 3, 0), a + 2))
        rows.append(("c", a, n, f"h{a}", f"h{a - 1}"))
    want, recent = [], Recent([], [], None, 16)
    for _, a, n, h, p in rows:
        v = recent.observe(n, h, p)
        want.append((a, v[0], v[1], v[2], list(v[5])))
        recent.final = max(-1 if recent.final is None else recent.final, max(recent.at) - 4)
        assert list(recent.at) == sorted(recent.at) and len(recent.at) <= 16
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "chain string, arrival long, number long, hash string, parent string")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(reorg, "STEP", 7)
    got = run_once(reorg.reorgs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 4, 16)).orderBy("arrival").collect()
    assert [(r.arrival, r.verdict, r.depth, r.ancestor, list(r.orphaned)) for r in got] == want


def test_lineage_of_long_chains_and_cycles(spark):
    nodes = spark.range(21).selectExpr("id AS node", "id <> 3 AS observed")
    chain = spark.range(1, 21).selectExpr("id AS node", "id - 1 AS parent")
    assert {r.node: (r.ancestors, r.roots, r.grounded) for r in lineage(nodes, chain).collect()} == {n: (n, 1, True) for n in range(21)}
    with pytest.raises(ValueError, match="itself"):
        lineage(nodes, chain.union(spark.sql("SELECT 0L, 4L")))


def test_arrivals_are_ordered_in_runs(tmp_path, monkeypatch):
    """Many runs, ties and nulls, with no more than a few runs' steps in memory; nothing is left on the disk."""
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    monkeypatch.setattr(reorg.tempfile, "tempdir", None)
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(300)]), rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]), rng.choice([None, "p"])) for _ in range(1000)]
    cols = lambda part: pa.table(dict(zip(reorg.ARRIVING.names, map(list, zip(*part)))), schema=reorg.ARRIVING)
    key = lambda r: tuple((x is None, x or 0 if i < 2 else x or "") for i, x in enumerate(r))
    written, real = [], pa.ipc.new_file
    monkeypatch.setattr(pa.ipc, "new_file", lambda *a: written.append(1) or real(*a))
    got = list(reorg.in_order((cols(rows[k : k + 9]) for k in range(0, 1000, 9)), 7, 40))
    assert got == sorted(rows, key=key) and len(written) == 22 and not list(tmp_path.iterdir())
    assert list(reorg.in_order([], 7, 40)) == []


def test_withdrawal_runs_a_batch_once(spark, tmp_path):
    """The changes of a batch are written from one run of its stream."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    schema = "chain string, arrival long, verdict string, number long, hash string, crossed_finality boolean, orphaned array<string>"
    rows = [("c", 1, "initial", 1, "a", False, []), ("c", 2, "extended", 2, "b", False, None), ("c", 3, "reorg", 2, "x", False, ["b"])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = reorg.withdrawn(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).mapInPandas(count, schema), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == [("c", 1, "a"), ("c", 2, "x")] and seen.value == 3


def test_components_shrink(spark, monkeypatch):
    """Chains, stars, cliques, loops and nulls against brute force; edges are written whole once, and then fewer."""
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(199, i) for i in range(100, 199)] + [(300 + i, 300 + j) for i in range(12) for j in range(12)] + [(400, 400), (None, 401), (402, None), (403, 404), (404, 403)]
    order = rng.sample(range(1000), 1000)
    pairs = [tuple(None if x is None else f"n{order[x]}" for x in p) for p in pairs]
    group = {x: x for p in pairs for x in p if x}
    for _ in range(100):
        for x, y in pairs:
            if x and y:
                group[x] = group[y] = min(group[x], group[y])
    sizes, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: sizes.append(df.columns) or real(df))
    got = graph.components(spark.createDataFrame(pairs, "src string, dst string"))
    assert {r.node: r.comp for r in got.collect()} == group and got.count() == len(group)
    rounds = sizes.count(["a", "b"])
    assert 2 <= rounds <= 8
    assert graph.components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_links_of_short_keys(spark):
    """Keys of 16 bytes give the evidence that their text gives; the stored transfers hold the short ones."""
    v = Views(spark, SF)
    t, best = canonical(v.txn, v.blk), best_labels(v.lbl)
    short = t.withColumn("tx_key", F.unhex(F.substring("tx_key", 3, 32)))
    rows = lambda c: sorted(tuple(r) for r in linkers(c, best).collect())
    assert rows(short) == rows(t) and len(rows(t)) > 100
    plan = all_links(v)._jdf.queryExecution().analyzed().toString()
    assert "hex(" in plan
