"""Recorded blocks and quantities against plain Python, on rows that take every branch."""

import json
import random
import time

from pyspark.sql import functions as F

from tallymark.operators import blocks, columns

GOOD = {"number": "0x10", "hash": "0xAB12", "parentHash": "0xcd34", "timestamp": "0x5f5e1000", "gasUsed": "0x5", "gasLimit": "0x6"}
A, B = "0x" + "a" * 40, "0x" + "B" * 40


def test_quantities_of_256_bits_equal_python(spark):
    random.seed(3)
    texts = [hex(random.getrandbits(n)) for n in range(1, 257)] + [str(random.getrandbits(n)) for n in range(1, 257)] + ["0X" + "F" * 64, " 0x00ff ", "007", "0x0", "0"]
    bad = ["0x", "", " ", "-1", "true", "1.5", "0x1" + "0" * 64, "0xg", None, "1e3"]
    df = spark.createDataFrame([(t,) for t in texts + bad], "q string").select("q", columns.quantity_digits(F.col("q")).alias("d"), columns.hex_quantity(F.col("q")).cast("string").alias("n"))
    for r in df.collect():
        want = None if r.q in bad else int(r.q, 16 if "x" in r.q.lower() else 10)
        assert r.d == (None if want is None else str(want).zfill(78)), r.q
        assert r.n == (str(want) if want is not None and want < 10**38 else None), r.q


def test_quantities_run_fast_enough(spark):
    """200,000 quantities of 256 bits; limbs grown one by one took minutes.  Nested and by batches are the same, also before odd line ends."""
    wide = spark.range(0, 200_000, 1, 4).select(F.concat(F.lit("0x"), F.sha2(F.col("id").cast("string"), 256)).alias("q"))
    begun = time.time()
    assert wide.select(F.max(columns.quantity_digits(F.col("q")))).first()[0] == str(int(wide.select(F.max("q")).first()[0], 16)).zfill(78)
    assert time.time() - begun < 30
    odd = ["0x12\u2028", "12\u0085", "0x12\n", "12\r\n", "0X0", "00", "0x" + "0" * 70 + "f", "1" * 78, "1" * 79, "٣", "0xé", None, ""]
    some = wide.limit(50).union(spark.createDataFrame([(x,) for x in odd], "q string"))
    got = some.select("q", columns.quantity_digits(F.col("q")).alias("x"), columns.nested_digits(F.col("q")).alias("y")).collect()
    assert all(r.x == r.y for r in got) and [r.x and int(r.x) for r in got[50:]] == [None, None, 18, 12, 0, 0, 15, int("1" * 78), None, None, None, None, None]


def judge(spark, *payloads):
    df = spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p), i) for i, p in enumerate(payloads)], "id int, payload string, stated_by int")
    return blocks.judged_blocks(df)


def test_headers(spark):
    bad = [None, "", "[]", "{", "{}", {**GOOD, "number": True}, {**GOOD, "timestamp": -4}, {**GOOD, "hash": "12"}, {**GOOD, "gasUsed": "0x7"}, {**GOOD, "gasUsed": "0x" + "f" * 64}]
    good = [GOOD, {**GOOD, "number": 16}, {**GOOD, "gasUsed": "?"}, {**GOOD, "miner": "0x1"}, {**GOOD, "transactions": "none"}, {**GOOD, "transactions": ["0xaa", "0xbb"]}]
    got = {r.id: r for r in judge(spark, *bad, *good).collect()}
    assert [got[i].accepted for i in range(len(bad))] == [False] * len(bad)
    assert all(got[i].accepted and got[i].number == 16 for i in range(len(bad), len(bad) + len(good)))
    assert list(got[0].issues) == list(got[3].issues) == ["block: expected an object"]
    assert len(got[4].issues) == 4 and list(got[5].issues) == ["number: unreadable quantity"] and list(got[8].issues) == ["gasUsed: exceeds gasLimit"]
    assert got[10].block_hash == "0xab12" and got[15].stated == 2 and list(got[15].entries) == [] and got[14].stated == 0


def test_transactions(spark):
    t = {"hash": "0xFF00", "from": A, "to": B, "value": "0x1"}
    entries = [t, {**t, "value": None}, {k: x for k, x in t.items() if k != "value"}, {**t, "to": None}, {**t, "to": "?"}, "0xhash", None, {**t, "hash": "ff", "from": 5}, {**t, "nonce": "7", "gas": "0xa", "gasPrice": "?", "input": "0x1234567", "transactionIndex": "0x9"}, "{oops"]
    got = {r.place: r for r in blocks.transactions(judge(spark, {**GOOD, "transactions": entries})).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert sorted(p for p, r in got.items() if r.accepted) == [0, 2, 3, 8]
    assert got[0].recipient == B.lower() and got[2].value_digits == "0" * 78 and got[3].recipient is None
    assert list(got[7].issues) == ["hash: missing or malformed", "from: unreadable address"] and list(got[9].issues) == ["transaction: expected an object"]
    assert (got[8].nonce, got[8].gas_limit, got[8].gas_price_digits, got[8].input_size, got[8].tx_index, got[8].stated_by) == (7, 10, None, 3, 9, 0)


def test_quality_and_empty(spark):
    t = {"hash": "0xFF00", "from": A, "value": "0x1"}
    rows = [{**GOOD, "gasUsed": "0x0"}, GOOD, {**GOOD, "transactions": ["0xaa"]}, {**GOOD, "transactions": [t, {}]}, {**GOOD, "timestamp": "0xffffffff", "transactions": [t]}, {**GOOD, "timestamp": "1", "transactions": [t]}]
    judged = judge(spark, *rows)
    got = {r.id: r for r in blocks.assessed(judged, "2024-01-01", record=F.lit("r")).collect()}
    assert [got[i].findings for i in range(6)] == ["", "gas_without_transactions", "transactions_expanded", "transactions_complete", "timestamp_future", "timestamp_ancient"]
    assert [got[i].complete for i in range(6)] == [True, True, False, False, True, True] and [got[i].plausible for i in range(6)] == [True, False, True, True, False, False]
    floor = {r.id: r for r in blocks.assessed(judged, "2024-01-01", floor=F.lit("9"), record=F.when(F.col("id") > 0, "r"), logs_missing=F.col("id") == 1).collect()}
    assert (floor[0].incomplete_reason, floor[0].bounded) == ("selective_capture,provenance", False)
    assert (floor[1].incomplete_reason, floor[1].bounded) == ("logs_captured,selective_capture", False)
    assert (floor[2].incomplete_reason, floor[2].bounded) == ("selective_capture", True)
    none = judge(spark, GOOD).limit(0)
    assert blocks.assessed(none, "2024-01-01").count() == blocks.transactions(none).count() == 0
