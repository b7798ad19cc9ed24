"""Functions beside their registered queries: quantities, reorganisations, headers, vectors, registries."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.functions.registry import Analyzers, Skills
from tallymark.operators import chainlog, market, textsig
from tallymark.sources.labels import map_header
from tallymark.streaming.reorg import Recent


def test_256_bit_quantities(spark):
    rng = random.Random(1)
    values = [0, 1, 255, 10**9, 2**63, 2**64 - 1, 2**128, 2**256 - 1, *[rng.randrange(2**256) for _ in range(20)]]
    rows = spark.createDataFrame([(format(v, "x"), str(v).zfill(78)) for v in values] + [("xyz", None), ("", None), ("f" * 65, None)], "h string, want string")
    assert rows.select(chainlog.uint_digits(F.col("h")).alias("got"), "want").where("not got <=> want").count() == 0
    assert rows.select(chainlog.word_digits(F.lit("12")).alias("x")).first().x is None


def test_logs_of_odd_shapes_are_refused(spark):
    word = lambda n: "0x" + format(n, "064x")
    logs = [([chainlog.TRANSFER, word(1), word(2)], word(5)), ([chainlog.TRANSFER, word(0), word(2), word(9)], "0x"), ([chainlog.TRANSFER, word(1), word(2)], "0x"), ([chainlog.TRANSFER, "0x12", word(2)], word(1)), ([chainlog.APPROVAL_FOR_ALL, word(1), word(2)], word(0)), (["0xabc"], "0x"), ([], "0x"), (None, None)]
    payload = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(logs)], "i int, topics array<string>, data string").select("i", F.to_json(F.struct(F.array(F.struct(F.lit("0xAB").alias("address"), "topics", "data")).alias("result"))).alias("payload"))
    got = {r.i: r for r in chainlog.decode_transfers(chainlog.raw_logs(payload)).collect()}
    assert [got[i].refusal for i in range(8)] == [None, None, "unknown layout", "address unreadable", "approval", "unknown signature", "no topics", "no topics"]
    assert got[1].is_mint and got[1].token_id == "9".zfill(78) and got[0].amount == "5".zfill(78) and got[0].contract == "0xab"
    back = {r.i: r for r in chainlog.decode_approvals(chainlog.raw_logs(payload)).collect()}
    assert back[4].is_revocation and back[4].approved is False and back[0].refusal == "not an approval"


def test_recent_blocks():
    r = Recent([], [], None, window=4)
    assert r.observe(10, "a", "z")[0] == "initial" and r.observe(10, "a", "z")[0] == "duplicate" and r.observe(11, "b", "a")[0] == "extended"
    assert r.observe(14, "x", "y")[0] == "gap" and max(r.at) == 11
    assert r.observe(12, "c", "b")[0] == "extended"
    assert r.observe(11, "b2", "a") == ("reorg", 2, 10, False, False, ["b", "c"]) and r.at == {10: "a", 11: "b2"}
    assert r.observe(9, "w", "v")[0] == "below_window"
    assert r.observe(10, "a2", "q") == ("reorg", 2, None, True, False, ["a", "b2"])
    for n in range(11, 17):
        r.observe(n, f"h{n}", r.at[n - 1])
    assert sorted(r.at) == [13, 14, 15, 16]
    r.final = 15
    assert r.observe(15, "other", "h14") == ("reorg", 2, 14, False, True, []) and r.at[15] == "h15"


def test_headers():
    assert map_header(["address", "distinct_name", "name"]) == {"address": 0, "label": 1, "entity": 2}
    assert map_header(["Wallet Address", "Token Name", "Type"]) == {"address": 0, "entity": 1, "category": 2}
    assert "address" not in map_header(["foo", "bar"])


def test_vector_duplicates(spark):
    rng = random.Random(3)
    base = [rng.gauss(0, 1) for _ in range(16)]
    near = [x + rng.gauss(0, 0.02) for x in base]
    rows = [(1, base), (2, near), (3, [-x for x in base]), (4, base), (5, [0.0] * 16)] + [(10 + i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(30)]
    got = textsig.vector_duplicates(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v").collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_lineage_refuses_cycles(spark):
    nodes, edges = spark.createDataFrame([(1, True), (2, True)], "node int, observed boolean"), spark.createDataFrame([(1, 2), (2, 1)], "node int, parent int")
    with pytest.raises(ValueError, match="itself"):
        market.lineage(nodes, edges)


def test_registries(spark):
    a, s = Analyzers(), Skills()
    a.add("one")(lambda df, least=0: df.where(F.col("id") >= least).select("id"))
    a.add("two")(lambda df: df.select((F.col("id") * 2).alias("twice")))
    assert a.run("one", spark.range(5), least=3).count() == 2
    assert a.run_all(spark.range(5)).columns == ["id", "analyzer", "twice"]
    with pytest.raises(ValueError):
        a.add("one")(lambda df: df)
    s.add("join", ("left", "right"))(lambda x, y: x.join(y, "id"))
    assert s.run("join", {"left": spark.range(3), "right": spark.range(2)}).count() == 2
    with pytest.raises(ValueError, match="right"):
        s.run("join", {"left": spark.range(3)})


def test_text_model_on_the_held_out_quarter(spark):
    from tallymark.operators import models
    from tallymark.views import Views

    v = Views(spark, "/root/testdata/sf0.01")
    got = models.quality_model(v).where("held_out").join(v.labels, "doc_id").collect()
    right = sum(r.predicted == (r.quality == 1) for r in got)
    most = max(sum(r.quality == 1 for r in got), sum(r.quality == 0 for r in got))
    assert len(got) > 60 and right > most


@pytest.mark.parametrize("slice_rows", [2000, 3])
def test_vector_duplicates_lose_none(spark, slice_rows):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 12))
    v = np.concatenate([base, base + rng.normal(scale=0.25, size=base.shape), base[:5] * 3, np.zeros((1, 12))])
    got = textsig.vector_duplicates(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>"), "id", "v", 0.95, slice_rows)
    norm = np.linalg.norm(v, axis=1)
    cosine = (v @ v.T) / np.maximum(norm[:, None] * norm[None, :], 1e-300)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if norm[a] and norm[b] and cosine[a, b] >= 0.95)


@pytest.mark.parametrize("head", [1.0, 0.0])
def test_vector_duplicates_write_each_vector_once(spark, monkeypatch, head):
    """Vectors without structure are not written once a cell; with a bound that says nothing, all are still met; lengths do not mix."""
    import numpy as np

    rows = []
    monkeypatch.setattr(textsig, "written", lambda df, f=textsig.written: (out := f(df), rows.append(out.count()))[0])
    monkeypatch.setattr(textsig, "TILE", 64)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 40)) * np.where(np.arange(40) < 16, head, 1)
    v = np.concatenate([v, v[:50] + rng.normal(scale=0.2, size=(50, 40))])
    data = [(f"k{k:03}", x.tolist()) for k, x in enumerate(v)] + [("short", v[0][:39].tolist()), ("null", None)]
    got = textsig.vector_duplicates(spark.createDataFrame(data, "id string, v array<double>"), "id", "v").collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    cosine = u @ u.T
    want = {(f"k{a:03}", f"k{b:03}"): cosine[a, b] for a in range(len(v)) for b in range(a + 1, len(v)) if cosine[a, b] >= 0.95}
    assert sum(rows) <= len(data) and len(want) > 20 and len(got) == len(want)
    assert all(abs(want[r.a, r.b] - r.cosine) < 1e-12 for r in got)


@pytest.mark.parametrize("threshold", [0.85, 0.95, 1.0])
def test_simhash_pairs_lose_none(spark, threshold):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(25)]
    prints += [p ^ sum(1 << i for i in rng.sample(range(64), k)) for p in prints for k in (0, 3, 9, 10)]
    rows = [(k, p & 0xFFFFFFFF, p >> 32) for k, p in enumerate(prints)]
    got = textsig.simhash_pairs(spark.createDataFrame(rows, "id long, low long, high long"), "id", threshold).collect()
    first = {}
    for k, p in enumerate(prints):
        first.setdefault(p, k)
    want = {(a, b) for p, a in first.items() for q, b in first.items() if a < b and 1 - (p ^ q).bit_count() / 64 >= threshold}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_simhash_pairs_are_compared_where_filed(spark, monkeypatch):
    """Fingerprints are filed under few keys and met without a join; a dense group is handed on in parts, each pair once."""
    assert [math.comb(9 + k, k) for k in (textsig.block_plan(n, 9)[1] for n in (50_000, 3_000_000))] == [10, 55]
    monkeypatch.setattr(textsig, "HANDED", 50)
    rng = random.Random(9)
    prints = sorted({rng.getrandbits(64) for _ in range(40)} | {0xABCDEF ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6))) for _ in range(120)})
    got = textsig.simhash_pairs(spark.createDataFrame([(f"é{k}", p & 0xFFFFFFFF, p >> 32) for k, p in enumerate(prints)], "id string, low long, high long"), "id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    want = {(*sorted((f"é{i}", f"é{j}")), 1 - (p ^ q).bit_count() / 64) for i, p in enumerate(prints) for j, q in enumerate(prints) if i < j and (p ^ q).bit_count() <= 9}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) > 1000 and len(rows) == len(want) and set(rows) == want


def test_simhash_counts_bits_in_lanes(spark):
    """Long texts, texts of one gram or none, and marks that are no words."""
    import hashlib

    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab c_ D9 é".split()) for _ in range(n)) for n in (0, 2, 3, 4, 5000)] + ["--a,,b!!c  ", None, "ÀB Straße İx a"]
    got = {r.id: (r.low, r.high) for r in textsig.simhash(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect()}
    for k, t in enumerate(texts):
        words = re.findall("[a-z0-9_]+", (t or "").lower())
        grams = [hashlib.md5(" ".join(words[i : i + 3]).encode()).hexdigest() for i in range(len(words) - 2)]
        assert got[k] == tuple(sum(1 << b for b in range(32) if 2 * sum(int(h[at : at + 8], 16) >> b & 1 for h in grams) > len(grams)) for at in (0, 8)), t


def test_blocks_leave_a_key():
    for prints in (1, 10**4, 10**6, 10**9):
        for apart in (0, 3, 9):
            blocks, k = textsig.block_plan(prints, apart)
            assert len(blocks) == apart + k and sum(w for _, w in blocks) == 64 and [s for s, _ in blocks] == [sum(w for _, w in blocks[:i]) for i in range(len(blocks))]


def test_minhash_pairs_shuffle_no_candidates(spark):
    """Pairs come once each; bands are met and left out before words are joined, and nothing is made distinct after it."""
    rng = random.Random(5)
    texts = [[f"w{i}" for i in rng.sample(range(40), 30)] for _ in range(8)]
    texts += [t[: 30 - k] + [f"n{i}-{j}" for i in range(k)] for j, t in enumerate(texts) for k in (0, 1, 2, 5)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, text string")
    signed = textsig.minhash(docs, "id", "text")
    found = textsig.minhash_pairs(signed, "id")
    band = {r.id: [tuple(r.signature[4 * i : 4 * i + 4]) for i in range(4)] for r in signed.collect()}
    least = {}
    for k, t in enumerate(texts):
        least.setdefault(frozenset(t), k)
    want = {(a, b) for x, a in least.items() for y, b in least.items() if a < b and any(p == q for p, q in zip(band[a], band[b])) and 10 * len(x & y) >= 8 * len(x | y)}
    got = [(r.a, r.b) for r in found.collect()]
    assert want and len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def test_signatures_are_of_each_word_once(spark, monkeypatch):
    """The least digests are those of MD5 in text; a word is worked out once while it is remembered."""
    import hashlib

    import pyarrow as pa

    sets = [["a", "b", "c"], ["b"], ["c", "z9"], ["a", "b", "c"]]
    want = [[min(hashlib.md5(f"{i}:{w}".encode()).hexdigest() for w in s) for i in range(16)] for s in sets]
    known = textsig.Digests(16)
    assert textsig.signatures(pa.array(sets), known).to_pylist() == want and len(known.seen) == 4
    assert textsig.signatures(pa.array(sets).slice(1, 2), known).to_pylist() == want[1:3]
    tie = textsig.Digests(1)
    tie.seen, tie.halves = {"a": 0, "b": 1}, textsig.np.array([[[5, 9]], [[5, 2]]], textsig.np.uint64)
    assert textsig.signatures(pa.array([["a", "b"]]), tie).to_pylist() == [["0000000000000005" + "0000000000000002"]]
    monkeypatch.setattr(textsig, "REMEMBERED", 3)
    full = textsig.Digests(16)
    assert [textsig.signatures(pa.array(sets[k:]), full).to_pylist() for k in (1, 0)] == [want[1:], want] and len(full.seen) == 3
    df = spark.createDataFrame([(k, " ".join(s)) for k, s in enumerate(sets)] + [(9, "--"), (10, None)], "id long, t string")
    assert {r.id: r.signature for r in textsig.minhash(df, "id", "t").collect()} == dict(enumerate(want))


def test_words_are_not_shuffled_by_pair(spark):
    """A group of near copies: one join, of bands that two sets share."""
    texts = [" ".join(f"w{i}" for i in range(40)) + f" n{k}" for k in range(30)] + [" ".join(f"x{k}_{i}" for i in range(9)) for k in range(20)]
    found = textsig.minhash_pairs(textsig.minhash(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text"), "id")
    got = {(r.a, r.b): r.jaccard for r in found.collect()}
    assert got and set(got.values()) == {40 / 42} and all(b < 30 for _, b in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_clusters_sign_a_set_once(spark, monkeypatch):
    """Copies are folded before they are signed; texts without words stand alone."""
    signed, real = [], textsig.signed_sets
    monkeypatch.setattr(textsig, "signed_sets", lambda words, *a: signed.append(words.count()) or real(words, *a))
    near = " ".join(f"w{i}" for i in range(40))
    texts = [near + " a", near + " b", near + " a", "x y", "y x", "--", None, "z"]
    got = {r.id: r.cluster for r in textsig.near_clusters(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    assert got[0] == got[2] == 0 and got[1] in (0, 1) and got[3] == got[4] == 3 and [got[k] for k in (5, 6, 7)] == [5, 6, 7] and signed == [4]
