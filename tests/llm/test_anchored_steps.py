"""Parts of the substring operators are worked off in bounded steps, with the same results as at once."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import anchored, suffix_dedup


def test_a_part_is_sorted_in_bounded_steps(monkeypatch):
    """Open runs of 200 anchors: no step sorts much more than STEP_BYTES, and repeats are those of brute force."""
    rng, texts, items = random.Random(4), [], []
    for i in range(800):
        stock = random.Random(i % 200).choices("abc", k=120)
        at = rng.randrange(20)
        texts.append("".join(stock[at : at + 50 + rng.randrange(40)]).encode())
        items.append((i % 200 * 7919 + 1, i, i % 9, i // 3, 0 if i % 3 == 0 else 300 * (i % 3), len(texts[-1]) - 49))
    items = np.array(items, anchored.RUNS)
    sizes = []

    class Seen(suffix_dedup.ByteRepeats):
        def buckets(self, pieces):
            sizes.append(sum(map(len, pieces)))
            return super().buckets(pieces)

    monkeypatch.setattr(anchored, "STEP_BYTES", 4096, raising=False)
    found = Seen().repeats_of([anchored.cut_out(items[i::4], texts[i::4]) for i in range(4)])
    got = {(int(x["doc"]), int(x["row"]), int(x["at"]) + j) for x in found for j in range(int(x["n"]))}
    first, every = {}, []
    for x, t in zip(items.tolist(), texts):
        for j in range(x[5]):
            w = t[j : j + 50]
            first[w] = min(first.get(w, x[2]), x[2])
            every.append((w, x[2], x[3], x[4] + j))
    assert got == {(d, r, a) for w, d, r, a in every if d > first[w]} and got
    assert sum(sizes) == sum(map(len, texts)) and max(sizes) < 3 * 4096


def test_steps_keep_equal_keys_together():
    keys = np.repeat(np.arange(500, dtype=np.uint64), np.arange(500) % 7)
    np.random.RandomState(1).shuffle(keys)
    found = list(anchored.steps(keys, 1, 100))
    assert sorted(np.concatenate(found)) == list(range(len(keys))) and max(map(len, found)) < 300
    assert sum(len(np.unique(keys[s])) for s in found) == len(np.unique(keys))


def test_spans_are_merged_whatever_their_length():
    spans = np.zeros(6, anchored.RUNS)
    spans["row"] = [1, 1, 1, 1, 2, 2]
    spans["at"], spans["n"] = [100, 0, 100, 220, 0, 9], [120, 100, 120, 100, 5, 1]
    got = [(int(x["row"]), int(x["at"]), int(x["n"])) for x in anchored.long_spans(spans)]
    assert got == [(1, 0, 127), (1, 127, 127), (1, 254, 66), (2, 0, 5), (2, 9, 1)]


def test_a_task_takes_the_parts_of_its_number(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some passage that is long enough to be repeated in other documents "), F.col("id").cast("string")).alias("text"))
    plan = suffix_dedup.dedup_spans(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(part#\d+, \d+\), REPARTITION", plan)
