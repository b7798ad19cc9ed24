"""The pipeline, stage by stage, against brute force on real documents."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from tallymark.llm import common, mixing, sentencepiece_codec

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_pipeline(spark):
    docs = common.documents(spark, SF)
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF))
        assert docs.columns == columns
        kept[name] = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    good = {d: t for d, t, _ in kept["quality"]}
    assert 100 < len(good) < 200 and all(len(t.split()) >= 50 for t in good.values())
    last = {}
    for d, t in good.items():
        last[t] = max(d, last.get(t, d))
    assert {d for d, _, _ in kept["exact"]} == set(last.values())
    sets = {d: shingles(t) for d, t, _ in kept["exact"]}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                hi, lo = max(find(a), find(b)), min(find(a), find(b))
                root[hi] = lo
    assert {d for d, _, _ in kept["near"]} == {find(d) for d in ids}
    size = Counter()
    for _, t, s in kept["near"]:
        size[s] += len(t.split())
    copies = Counter(d for d, _, _ in kept["mix"])
    assert max(copies.values()) <= mixing.MAX_EPOCHS and set(copies) <= {d for d, _, _ in kept["near"]}
    mixed = sum(len(t.split()) for _, t, _ in kept["mix"])
    assert 0.9 * 1.5 * sum(size.values()) < mixed <= 1.5 * sum(size.values())
    lib = sentencepiece_codec.codec(sentencepiece_codec.default_model()).lib
    want = Counter()
    for d, t, _ in kept["mix"]:
        tokens = lib.encode(t)
        want[d, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def odd_documents(spark, folder):
    """Null, empty and short texts, repeated rows, ties of id, null ids, languages and sources, near copies, and columns with clashing names."""
    import random

    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    clean = [words(120) for _ in range(40)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in clean[:6]]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3]) for i, t in enumerate(clean)]
    rows += [(100 + i, t, "en", "s1") for i, t in enumerate(near)]
    rows += [rows[0], rows[0], (7, clean[3], "en", "s1"), (None, clean[4], "en", "s1"), (None, words(130), None, None), (None, None, None, None), (200, None, "en", "s1"), (201, "", "en", None), (202, "a few words only", "en", "s2"), (203, "spam " * 300, "en", "s2")]
    docs = spark.createDataFrame([(*r, i, "x", 1, 2.0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row string, shard int, kept double")
    docs.write.parquet(f"{folder}/documents.parquet")
    return rows, clean


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows, clean = odd_documents(spark, tmp_path)
    docs, left = common.documents(spark, str(tmp_path)), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
        left[name] = Counter((r.doc_id, r.text) for r in docs.collect())
    assert left["quality"] == Counter((d, t) for d, t, *_ in rows if t and len(t.split()) >= 50 and not t.startswith("spam"))
    assert {t for _, t in left["exact"]} == {t for _, t in left["quality"]} and all(n == 1 for n in left["exact"].values())
    assert (7, clean[3]) in left["exact"] and (4, clean[4]) in left["exact"]
    assert {d for d, _ in left["near"]} == {d for d, _ in left["exact"] if d is None or d < 100}
    assert set(left["mix"]) <= set(left["near"]) and max(left["mix"].values()) <= mixing.MAX_EPOCHS
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in out.collect()) == Counter({d: 0 for d, _ in left["mix"]}) + Counter(d for d, _ in left["mix"].elements())


def test_pipeline_on_an_empty_table(spark, tmp_path):
    odd_documents(spark, tmp_path / "some")
    common.documents(spark, str(tmp_path / "some")).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
