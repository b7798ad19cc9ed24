"""The ten operators against brute force, on odd inputs: nulls, empty and long texts, ties, repeated rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import anchored, common, exact_dedup, language_id, line_dedup, mixing, ngram_join, quality_rules, recompression_dedup, sentencepiece_codec, suffix_dedup, token_output

#: Columns of documents, and more that clash with names used inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string, body string, n int, top int, shard int, epoch int, part int, node int"
EXTRA = ("k", "d", "b", 1, 2, 3, 4, 5, 6)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make(n_docs=60, seed=3):
    """Documents with shared lines, passages, copies, near copies, runs, nulls and one long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(70))
    line = "  A common line that many documents hold\t"
    rows, texts = [], []
    for i in range(n_docs):
        kind = rng.randint(0, 6)
        if kind == 0 and texts:
            text = rng.choice(texts)
        elif kind == 1 and texts and len((base := rng.choice(texts)).split()) > 3:
            w = base.split(" ")
            w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        else:
            text = " ".join(word() for _ in range(rng.randint(0, 90)))
            if kind == 2:
                text += "\n" + line + "\nB c\n" + line.upper()
            if kind == 3:
                text += " " + passage + " " + word()
            if kind == 4:
                text += " " + "spam " * rng.randint(0, 60) + "ab ba " * rng.randint(0, 30)
        texts.append(text)
        rows.append((i * 3 + 1, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None]), None, *EXTRA))
    rows += [(None, "null id " + passage, None, None, None, *EXTRA), (500, None, "en", "s1", None, *EXTRA), (501, "", "en", "s1", 0, *EXTRA), (502, " \n\t", None, "s2", 3, *EXTRA)]
    rows.append((503, " ".join(word() for _ in range(9000)), "de", "s2", None, *EXTRA))
    rows += [rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def order(doc):
    return -1 if doc is None else doc


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_line_dedup(docs, rows, empty):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for d, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    want = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or max(held[key(x)], key=order) == d]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text")
    assert table(got) == sorted(want, key=str)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_are_sorted_within_ranges_and_settled_over_them(spark):
    hot = "a line that very many documents hold"
    docs = spark.createDataFrame([(i, f"{hot}\nonly document {i} holds this line\n{hot}") for i in range(400)], "doc_id long, text string").repartition(7)
    dropped = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()}
    assert dropped == {i: 2 if i < 399 else 0 for i in range(400)}
    keyed = docs.select(F.xxhash64("text").alias("h1"), F.xxhash64("text").alias("h2"), "doc_id", F.lit(0).alias("word"))
    plan = line_dedup.ranked_lines(keyed, 3)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "Sort [range" in plan and "Window [first(doc_id" in plan


def test_exact_dedup(docs, rows, empty):
    groups = {}
    for d, text, *_ in rows:
        groups.setdefault(text or "", []).append(d)
    want = []
    for d, text, *_ in rows:
        g = groups[text or ""]
        keep = max(g, key=order)
        want.append((d, keep, len(g), d == keep, sha(text or "")))
    for table_bytes in (64 << 20, 2000):  # in one table, and through spill files
        assert table(exact_dedup.exact_dedup(docs, table_bytes=table_bytes)) == sorted(want, key=str)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and {r.text or "" for r in left.select("text").collect()} == set(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_quality_counts_and_filter(docs, rows, empty):
    def counts(text):
        w = words(text)
        c = Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)

    measured = quality_rules.measure(docs)
    got = measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert table(got) == sorted([(d, *counts(t)) for d, t, *_ in rows], key=str)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    judged = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in quality_rules.judge(measured).collect()}
    assert all(not (bad and ok) for bad, ok in judged.values()) and len({r.doc_id for r in kept.collect()}) == len({d for (d, _), (_, ok) in judged.items() if ok})
    assert quality_rules.keep_good(empty).count() == 0


def test_fences_follow_the_sketch(spark):
    rows = [(i, "en", "s", 100, 500, v, 10, 0, 0) for i, v in enumerate([0, 1, 2, 3] * 20 + [400])]
    m = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(m).collect()}
    assert not kept[80] and all(v for k, v in kept.items() if k != 80)


def brute_repeats(rows, symbols, width, same_doc):
    seen, out = {}, {}
    for d in sorted({d for d, *_ in rows}, key=order):
        new = {}
        for text in {t or "" for e, t, *_ in rows if e == d}:
            s = symbols(text)
            gone = [False] * len(s)
            for i in range(len(s) - width + 1):
                w = tuple(s[i : i + width])
                if w in seen or (same_doc and new.get(w, i) < i):
                    gone[i : i + width] = [True] * width
                new.setdefault(w, i)
            out[d, text] = gone
        seen.update(new)
    return out


def test_suffix_dedup(docs, rows, empty):
    gone = brute_repeats(rows, lambda t: t.encode(), 50, False)
    want = []
    for d, t, *_ in rows:
        g, b = gone[d, t or ""], (t or "").encode()
        runs = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        want.append((d, len(b), sum(g), runs, sha(bytes(x for x, y in zip(b, g) if not y))))
    got = suffix_dedup.dedup_spans(docs).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got], key=str) == sorted(want, key=str)
    assert suffix_dedup.dedup_spans(empty).count() == 0


def test_recompression_dedup(docs, rows, empty):
    gone = brute_repeats(rows, lambda t: words(t), 20, True)
    want = []
    for d, t, *_ in rows:
        g = gone[d, t or ""]
        want.append((d, len(g), sum(g), " ".join(w for w, x in zip(words(t), g) if not x)))
    got = recompression_dedup.dedup_passages(docs).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got], key=str) == sorted(want, key=str)
    assert recompression_dedup.dedup_passages(empty).count() == 0


def test_rows_of_one_id_lose_only_their_own_repeats(spark):
    rng = random.Random(8)
    fresh = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    passage = fresh(25)
    early, late, clean = fresh(100) + passage + fresh(300), fresh(300) + passage + fresh(100), fresh(500)
    for doc in (None, 7):
        df = spark.createDataFrame([(doc, " ".join(w)) for w in (early, late, clean)], "doc_id long, text string").repartition(3)
        kept = {bytes(r.kept).decode() for r in recompression_dedup.dedup_passages(df).collect()}
        assert kept == {" ".join(early), " ".join(late[:300] + late[325:]), " ".join(clean)}
    df = spark.createDataFrame([(1, " ".join(early)), (7, " ".join(late)), (7, " ".join(clean))], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.dedup_spans(df).collect()}
    assert got[1, len(" ".join(early))] == 0 and got[7, len(" ".join(clean))] == 0 and got[7, len(" ".join(late))] >= len(" ".join(passage))


@pytest.mark.parametrize("same_doc", [False, True])
def test_bucket_pointer_refinement(same_doc):
    rng = random.Random(6)
    for width, depth in ((20, 1), (50, 8)):
        pieces, at, doc = [], [], []
        stock = ["".join(rng.choice("ab") for _ in range(width + rng.randint(0, 30))) for _ in range(6)]
        for i in range(60):
            text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) + rng.choice(stock)
            pieces.append(text.encode())
            at.append(rng.randrange(5))
            doc.append(rng.randrange(12))
        if depth == 8:
            ids, d, size = suffix_dedup.ByteRepeats().buckets(pieces)
        else:
            ids, d, size = recompression_dedup.WordRepeats().buckets([b" ".join(bytes([c]) for c in t) for t in pieces])
        assert d == depth and size.tolist() == [len(t) for t in pieces]
        n = [len(t) - width + 1 for t in pieces]
        own = np.repeat(np.arange(60), n)
        inside = np.concatenate([np.arange(k) for k in n])
        docs_of, ats = np.array(doc)[own], np.array(at)[own] + inside
        got = anchored.refine(ids, depth, (np.cumsum(size) - size)[own] + inside, docs_of, ats, width, same_doc)
        content = [pieces[o][i : i + width] for o, i in zip(own, inside)]
        first = {}
        for w, e, a in zip(content, docs_of.tolist(), ats.tolist()):
            first[w] = min(first.get(w, (e, a)), (e, a))
        want = [(e, a) > first[w] if same_doc else e > first[w][0] for w, e, a in zip(content, docs_of.tolist(), ats.tolist())]
        assert got.tolist() == want and any(want)


def test_very_long_texts(spark):
    """Texts beyond a block and beyond a part: passages around the borders of blocks are found."""
    rng = np.random.RandomState(9)
    words = ["".join(map(chr, 97 + w)) for w in rng.randint(0, 26, (420_000, 5))]
    long = " ".join(words)
    assert len(long) > 2_400_000
    border = (2 << 20) // 6
    copy = " ".join(["START", *words[border - 40 : border + 40], "END"])
    docs = spark.createDataFrame([(1, long), (2, copy), (3, " ".join(words[:30] + ["other"] * 5))], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup_spans(docs).collect()}
    assert got == {1: (len(long), 0, 0), 2: (len(copy), 481, 1), 3: (209, 180, 1)}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in recompression_dedup.dedup_passages(docs).collect()}
    assert got == {1: (420_000, 0), 2: (82, 80), 3: (35, 30)}
    assert {r.doc_id: r.n_shingles for r in ngram_join.join_documents(docs).collect()}[1] == 419_996
    assert {r.doc_id: r.n_words for r in quality_rules.measure(docs.select("*", F.lit("x").alias("lang"), F.lit("y").alias("source"))).collect()}[1] == 420_000


def test_recompression_is_local():
    """Equal stretches have equal symbols wherever the zone lies inside."""
    rng = np.random.RandomState(1)
    inner = rng.randint(0, 4, 60).astype(np.uint64)
    inner[20:32] = 1
    found = []
    for seed in range(6):
        r = np.random.RandomState(seed)
        a, b = r.randint(0, 4, 17 + seed).astype(np.uint64), r.randint(0, 4, 23).astype(np.uint64)
        seq = np.concatenate([a, inner, b])
        name, lo, hi = recompression_dedup.recompress(seq, np.zeros(len(seq), int))
        assert (np.diff(lo) >= 0).all() and (np.diff(hi) >= 0).all()
        found.append({(int(x), int(s) - len(a), int(e) - len(a)) for x, s, e in zip(name, lo, hi) if s >= len(a) and e <= len(a) + 60})
    assert all(f == found[0] for f in found) and found[0]


def test_ngram_join(docs, rows, empty):
    sets = {}
    for d, t, *_ in rows:
        w = words((t or "").translate(LOW))
        sets[d, t or ""] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    nodes = list(sets)
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[find(a)] = find(b)
    low = {}
    for n in nodes:
        if n[0] is not None:
            low[find(n)] = min(low.get(find(n), n[0]), n[0])
    want = [(d, len(sets[d, t or ""]), low.get(find((d, t or ""))) if sets[d, t or ""] else d) for d, t, *_ in rows]
    assert table(ngram_join.join_documents(docs)) == sorted(want, key=str)
    wide = docs.select("*", *[F.lit(1).alias(c) for c in ("w", "row", "pivot", "hashes", "keep", "component_id")])
    assert table(ngram_join.join_documents(wide)) == sorted(want, key=str)
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == {d for d, _, c in want if d == c}
    assert ngram_join.join_documents(empty).count() == 0


def near_copies(seed, n_words=150, groups=((40, 0, 2), (25, 1, 4), (30, 2, 5))):
    """Sets of groups with many near copies of different distances, most of them linked through others only."""
    rng, texts = random.Random(seed), []
    passage = [f"p{i}" for i in range(12)]
    for size, least, most in groups:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(least, most)):
                w[rng.randrange(n_words)] = f"e{rng.randrange(40)}"
            texts.append(" ".join(w + (passage if rng.random() < 0.4 else [])))
    texts += [" ".join([f"x{rng.randrange(10**6)}" for _ in range(20)] + passage) for _ in range(10)]
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize(("cell_bytes", "seed"), [(8 << 20, 1), (9000, 1), (1500, 2)])
def test_pivot_join_recurses_exactly(spark, monkeypatch, cell_bytes, seed):
    monkeypatch.setattr(ngram_join, "CELL_BYTES", cell_bytes)
    texts = near_copies(seed)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 80 * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert len({find(i) for i in root}) < len(texts) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.join_documents(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_links_between_classes_with_null_and_repeated_ids(spark):
    rng = random.Random(5)
    fresh = lambda: [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, d = fresh(), fresh(), fresh(), fresh()
    rows = [(None, " ".join(a)), (9, " ".join(a)), (None, near(a)), (10, near(a))]
    rows += [(20, " ".join(b)), (22, " ".join(b)), (20, near(b)), (21, near(b))]
    rows += [(None, " ".join(c)), (None, near(c)), (None, near(c)), (30, " ".join(d)), (30, near(d)), (30, near(d)), (None, None), (40, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    low = {"a": 9, "b": 20, "c": None, "d": 30}
    group = lambda t: next((g for g, w in zip("abcd", (a, b, c, d)) if t and t.startswith(w[0] + " ")), None)
    want = [(i, 196 if t else 0, low[group(t)] if t else i) for i, t in rows]
    assert table(ngram_join.join_documents(docs)) == sorted(want, key=str)
    left = ngram_join.drop_near_copies(docs).collect()
    assert Counter((r.doc_id, group(r.text)) for r in left) == Counter([(9, "a"), (20, "b"), (None, "c"), (30, "d"), (None, None), (40, None)])
    once = exact_dedup.drop_copies(docs).collect()
    assert len(once) == len({t or "" for _, t in rows}) and len({r.text or "" for r in once}) == len(once)


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "\n\n", "a▁b", "日本語 テスト\u0000x", "<s> </s> <0x41>", "😀 ok", "\t\tx", "a,b;c.d\n- e", "x" * 3000, "é" * 200 + "​"])
def test_codec_equals_the_library(text):
    c = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    ids = [int(i) for i in c.encode(text).split(",")] if text else []
    assert ids == c.lib.encode(text) and c.decode(ids) == c.lib.decode(ids)
    assert sum((c.agenda(s) for s in (c.cut("▁" + text.replace(" ", "▁")) if text else [])), []) == ids


def test_codec_forgets_and_relearns():
    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model(), memo=40)
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(25))
        assert [int(i) for i in c.encode(text).split(",")] == c.lib.encode(text)
        assert len(c.fresh) <= 60


def test_encode_documents(docs, rows, empty):
    lib = sentencepiece_codec.codec(sentencepiece_codec.default_model()).lib
    want = []
    for d, t, *_ in rows:
        ids = lib.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    assert table(sentencepiece_codec.digest_documents(docs)) == sorted(want, key=str)
    assert {r.doc_id: r.decoded for r in sentencepiece_codec.encode_documents(docs).collect()}[502] == " \n\t"
    assert sentencepiece_codec.digest_documents(empty).count() == 0


def test_mixing(docs, rows, empty):
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(words(t))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(size.values()), set(), {}
    while True:
        left = total - sum(2 * size[s] for s in full)
        target = {s: 2.0 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    got = mixing.mixture(docs, levels=2).collect()
    assert len(got) == len(rows)
    taken, sources = Counter(), {(d, len(words(t))): s for d, t, _, s, *_ in rows}
    for r in got:
        s = sources[r.doc_id, r.size]
        assert abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == size[s]
        assert len(r.shards) <= 2 and set(r.shards) <= {0, 1, 2, 3} and r.taken == r.size * len(r.shards)
        taken[s] += r.taken
    for s in names:  # within the largest document of the source, here the border block may hold any
        assert target[s] - max(len(words(t)) for _, t, _, x, *_ in rows if x == s) < taken[s] <= target[s] + 1e-6
    key = lambda rs: sorted((str(r.doc_id), r.size, tuple(r.shards)) for r in rs)
    assert key(got) == key(mixing.mixture(docs.repartition(3), levels=2).collect())
    out = mixing.mix(docs, levels=2)
    assert out.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.doc_id, r.size] += len(r.shards)
    assert Counter((r.doc_id, len(words(r.text))) for r in out.collect()) == +want
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0 and mixing.targets(mixing.sizes(empty)).count() == 0


def test_repeated_rows_are_numbered(spark):
    rows = spark.createDataFrame([(1,)] * 300 + [(i,) for i in range(2, 9)] + [(9,), (9,)], "row long").repartition(4)
    got = {}
    for r in common.numbered(rows, salts=5).collect():
        got.setdefault(r.row, []).append(r.copy)
    assert {k: sorted(v) for k, v in got.items()} == {1: list(range(300)), **{i: [0] for i in range(2, 9)}, 9: [0, 1]}


def test_splitting_tree_keeps_quotas(spark):
    q = spark.createDataFrame([("a", 0, 40), ("b", 0, 9), (None, 1, 3)], "source string, epoch int, quota long")
    leaves = mixing.split_quotas(q, levels=3).collect()
    assert len(leaves) == 24
    total, shard = Counter(), Counter()
    for r in leaves:
        assert r.quota >= 0
        total[r.source] += r.quota
        shard[r.shard] += r.quota
    assert total == {"a": 40, "b": 9, None: 3} and set(shard.values()) <= {6, 7}


def test_language_id(spark, docs, empty):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in sf.select("doc_id", "lang").collect()}
    held = [r for r in language_id.identify(sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held) and len(held) > 100
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert got[500].lang_pred == got[501].lang_pred == got[502].lang_pred == "und" and got[503].lang_pred in ("de", "en") and 0 <= got[503].score <= 1
    assert language_id.identify(empty).count() == 0


def test_language_samples_hold_letters_of_many_texts(spark):
    rows = [(i, None if i % 2 else " \n1", "xx") for i in range(40)] + [(100 + i, "the same words of a copy", "en") for i in range(300)]
    rows += [(1000 + i, f"another text number {chr(97 + i % 26)}{chr(97 + i // 26)} here", "en") for i in range(60)]
    rows += [(2000 + i, ("ein sehr langer satz " * 3000 + " ende zz") if i < 3 else f"noch ein kurzer text {chr(97 + i)}", "de") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = language_id.sample(df, sample_chars=2000)
    assert set(learned) == {"de", "en"} and all(len(t) <= 2000 + 64 * 4 for t in learned.values())
    assert learned["en"].count("the same words of a copy") <= 1 and learned["en"].count("another text") > 20
    assert learned["de"].count("noch ein kurzer text") >= 8
    assert {r.lang_pred for r in language_id.identify(df).collect() if r.doc_id >= 100} == {"de", "en"}
    p = language_id.Parser((("aa", "the word"), ("bb", "one other long text with many letters of the alphabet")))
    assert p.predict(["many letters with one text"])[0] == ["bb"]


def test_tiny_and_empty_samples_do_not_win(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["the", "one", "other", "word", "with", "many", "letters", "here"]) for _ in range(60))
    for tiny in ("ab", "", None, "one two"):
        rows = [(i, text(), "en") for i in range(60)] + [(100 + i, tiny, "zz") for i in range(8)] + [(200, "the word", None), (201, "the word", None)]
        got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
        assert {r.lang_pred for r in got if r.doc_id < 60} == {"en"}
        assert len({(r.lang_pred, r.score) for r in got if r.doc_id >= 200}) == 1
    same = language_id.Parser((("bb", "abc abd"), ("aa", "abc abd")))  # ties: the smallest name
    assert same.predict(["abc", "abd abd"])[0] == ["aa", "aa"] or same.langs == ["bb", "aa"]


@pytest.mark.parametrize("lane", [2048, 7, 3])
def test_phrases_against_a_plain_parse(monkeypatch, lane):
    monkeypatch.setattr(language_id, "LANE", lane)
    monkeypatch.setattr(language_id, "TRACE", 5)
    samples = (("aa", "abra cadabra abra"), ("bb", "hocus pocus locus"))
    p = language_id.Parser(samples)
    rng = random.Random(lane)
    long = ["".join(rng.choice("abracdhous p") for _ in range(rng.randint(5, 200))) for _ in range(20)]
    texts = ["abracadabra", "pocus abra", "zzz", "a", *long]
    together = p.phrases(texts)
    for j, text in enumerate(texts):
        s = p.symbols(text).tolist()
        for k, (_, sample) in enumerate(samples):
            base = p.symbols(sample).tolist()
            inside = lambda x: any(base[i : i + len(x)] == x for i in range(len(base) - len(x) + 1))  # noqa: B023, E731
            n, phrase = 1, []
            for c in s:
                if inside(phrase + [c]):
                    phrase = phrase + [c]
                else:
                    n, phrase = n + 1, [c] if inside([c]) else []
            assert p.phrases([text])[0, k] == together[j, k] == n


def test_token_output(spark, docs, rows, empty, tmp_path):
    e = token_output.encoder(token_output.default_vocabulary())
    keys = sorted((k % token_output.BUCKETS, k, d, t or "") for d, t, k in docs.select("doc_id", "text", common.row_key()).collect())
    order = [(d, i, ids[i * 16 : i * 16 + 16]) for _, _, d, t in keys for ids in [e.encode_ordinary(t)] for i in range(-(-len(ids) // 16))]
    slot = token_output.permute(np.arange(len(order)), len(order)).tolist()
    want = {s: o for s, o in zip(slot, order)}
    for n, input_rows in enumerate((docs, docs.repartition(2))):  # the same shards from any partitioning
        got = {r.slot: r for r in token_output.shards(input_rows, f"file://{tmp_path}/{n}", seq_tokens=16, shard_records=50).collect()}
        assert {s: (r.doc_id, r.seq, r.n_tokens) for s, r in got.items()} == {s: (d, i, len(ids)) for s, (d, i, ids) in want.items()}
        for f in sorted((tmp_path / str(n)).iterdir()):
            shard, data = int(f.stem.split("-")[1]), f.read_bytes()
            for i, ids in enumerate(token_output.read_records(data, seq_tokens=16)):
                r = got[shard * 50 + i]
                assert ids == want[r.slot][2] and r.shard == shard and r.byte_at == i * 34
                assert r.record_sha256 == sha(data[r.byte_at : r.byte_at + 34])
    assert token_output.shards(empty, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutation(n):
    slots = token_output.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
