"""Source divergence, alignment of tokenizers and chat formatting against brute force, on odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators_llm import SCHEMA, make

from tallymark.llm import chat_format, source_divergence, token_alignment

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return make(90, seed=11)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def audited(rows, min_docs, top):
    """All pairs over all kept terms, one by one."""
    seen, count = defaultdict(set), Counter()
    groups = {(r[2] or "", r[3] or "") for r in rows}
    for k, (_, text, lang, source, *_) in enumerate(rows):
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER)):
            seen[lang or "", t].add(k)
            count[lang or "", source or "", t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), d in seen.items() if x == lang and len(d) >= min_docs]
        sources = [s for x, s in groups if x == lang]
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = {t: share(sum(count[lang, s, t] for s in sources), sum(n.values())) for t in kept}  # noqa: B023
        for s in sources:
            p = {t: share(count[lang, s, t], n[s]) for t in kept}
            items = [(-sum(f(p[t], share(count[lang, o, t], n[o])) for t in kept), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(items), 1)}
            items = [(-f(p[t], whole[t]), t.encode(), t) for t in kept if count[lang, s, t] and p[t] > whole[t]]
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(items)[:top], 1)}
    return out


@pytest.mark.parametrize(("min_docs", "block", "part"), [(2, 256, 100_000), (2, 2, 40), (10**6, 1, 10)])
def test_audit(spark, docs, rows, min_docs, block, part):
    rows = [*rows, (900, "only here", "xx", "lone", None, *rows[0][5:]), (901, None, "xx", None, None, *rows[0][5:])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = source_divergence.audit(docs, min_docs=min_docs, block=block, part=part).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == audited(rows, min_docs, source_divergence.TOP)


def test_audit_of_nothing(spark):
    assert source_divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_audit_hands_on_early(spark, docs):
    whole = lambda n: {tuple(r) for r in source_divergence.term_rows(docs, n).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()}
    assert whole(1) == whole(10**6)


def test_shares_do_not_overflow(spark):
    n, of = 7 * 10**14 + 3, 9 * 10**14 + 1
    got = spark.createDataFrame([(n, of), (0, 5), (5, 5), (1, 0)], "n long, of long").select(source_divergence.share(F.col("n"), F.col("of"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * n // of, 1, 1 + 10**9, None]


def test_aligned_finds_all_common_ends():
    rng = random.Random(4)
    for n in (1, 5, 60, 2000):
        for p in (0.02, 0.5, 0.98):
            ends = np.arange(1, n + 1)
            a, b = (np.array(sorted({n, *(x for x in ends.tolist() if rng.random() < p)})) for _ in range(2))
            left, right = token_alignment.aligned(a, b)
            assert a[left].tolist() == b[right].tolist() == np.intersect1d(a, b).tolist()
    left, right = token_alignment.aligned(np.array([], np.int64), np.array([], np.int64))
    assert len(left) == len(right) == 0


ODD = ["", "a  b", "\n foo", " x", "x ", "   ", "a▁b", "<|endoftext|> hi </s>", "a 　b", "a \x1c b", "日本 語 \U0001f600", "a\0b", "it's  'll\n\n  z", "\t", "é ​ x", " ꟿ", "x" * 5000]


def aligned_texts(pair, texts):
    """By the libraries on whole texts and by the set of common ends."""
    each, count = [], Counter()
    for t in texts:
        a, b = (pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(pair.bytes_a[k] for k in a) != whole or b"".join(pair.bytes_b[k] for k in b) != whole:
            each.append((0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum(pair.len_a[a]).tolist(), np.cumsum(pair.len_b[b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for e in common:
            x, y = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = [(x[-1], y[-1]) for x, y in groups]
        count.update(links)
        each.append((len(a), len(b), links, sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))))
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(a, b, len(k), len(k), sum(count[x] == top[x[1]] for x in k), sum(count[x] for x in k), s) for a, b, k, s in each]


@pytest.mark.parametrize("block_links", [token_alignment.BLOCK_LINKS, 50])
def test_alignment(spark, rows, block_links):
    rows = [*rows, *((1000 + k, t, None, None, None, *rows[0][5:]) for k, t in enumerate(ODD))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = token_alignment.align_documents(docs, block_links=block_links)
    assert got.columns == [x.split()[0] for x in token_alignment.RESULT.split(", ")]
    want = aligned_texts(token_alignment.pair(*token_alignment.default_models()), [r[1] for r in rows])
    want = [(r[0], *w) for r, w in zip(rows, want)]
    assert sorted(map(str, map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))) == sorted(map(str, want))


def test_alignment_forgets_and_learns_again(rows):
    small, large = token_alignment.Pair(*token_alignment.default_models(), memo=3), token_alignment.pair(*token_alignment.default_models())
    for r in rows[:40]:
        a, b = small.documents([r[1], r[1]]), large.documents([r[1]])
        assert a[0][:4] == a[1][:4] == b[0][:4] and a[0][4].tolist() == b[0][4].tolist()


def test_alignment_of_nothing(spark):
    assert token_alignment.align_documents(spark.createDataFrame([], SCHEMA)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, tree long, node long, leaf int, pos int"


def turns(seed=5):
    rng = random.Random(seed)
    bits = ["###", "\\", "</turn>", "<", "#", "/turn>", ": ", ":", " ", "\n", "### assistant: ", "é", "\U0001f600", "$1", "x"]
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a: b", "###", ":"]), text(), 1, 2, 3, 4) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(99, t, ("user", "assistant")[t % 2], "word " * (t % 7), 0, 0, 0, 0) for t in range(300)]
    rows += [(None, 0, "user", "a", 0, 0, 0, 0), (None, None, "assistant", "b", 0, 0, 0, 0), (98, 1, "assistant", "t" * 3_000_000, 0, 0, 0, 0), rows[3], rows[3]]
    return rows


def test_chat_of_turns(spark):
    rows = turns()
    got = chat_format.read_back(chat_format.format_trees(chat_format.chain(spark.createDataFrame(rows, TURNS).repartition(4)))).collect()
    want = defaultdict(list)
    for c, t, role, text, *_ in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", (r[3] or ""))):
        want[c].append((role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        said = want[r.tree]
        assert [tuple(t) for t in r.turns] == said and r.n_turns == len(said)
        assert r.learned == "".join(t for role, t in said if role == "assistant")
        assert r.formatted.count(chat_format.CLOSE) == len(said)
        assert all(r.formatted[m.start - 2 : m.start] == ": " and r.formatted[m.start + m.length :].startswith(chat_format.CLOSE) for m in r.loss)


def test_chat_of_reply_trees(spark):
    rng, rows = random.Random(8), []
    for tree in range(12):
        for k in range(rng.randint(1, 40)):
            rows.append((tree, k, rng.randrange(k) if k and rng.random() < 0.95 else None if k else 77, ("user", "assistant")[k % 2], f"{tree}-{k}", rng.choice([None, -1, 0, 2, 5])))
    rows += [(50, 1, 2, "user", "a", 1), (50, 2, 1, "user", "b", 1), (50, 3, 2, "user", "c", 1), (51, 4, 4, "user", "own", 1)]  # circles have no root
    parent, own = {(r[0], r[1]): (r[0], r[2]) for r in rows}, {(r[0], r[1]): r for r in rows}
    answered, ways = set(parent.values()), defaultdict(list)
    for key in own:
        path, at = [], key
        while at in own and len(path) <= len(rows):
            path.append(at)
            at = parent[at]
        if key not in answered and len(path) <= len(rows):
            ways[key[0]].append((-sum(own[k][5] or 0 for k in path), key[1], [own[k][3:5] for k in reversed(path)]))
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score long").repartition(3)
    for top in (1, 3):
        got = {(r.tree, r["rank"]): [tuple(t) for t in r.turns] for r in chat_format.read_back(chat_format.format_trees(df, top)).collect()}
        assert got == {(tree, k): path for tree, each in ways.items() for k, (_, _, path) in enumerate(sorted(each)[:top], 1)}


def test_chat_of_nothing(spark):
    assert chat_format.format_trees(chat_format.chain(spark.createDataFrame([], TURNS))).count() == 0
    one = chat_format.format_trees(chat_format.chain(spark.createDataFrame([(1, 0, "user", "x", 0, 0, 0, 0)], TURNS))).collect()
    assert [r.formatted for r in one] == ["### user: x</turn>\n"] and one[0].loss == []


def test_chat_runs_without_python(spark):
    plan = chat_format.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
