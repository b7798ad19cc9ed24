"""Registered queries without a SQL twin, against plain Python over the same rows."""

from collections import deque

import pytest

from tallymark.catalog import QUERIES
from tallymark.operators.evidence import all_links
from tallymark.operators.graph import edges
from tallymark.operators.ledger import best_labels, canonical
from tallymark.operators.news import tokens
from tallymark.operators.search import token_hits
from tallymark.views import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF)


def test_conv_window(spark, v):
    talks = {}
    for c, turn, n in v.conversations.select("conv_id", "turn", tokens()).collect():
        talks.setdefault(c, []).append((turn, n))
    want = set()
    for c, messages in talks.items():
        used, kept = 0, []
        for turn, n in sorted(messages, reverse=True):
            if used + n <= 100 or not kept:
                used, kept = used + n, [turn, *kept]
        want.add((c, used, len(kept), ",".join(map(str, sorted(kept)))))
    assert {(r.conv_id, r.used, r.kept, r.turns) for r in QUERIES["conv_window"](spark, SF).collect()} == want


def test_context_pack(spark, v):
    size = {r.doc_id: r.n_chars // 4 for r in v.documents.select("doc_id", "n_chars").collect()}
    listed = {}
    for r in token_hits(v.benchmark, v.documents, 10).collect():
        listed.setdefault(r.item_id, []).append((r.rank, r.doc_id))
    want = set()
    for item, docs in listed.items():
        used, ids = 0, []
        for _, d in sorted(docs):
            if used + size[d] <= 2000:
                used, ids = used + size[d], [*ids, d]
        want.add((item, used, ",".join(map(str, ids))))
    assert {(r.item_id, r.used, r.ids) for r in QUERIES["context_pack"](spark, SF).collect()} == want


def test_shortest_path(spark, v):
    near = {}
    for r in edges(canonical(v.txn, v.blk)).select("src", "dst").collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    best, queue = {"c1": ["c1"]}, deque(["c1"])
    while queue:
        node = queue.popleft()
        for n in sorted(near.get(node, ())):
            path = [*best[node], n]
            if n not in best:
                best[n] = path
                queue.append(n)
            elif len(path) == len(best[n]):
                best[n] = min(best[n], path)
    got = QUERIES["shortest_path"](spark, SF).collect()
    assert [(r.path, r.hops) for r in got] == [(">".join(best["c2"]), len(best["c2"]) - 1)]


def test_clusters(spark, v):
    links = all_links(v).collect()
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = find(r.a), find(r.b)
        root[max(a, b)] = min(a, b)
    want = {}
    for x in list(root):
        want.setdefault(find(x), [0, 2.0, 0, set()])[0] += 1
    for r in links:
        w = want[find(r.a)]
        w[1], w[2] = min(w[1], r.confidence), w[2] + 1
        w[3].add(r.relation)
    got = {r.comp: (r["size"], r.confidence, r.links, r.relations) for r in QUERIES["clusters"](spark, SF).collect()}
    assert got == {c: (n, weak, k, ",".join(sorted(kinds))) for c, (n, weak, k, kinds) in want.items()}
