"""N-gram Jaccard join: exact links between documents whose shingle sets are alike.

Jaccard distance is a metric, and the join works in it with pivots (``RADIUS``
is the distance of a link, 0.2):

1. Texts become sets of hashed 5-word shingles; equal sets are one class, and
   one node, from here on.
2. A node in any link shares at least four fifths of its set.  Each set sends
   its smallest hashes (about half of them), a count of how many of these any
   other document sends too comes back, and nodes with too few are alone.
3. Pivots: nodes with the same few least hashes (a MinHash) form a group; the
   most central node of a group, whose hashes most others hold, is its pivot.
   Of pivots within ``COVER`` of each other the most central one stays.
4. Voronoi regions: a node within ``COVER`` of a pivot lives in the cell of its
   nearest pivot.  The cell's reach is the largest distance of those in it.
5. Windows: by the triangle inequality a node that is linked to one of a cell
   lies within the cell's reach plus the radius of the pivot, and within its own
   pivot's distance plus twice the radius.  Only such border nodes are replicated
   into the cell.  In a cell each node meets only those whose distance to the
   pivot differs from its own by the radius at most, and those within the radius
   of the pivot are one component and do not meet each other.
6. Recursion: nodes that no pivot covers, and all nodes of a cell that holds
   more than ``CELL_BYTES``, join again among themselves, with new pivots, until
   what is left fits ``CELL_BYTES`` and is one cell of one pivot.  Every second turn splits dense regions: all pivots stay, cells cover the radius
   only, so that each is one component, and only border nodes of other
   components meet them.

A link has an end that lives in a cell, and is found there, or both ends go on
to the next turn: every link between components is found.  Distances are exact,
of whole sets.  A cell's nodes come in slices of ``CELL_BYTES``, so a task holds
two slices of a region at a time.  An index of the rarest hashes finds the
pivots near a node.

Defined results: null, empty and wordless texts have an empty set and link with
nothing; fewer than five words are one shingle; rows that repeat a doc_id are
nodes of their own by their text; ``component_id`` ignores null ids (a null id
alone keeps null).  Extra columns are ignored.  Shingles, like classes, are
told apart by 64 bits of hash.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import TO_LOWER, mix, spans, word_bounds

SHINGLE, RADIUS, COVER, CELL_BYTES, BROADCAST_IDS, BLOCK, FLUSH, PART_BYTES = 5, 0.2, 0.4, 8 << 20, 1_000_000, 1 << 19, 400_000, 16 << 20
TINY = 1e-9  # distances are quotients of integers: windows are closed
NONE = -(2**63)


def missing(n):
    """Elements of a set of ``n`` that a linked set may lack."""
    return n // 5


def sent(n):
    """How many of its smallest hashes a set sends: the missing ones and three tenths."""
    return np.minimum(n, missing(n) + (3 * n + 9) // 10)


def needed(n):
    """How many of these any linked set sends too: three tenths of the smaller set, four fifths of ``n`` at least."""
    return (3 * ((4 * n + 4) // 5) + 9) // 10


def shingle_sets(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Blocks of ``(keys, sizes, hashes)``: sorted distinct shingle hashes, one set after another."""

    def block(held: list) -> tuple[list, np.ndarray, np.ndarray]:
        data = TO_LOWER[np.frombuffer(b" ".join(t for _, t in held), np.uint8)]
        length = np.array([len(t) + 1 for _, t in held], np.int64)
        cuts = np.cumsum(length) - length
        first, last = word_bounds(data, cuts)
        h = spans(7)
        word = h.of(h.prefix(data), first, last)
        own = np.searchsorted(cuts, first, "right") - 1
        n_words = np.bincount(own, minlength=len(held))
        begin = np.cumsum(n_words) - n_words
        size = np.where(n_words == 0, 0, np.maximum(n_words - SHINGLE + 1, 1))
        text = np.repeat(np.arange(len(held)), size)
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        hashes = h.of(h.prefix(word), at, at + np.minimum(n_words[text], SHINGLE))
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        return [k for k, _ in held], np.bincount(text[new], minlength=len(held)), hashes[new]

    held, size = [], 0
    for item in texts:
        held.append(item)
        size += len(item[1])
        if size >= BLOCK:
            yield block(held)
            held, size = [], 0
    if held:
        yield block(held)


def pack(*cols: np.ndarray) -> bytes:
    """Columns of one length, documents first (as differences), compressed but for six bytes of hash."""
    doc, rest = cols[0], cols[1:]
    raw = b"".join([np.diff(doc, prepend=0).tobytes(), *(c.tobytes() for c in rest)])
    return len(doc).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, raw, out = int.from_bytes(data[:4], "little"), zstandard.ZstdDecompressor().decompress(data[4:]), []
    at = 0
    for kind in ("<i8", *kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    out[0] = np.cumsum(out[0])
    return out


STATS = ("<i8", "<i8", "<i8")
ENTRY, COUNT, STAT = 0, 1, 2
SCHEMA = "kind int, part int, payload binary"


def frame(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["kind", "part", "payload"]).astype({"kind": "int32", "part": "int32"})


def slices(part: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Runs of equal part after sorting by part and ``more``."""
    order = np.lexsort((*reversed(more), part))
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for s, e in zip([0, *cuts], [*cuts, len(order)]):
        if e > s:
            yield int(part[order[s]]), order[s:e]


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs in order of hash and node, each once."""
    order = np.lexsort((doc, h))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def counted(doc: np.ndarray, groups: int) -> Iterator[tuple[int, int, bytes]]:
    """How often each node stands in ``doc``, packed by group of nodes."""
    ids, n = np.unique(doc, return_counts=True)
    part = (mix(ids.view("<u8")) % np.uint64(groups)).astype(np.int32)
    for p, rows in slices(part, ids):
        yield COUNT, p, pack(ids[rows], n[rows].astype("<i4"))


def by_part(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Kind, part and payload of the rows of each part, one part at a time: they come sorted by part."""
    rows = ((int(k), int(p), bytes(b)) for f in frames for k, p, b in zip(f["kind"], f["part"], f["payload"]))
    for _, of_part in itertools.groupby(rows, key=lambda r: r[1]):
        yield list(of_part)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc, row, body`` of every row; ``row`` tells texts apart that share an id, or have none."""
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("body"))
    return body.select("doc", F.xxhash64("doc", "body").alias("row"), "body")


def set_keys(n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The node of each set: a hash of all its shingles; 0 for the empty set."""
    begin = np.cumsum(n) - n
    total = []
    for salt in (0, 0x5851F42D4C957F2D):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)))
        total.append(prefix[begin + n] - prefix[begin])
    node = mix(mix(total[0]) + total[1] * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
    return np.where(n > 0, node, np.uint64(0)).view("<i8")


def shared_hashes(body: DataFrame, whole: bool = False) -> DataFrame:
    """``doc, row, n, node`` of every row of ``keyed``, and rows ``node, shared``, to be summed by node.

    Parts are as many as the texts have multiples of ``PART_BYTES``, and a task
    takes one at a time.  ``shared`` counts the sent hashes of a node that other nodes send too (those
    of copies in several tasks perhaps more than once).  ``whole`` sends whole
    sets.
    """
    n_parts = common.parallel(body)
    total = body.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = groups = max(n_parts, -(-total // PART_BYTES))

    def flush(docs_of: list, hashes: list) -> pd.DataFrame:
        doc, h = np.concatenate(docs_of), np.concatenate(hashes)
        doc, h = distinct(doc, h)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        both = np.repeat(size > 1, size)  # two nodes of this task hold it
        keep = ~both | new  # of a hash known to be shared, only a marker travels
        mark = np.where(both, np.int64(NONE + 1), doc)[keep]
        h_out, out = h[keep], list(counted(doc[both], groups)) if both.any() else []
        part = ((h_out >> np.uint64(48)) % np.uint64(parts)).astype(np.int32)
        for p, rows in slices(part, mark):
            six = np.ascontiguousarray(h_out[rows]).view(np.uint8).reshape(-1, 8)[:, :6]
            ids = zstandard.ZstdCompressor(level=1).compress(np.diff(mark[rows], prepend=0).tobytes())
            out.append((ENTRY, p, len(rows).to_bytes(4, "little") + np.ascontiguousarray(six).tobytes() + ids))
        return frame(out)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs_of, hashes, size = [], [], 0
        for keys, n, h in shingle_sets(((d, r), bytes(b)) for f in frames for d, r, b in zip(f["doc"].tolist(), f["row"].tolist(), f["body"])):
            ids, begin, node = np.array(keys, np.int64), np.cumsum(n) - n, set_keys(n, h)
            part = (mix(ids[:, 1].view("<u8")) % np.uint64(groups)).astype(np.int32)
            yield frame([(STAT, p, pack(ids[r, 0], ids[r, 1], n[r].astype("<i8"), node[r])) for p, r in slices(part, ids[:, 0])])
            k = n if whole else sent(n)
            pick = np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(k.sum())
            docs_of.append(np.repeat(node, k))
            hashes.append(h[pick])
            size += len(pick)
            if size > FLUSH:
                yield flush(docs_of, hashes)
                docs_of, hashes, size = [], [], 0
        if size:
            yield flush(docs_of, hashes)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_part(frames):
            if on := [(k, p, b) for k, p, b in rows if k != ENTRY]:
                yield frame(on)
            docs_of, hashes = [], []
            for b in (b for k, _, b in rows if k == ENTRY):
                n = int.from_bytes(b[:4], "little")
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :6] = np.frombuffer(b, np.uint8, 6 * n, 4).reshape(n, 6)
                hashes.append(wide.view("<u8").ravel())
                docs_of.append(np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4 + 6 * n :]), "<i8")))
            if not hashes:
                continue
            doc, h = distinct(np.concatenate(docs_of), np.concatenate(hashes))
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(h)))
            both = np.repeat((size > 1) | (doc[start] == NONE + 1), size) & (doc != NONE + 1)
            if both.any():
                yield frame(list(counted(doc[both], groups)))

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_part(frames):
            stats = [unpack(b, *STATS) for k, _, b in rows if k == STAT]
            if stats:
                yield pd.DataFrame(dict(zip(("doc", "row", "n", "node"), (np.concatenate(c) for c in zip(*stats)))) | {"shared": 0})
            counts = [unpack(b, "<i4") for k, _, b in rows if k == COUNT]
            if counts:
                ids, at = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
                of = np.bincount(at, np.concatenate([c[1] for c in counts])).astype(np.int64)
                none = pd.array([None] * len(ids), "Int64")
                yield pd.DataFrame({"doc": none, "row": none, "n": none, "node": ids, "shared": of})

    met = body.mapInPandas(send, SCHEMA).repartition(n_parts, "part").sortWithinPartitions("part").mapInPandas(meet, SCHEMA)
    return met.repartition(n_parts, "part").sortWithinPartitions("part").mapInPandas(add_up, "doc long, row long, n long, node long, shared long")


def limited(ids: DataFrame) -> DataFrame:
    """``ids`` (a few numbers a row), to be broadcast if there are few; beyond that a shuffled join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def whole_sets(body: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, n, hashes`` of the rows in ``wanted (row, node)``."""
    wanted = limited(wanted)
    chosen = body.join(wanted.select("row").distinct(), "row", "left_semi").select("row", "body")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for keys, n, h in shingle_sets((r, bytes(b)) for r, b in zip(f["row"].tolist(), f["body"])):
                begin, h = np.cumsum(n) - n, h.view("<i8")
                yield pd.DataFrame({"row": keys, "node": set_keys(n, h.view("<u8")), "n": n, "hashes": [h[b : b + k] for b, k in zip(begin, n)]})

    sets = chosen.mapInPandas(run, "row long, node long, n long, hashes array<long>")
    return sets.join(wanted, ["row", "node"]).select("node", "n", "hashes").dropDuplicates(["node"])


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, pivot`` with their Jaccard ``distance``."""
    pivots, nodes = sets.select(F.col("node").alias("pivot"), F.col("hashes").alias("y")), sets.select("node", F.col("hashes").alias("x"))
    both = pairs.join(pivots, "pivot").join(nodes, "node")
    same = F.size(F.array_intersect("x", "y"))
    return both.select("node", "pivot", same.alias("same"), (F.size("x") + F.size("y")).alias("sizes")).select("node", "pivot", (1 - F.col("same") / (F.col("sizes") - F.col("same"))).alias("distance"))


def placed(sets: DataFrame) -> DataFrame:
    """``node, n, central, order`` of the sets that may link: the hashes that others hold too, rarest first."""
    carried = sets.select("node", "n", F.explode("hashes").alias("hash"))
    held = carried.groupBy("hash").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    nodes = carried.join(held, "hash").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "hash"))).alias("order"), (F.sum("held") / F.first("n")).alias("central"))
    return nodes.where(F.size("order") >= F.expr("n - n div 5")).select("node", "n", "central", "order")


def choose_pivots(nodes: DataFrame, salt: int, hashes: int) -> DataFrame:
    """``pivot, rank``: the most central node of each group with equal least ``hashes``."""
    least = [F.array_min(F.transform("order", lambda x: F.xxhash64(F.lit(salt * 64 + i), x["hash"]))).alias(f"least{i}") for i in range(hashes)]  # noqa: B023
    rank = F.struct("central", "node")
    return nodes.select(rank.alias("rank"), *least).groupBy(*[f"least{i}" for i in range(hashes)]).agg(F.max("rank").alias("rank")).select("rank.node", "rank").withColumnRenamed("node", "pivot")


def thinned(pivots: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pivots that no more central one has within ``COVER``."""
    own = nodes.join(pivots.select(F.col("pivot").alias("node")), "node", "left_semi")
    near = distances(near_pivots(own, pivots.select("pivot", F.lit(COVER).alias("reach"))), sets).where(F.col("distance") <= COVER + TINY)
    above = near.join(pivots, "pivot").join(pivots.select(F.col("pivot").alias("node"), F.col("rank").alias("mine")), "node").where(F.col("rank") > F.col("mine"))
    return pivots.join(above.select(F.col("node").alias("pivot")), "pivot", "left_anti")


def index_rows(nodes: DataFrame, within: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """``node, n, place, hash``: the rarest hashes of a node, one of which any node ``within`` that distance holds among its own.

    A node may lack ``within`` of its set; hashes that no other node holds count as lacking.
    """
    first = F.floor(within * F.col("n") + TINY) + 1 - (F.col("n") - F.size("order"))
    head = F.slice("order", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))
    return nodes.select("node", "n", *extra, F.size("order").alias("shared"), F.posexplode(head).alias("place", "entry")).select("node", "n", *extra, "shared", "place", "entry.hash")


def near_pivots(nodes: DataFrame, pivots: DataFrame) -> DataFrame:
    """``node, pivot`` of all that may lie within ``reach`` of a pivot (``pivot, reach``)."""
    own = nodes.join(pivots.withColumnRenamed("pivot", "node"), "node")
    theirs = index_rows(own, F.col("reach"), ("reach",)).select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), "reach", "hash")
    mine = index_rows(nodes, F.lit(COVER + RADIUS))
    far = F.col("reach") + TINY
    sizes = F.least("n", "pivot_n") >= (1 - far) * F.greatest("n", "pivot_n")
    place = F.col("place") < F.floor(far * F.col("n")) + 1 - (F.col("n") - F.col("shared"))
    return mine.join(theirs, "hash").where((F.col("node") != F.col("pivot")) & sizes & place).select("node", "pivot").distinct()


def meet(f: pd.DataFrame) -> pd.DataFrame:
    """Links ``a, b`` that join components: of border nodes with those that live in the cell, and among these.

    What lies within the radius of the pivot is one component from the start.
    """
    f = f.sort_values("distance", ascending=False, kind="stable")
    home, border = f[~f["border"]], f[f["border"]]
    words, ids = np.unique(np.concatenate(home["hashes"].to_numpy()), return_inverse=True)
    size, distance, names = home["n"].to_numpy(), home["distance"].to_numpy(), home["node"].to_numpy()
    end = np.cumsum(size)
    part = np.where(distance <= RADIUS + TINY, -1, np.arange(len(home)))  # component of each that lives here; -1: the pivot's
    found: list[tuple[int, int]] = []
    among = f["among"].iloc[0]
    rest = [(i, *x) for i, x in enumerate(zip(names, size, distance, home["hashes"])) if part[i] >= 0] if among else []
    for at, node, n, d, hashes in [*rest, *((-1, *x) for x in zip(border["node"], border["n"], border["distance"], border["hashes"]))]:
        few = int(np.searchsorted(-distance, -(d - RADIUS - TINY), side="right"))  # farthest from the pivot first
        if not few:
            continue
        i = np.searchsorted(words, hashes)
        i[i == len(words)] = 0
        mark = np.zeros(len(words), np.int64)
        mark[i[words[i] == hashes]] = 1
        same = np.add.reduceat(mark[ids[: end[few - 1]]], end[:few] - size[:few])
        linked = np.flatnonzero(100 * same >= 80 * (size[:few] + n - same))
        own = -2 if at < 0 and d > RADIUS + TINY else -1 if at < 0 else part[at]
        for p in np.unique(part[linked]):
            if p != own:
                found.append((node, names[linked[part[linked] == p][0]]))
        if len(linked) and at >= 0:
            low = min(int(part[linked].min()), int(own))
            part[np.isin(part, np.append(part[linked], own))] = low
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def join_region(f: pd.DataFrame) -> pd.DataFrame:
    """Links that join components, of a whole region that fits a task: one pivot, one cell."""
    at = int(f["n"].to_numpy().argmax())
    pivot, words = f["node"].iloc[at], np.sort(f["hashes"].iloc[at])
    place = np.searchsorted(words, held := np.concatenate(f["hashes"].to_numpy()))
    place[place == len(words)] = 0
    size = f["n"].to_numpy()
    same = np.add.reduceat((words[place] == held).astype(np.int64), np.cumsum(size) - size)
    f = f.assign(pivot=pivot, distance=1 - same / (size + len(words) - same), border=False, among=True)
    near = f["node"][(f["distance"] <= RADIUS + TINY) & (f["node"] != pivot)]
    rest = f[f["node"] != pivot]
    more = [meet(rest)] if len(rest) else []
    return pd.concat([pd.DataFrame({"a": near, "b": pivot}).astype("int64"), *more])


def turn(sets: DataFrame, count: int) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """One turn among ``sets``: tables of links ``a, b``, the nodes that go on to the next turn, tables for this turn only."""
    splits = count % 2 == 1  # of dense regions
    cover = RADIUS if splits else COVER
    nodes = common.written(placed(sets))
    sets = common.written(sets.join(nodes.select("node"), "node", "left_semi"))
    pivots = common.written(choose_pivots(nodes, count, 1 + count // 2))
    spent = [nodes, sets, pivots]
    if not splits:
        pivots = common.written(thinned(pivots, nodes, sets))
        spent.append(pivots)
    close = common.written(distances(near_pivots(nodes, pivots.select("pivot", F.lit(cover).alias("reach"))), sets).where(F.col("distance") <= cover + TINY))
    links = [common.written(close.where(F.col("distance") <= RADIUS + TINY).select(F.col("node").alias("a"), F.col("pivot").alias("b")))]
    # Cells: of the nearest pivot.  A pivot's own links are all found by now.
    is_pivot = pivots.select(F.col("pivot").alias("node"))
    home = close.join(is_pivot, "node", "left_anti").groupBy("node").agg(F.min(F.struct("distance", "pivot")).alias("nearest"))
    home = common.written(home.select("node", F.col("nearest.pivot").alias("pivot"), F.col("nearest.distance").alias("distance")).join(nodes.select("node", "n"), "node"))
    cells = common.written(home.groupBy("pivot").agg((F.max("distance") + RADIUS).alias("reach"), F.ceil(8 * F.sum("n") / CELL_BYTES).cast("int").alias("home_slices")))
    # Borders: within the cell's reach, but at home elsewhere or nowhere.
    more = near_pivots(nodes, cells.select("pivot", "reach")).join(is_pivot, "node", "left_anti").join(close.select("node", "pivot"), ["node", "pivot"], "left_anti")
    border = distances(more, sets).unionByName(close.join(is_pivot, "node", "left_anti")).join(cells, "pivot").where(F.col("distance") <= F.col("reach") + TINY)
    border = border.join(home.select("node", F.col("pivot").alias("own"), F.col("distance").alias("own_distance")), "node", "left").where(~F.col("pivot").eqNullSafe(F.col("own")) & (F.col("own").isNull() | (F.col("distance") <= F.col("own_distance") + 2 * RADIUS + TINY)))
    if splits:  # a cell is one component: only others need to meet it
        comp = components(links[0])
        spent.append(comp)
        border = border.join(comp, "node", "left").join(comp.select(F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp")), "pivot", "left").where(~F.col("comp").eqNullSafe(F.col("pivot_comp")) | F.col("comp").isNull())
    border = common.written(border.select("pivot", "node", "distance").join(nodes.select("node", "n"), "node"))
    guests = border.groupBy("pivot").agg(F.ceil(8 * F.sum("n") / CELL_BYTES).cast("int").alias("border_slices"))
    shape = cells.join(guests, "pivot", "left").select("pivot", "home_slices", F.coalesce("border_slices", F.lit(0 if splits else 1)).alias("border_slices")).where("border_slices > 0")
    bounded = (F.least("home_slices", "border_slices") == 1) if splits else (F.col("home_slices") == 1)
    shape = common.written(shape.select("*", bounded.alias("bounded")))
    here = shape.where("bounded")
    slices = lambda own, all_of: (F.pmod(F.xxhash64("node"), own).cast("int"), F.explode(F.sequence(F.lit(0), F.col(all_of) - 1)))
    i, j = slices(F.col("home_slices"), "border_slices")
    hosts = home.join(here, "pivot").select("pivot", i.alias("home_slice"), j.alias("border_slice"), "node", "distance", F.lit(False).alias("border"))
    j, i = slices(F.col("border_slices"), "home_slices")
    guests = border.join(here, "pivot").select("pivot", i.alias("home_slice"), j.alias("border_slice"), "node", "distance", F.lit(True).alias("border"))
    members = hosts.unionByName(guests).join(sets, "node").withColumn("among", (F.col("border_slice") == 0) & F.lit(not splits))
    links.append(common.written(members.groupBy("pivot", "home_slice", "border_slice").applyInPandas(meet, "a long, b long")))
    # The next turn: what no pivot covers, and the cells that hold too much.
    done = is_pivot.unionByName(home.select("node"))
    crowded = home.select("node", "pivot").unionByName(border.select("node", "pivot")).join(shape.where("not bounded"), "pivot", "left_semi").select("node")
    left = common.written(sets.join(nodes.select("node").join(done, "node", "left_anti").union(crowded).distinct(), "node", "left_semi"))
    return links, left, [*spent, close, home, cells, border, shape]


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of all nodes in ``links (a, b)``: comp is the smallest node reachable."""
    edges = common.written(links.union(links.select("b", "a")).distinct())
    label = common.written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to")).select("node", "to"))
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("to_b").alias("low"))
        step = label.drop("was").join(near, "node").select("node", F.least("to", "low").alias("to"), F.col("to").alias("was"))
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = common.written(step.join(jump, "to").select("node", F.least("to", "far").alias("to"), "was"))
        common.discard(label)
        label = step
        if step.where("to <> was").isEmpty():
            common.discard(edges)
            return common.renamed(label, to="comp")


def link_nodes(sets: DataFrame) -> DataFrame:
    """``node, comp`` of every node that is linked: components of the links between sets."""
    links: list[DataFrame] = []
    count = 0
    while total := sets.agg(8 * F.sum("n")).first()[0]:
        if total <= CELL_BYTES:
            links.append(common.written(sets.withColumn("region", F.lit(0)).groupBy("region").applyInPandas(join_region, "a long, b long")))
            break
        found, left, spent = turn(sets, count)
        common.discard(sets, *spent)
        links, sets, count = links + found, left, count + 1
    if not links:
        return sets.select("node", F.col("node").alias("comp"))
    comp = components(functools.reduce(DataFrame.unionByName, links))
    common.discard(*links)
    return comp


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, row, n, node`` of every row, and ``node, component_id, keep`` of every set that has words.

    ``keep`` is the row that stands for the component: of the smallest id, null
    last, ties by the row's key.
    """
    body = keyed(docs)
    both = common.written(shared_hashes(body))
    stats = both.where("row is not null").drop("shared")
    # One node per distinct set.
    lead = F.struct((F.col("doc") == NONE).alias("no_id"), "doc", "row")
    classes = both.where("node <> 0").groupBy("node").agg(F.max("n").alias("n"), F.min(F.when(F.col("row").isNotNull(), lead)).alias("lead"), F.sum("shared").alias("shared"))
    classes = common.written(classes)
    wanted = common.written(classes.where(F.col("shared") >= F.expr("(3 * ((4 * n + 4) div 5) + 9) div 10")).select(F.col("lead.row").alias("row"), "node", "n"))
    for _ in range(2):  # among those that may link, count again, over whole sets
        chosen = body.join(limited(wanted.select("row").distinct()), "row", "left_semi").select("doc", "row", "body")
        again = shared_hashes(chosen, whole=True).groupBy("node").agg(F.sum("shared").alias("shared"))
        wanted = common.written(wanted.join(again, "node").where(F.col("shared") >= F.expr("n - n div 5")).select("row", "node", "n"))
    sets = common.written(whole_sets(body, wanted.select("row", "node")))
    comp = link_nodes(sets)
    named = classes.join(comp, "node", "left").select("node", "lead", F.coalesce("comp", "node").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("lead").alias("first"))
    by_node = named.join(lowest, "comp").select("node", F.nullif(F.col("first.doc"), F.lit(NONE)).alias("component_id"), F.col("first.row").alias("keep"))
    return stats, by_node


def join_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    stats, by_node = linked(docs.select("doc_id", "text"))
    out = stats.join(by_node, "node", "left")
    doc_id = F.nullif("doc", F.lit(NONE))
    return out.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(doc_id).alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id; rows without words all stay."""
    stats, by_node = linked(docs.select("doc_id", "text"))
    keep = common.written(by_node.select(F.col("keep").alias("row")).distinct())
    often = common.written(stats.where("n > 0").join(keep, "row", "left_semi").groupBy("row").count().where("count > 1").select("row"))
    once = keep.join(often, "row", "left_anti").union(stats.where("n = 0").select("row").distinct())
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    stay = docs.join(once.select(F.col("row").alias("__k")), row == F.col("__k"), "left_semi")
    if often.isEmpty():
        return stay
    same = docs.join(limited(often).select(F.col("row").alias("__k")), row == F.col("__k"))
    return stay.unionByName(common.one_each(same, "__k", docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return join_documents(common.documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS shingle FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4
  ) WHERE shingle IS NOT NULL
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
q AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM q JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT e.b, r.u FROM r JOIN e ON e.a = r.v AND r.u < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.low AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(u) AS low FROM r GROUP BY v) c ON c.v = d.doc_id
"""
