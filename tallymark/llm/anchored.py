"""Repeated windows across documents, found through content-chosen anchors.

Used by ``suffix_dedup`` (bytes) and ``recompression_dedup`` (words).  Both ask
which windows of ``width`` symbols also start earlier, and neither can ship a
row per window.  So every window is filed under an anchor inside it that is
chosen by content alone: equal windows choose equal anchors.  Neighbouring
windows with one anchor form a run, and only runs travel:

1. map: runs ``(anchor key, hash of all the run covers, document, row, start,
   length)``.  Equal runs of a task are settled at once, so a passage that a
   third of all documents hold leaves a task once.
2. by anchor key: equal runs are settled (all but the first are repeats).  If an
   anchor has different runs, they may still share some windows: they stay open.
3. by row: the text of open runs is cut out and goes to the anchor's part.
4. by anchor: a part sorts the windows of its open runs by content, with
   bucket-pointer refinement (see ``refine``): all but the first of a bucket are
   repeats.
5. by row: repeats are laid over the text.

The document says what is earlier; a row, a hash of id and text, says where a
span was found: rows that share an id, or have none, do not share their spans.

Rows are packed into NumPy columns, a binary value per task and target part.
An anchor with very many different runs in a task (more than ``HOT``) would make
a large part: one marker goes to its key, and its open runs are cut into windows,
each named by 96 bits of hash and dealt by its own name.  Parts and groups of
rows are as many as the texts have multiples of ``PART_BYTES``, a part goes to the
task of its number, and a task takes one at a time.  Within a part, keys are taken
in steps: up to about ``FLUSH`` runs are settled, ``STEP_BYTES`` of text sorted at once.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import mix

NONE = -(2**63)  # a null doc_id: before all others
HOT, FLUSH, HOT_FLAG, PART_BYTES, STEP_BYTES = 64, 300_000, 128, 16 << 20, 1 << 19
RUNS = np.dtype([("k", "<u8"), ("r", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("at", "<i8"), ("n", "u1")])
SPANS = RUNS  # spans use doc, row, at, n only


def rows(k, r, ids, at, n) -> np.ndarray:
    """``ids`` are pairs of document and row."""
    out = np.empty(len(ids), RUNS)
    out["k"], out["r"], out["doc"], out["row"], out["at"], out["n"] = k, r, ids[:, 0], ids[:, 1], at, n
    return out


def six(x: np.ndarray) -> bytes:
    """Six bytes of each value: keys are compared by 96 bits beside the part they are dealt to."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def packed(part: np.ndarray, keys: bool) -> bytes:
    """Columns one after another, documents and rows as differences, compressed."""
    head = len(part).to_bytes(4, "little") + bytes([keys])
    cols = [np.diff(part["doc"], prepend=0).tobytes(), *(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (part["at"], np.diff(part["row"], prepend=0))), part["n"].tobytes()]
    body = zstandard.ZstdCompressor(level=1).compress(b"".join(cols))
    if keys:
        body = len(body).to_bytes(4, "little") + body + six(part["k"]) + six(part["r"])
    return head + body


def unpacked(data: bytes) -> np.ndarray:
    n, keys, at = int.from_bytes(data[:4], "little"), data[4], 5
    out = np.zeros(n, RUNS)
    if keys:
        size = int.from_bytes(data[5:9], "little")
        at = 9 + size
        for name in ("k", "r"):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
            out[name] = wide.view("<u8").ravel()
            at += 6 * n
        at = 9 + size
        body = data[9:at]
    else:
        body = data[5:]
    raw = zstandard.ZstdDecompressor().decompress(body)
    out["doc"] = np.cumsum(np.frombuffer(raw, "<i8", n, 0))
    for i, name in ((1, "at"), (2, "row")):
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 * n * i).reshape(8, n).T).view("<i8").ravel()
    out["row"] = np.cumsum(out["row"])
    out["n"] = np.frombuffer(raw, np.uint8, n, 24 * n)
    return out


def dealt(kind: int, part: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """``items`` by target part, otherwise in the order they have."""
    if not len(items):
        return
    small = part.astype(np.uint16) if int(part.max()) < 1 << 16 else part  # sorted by counting
    order = np.argsort(small, kind="stable")
    items, part = items[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip([0, *cuts], [*cuts, len(part)]):
        yield kind, int(part[s]), packed(items[s:e], kind != SETTLED)


def frame(out: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["kind", "part", "payload"]).astype({"kind": "int32", "part": "int32"})


SCHEMA = "kind int, part int, payload binary"
OPEN, SETTLED, CUT = 0, 1, 2


def by_key(items: np.ndarray) -> np.ndarray:
    """An order by key, then content, document and start; most keys come once, and only the others need more than one sort."""
    order = np.argsort(items["k"])
    k = items["k"][order]
    twice = np.zeros(len(k), bool)
    twice[1:] = k[1:] == k[:-1]
    twice[:-1] |= twice[1:]
    some = order[twice]
    part = items[some]
    order[twice] = some[np.lexsort((part["at"], part["doc"], part["r"], part["k"]))]
    return order


def settle(items: np.ndarray, same_doc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of ``items`` by key, ``items`` in it, and which of them repeat an earlier one."""
    order = by_key(items)
    items = items[order]
    new = np.ones(len(items), bool)
    new[1:] = (items["k"][1:] != items["k"][:-1]) | (items["r"][1:] != items["r"][:-1])
    if not len(items):
        return order, items, ~new
    first = items[["doc", "at"]][new][np.cumsum(new) - 1]
    later = items["doc"] > first["doc"]
    # A row that comes twice has its windows twice, at the same starts: they do not repeat each other.
    return order, items, later | (items["at"] > first["at"]) if same_doc else later


def steps(k: np.ndarray, size: np.ndarray | int, most: int) -> Iterator[np.ndarray]:
    """Places of ``k`` in steps of about ``most`` by ``size``, each in rising order; equal keys are in one step."""
    n = -(-int(np.sum(np.broadcast_to(size, k.shape))) // most)
    if n < 2:
        yield np.arange(len(k))
        return
    step = (mix(np.ascontiguousarray(k)) >> np.uint64(32)) % np.uint64(n)  # parts are dealt by the low end
    order = np.argsort(step.astype(np.uint16) if n < 1 << 16 else step, kind="stable")
    yield from np.split(order, np.cumsum(np.bincount(step.astype(np.int64), minlength=n))[:-1])


def refine(ids: np.ndarray, depth: int, start: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int, same_doc: bool) -> np.ndarray:
    """Which windows of ``width`` symbols at ``start`` also start earlier, by bucket-pointer refinement.

    ``ids[i]`` is the bucket of the ``depth`` symbols from i on, in sorted order.
    A window's bucket is refined by sorting on its own bucket and the bucket at a
    later offset, which doubles its depth; the buckets found serve the next turn
    at all offsets.  Windows alone in a bucket, there or here, are done.
    """
    if not len(start):
        return np.zeros(0, bool)
    active = np.zeros(len(ids), bool)  # positions whose bucket a window needs
    for offset in range(width - depth + 1):
        active[start + offset] = True
    while depth < width:
        step = min(depth, width - depth)
        held = np.bincount(ids[active], minlength=int(ids.max()) + 1)
        alone = held[ids] < 2
        left = np.flatnonzero(active)
        left = left[left + step < len(ids)]
        left = left[active[left + step] & ~alone[left] & ~alone[left + step]]
        _, bucket = np.unique(ids[left].astype(np.int64) * (int(ids.max()) + 1) + ids[left + step], return_inverse=True)
        ids = np.zeros(len(ids), np.int64)
        active = np.zeros(len(ids), bool)
        ids[left], active[left] = bucket, True
        depth += step
    live = np.flatnonzero(active[start])
    out = np.zeros(len(start), bool)
    if len(live):
        bucket = ids[start[live]]
        order = np.lexsort((at[live], doc[live], bucket))
        live, bucket = live[order], bucket[order]
        new = np.ones(len(live), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        first = live[new][np.cumsum(new) - 1]
        later = doc[live] > doc[first]
        out[live] = later | (at[live] > at[first]) if same_doc else later
    return out


def group_of(row: np.ndarray, groups: int) -> np.ndarray:
    return (mix(row.view("<u8")) % np.uint64(groups)).astype(np.int32)


def send_runs(items: np.ndarray, same_doc: bool, parts: int, groups: int) -> list[tuple[int, int, bytes]]:
    order, ranked, repeats = settle(items, same_doc)
    left = ranked["k"][~repeats]
    new = np.ones(len(left), bool)
    new[1:] = left[1:] != left[:-1]
    size = np.diff(np.flatnonzero(np.append(new, True)))
    hot = np.repeat(size, size) > HOT
    marks = np.zeros(int((hot & new).sum()), RUNS)
    marks["k"] = left[hot & new]
    # Back to the order of texts, which compresses best.
    is_hot, gone = np.zeros(len(items), bool), np.zeros(len(items), bool)
    is_hot[order[~repeats]], gone[order] = hot, repeats
    gone, left, hot = items[gone], items[~gone], is_hot[~gone]
    left["n"][hot] |= HOT_FLAG
    part = np.where(hot, mix(left["r"]), mix(left["k"])) % np.uint64(parts)
    marked = np.concatenate([left, marks])
    part = np.concatenate([part, mix(marks["k"]) % np.uint64(parts)]).astype(np.int32)
    return [*dealt(OPEN, part, marked), *dealt(SETTLED, group_of(gone["row"], groups), gone)]


def by_part(frames: Iterator[pd.DataFrame]) -> Iterator[dict[int, list[bytes]]]:
    """The payloads of each part, by kind, one part at a time: the rows come sorted by part."""
    rows = ((p, k, b) for f in frames for p, k, b in zip(f["part"], f["kind"], f["payload"]))
    for _, of_part in itertools.groupby(rows, key=lambda r: r[0]):
        kinds: dict[int, list[bytes]] = defaultdict(list)
        for _, k, b in of_part:
            kinds[int(k)].append(bytes(b))
        yield kinds


def joined(payloads: list[bytes]) -> np.ndarray:
    return np.concatenate([unpacked(p) for p in payloads]) if payloads else np.zeros(0, RUNS)


def spans_by_group(kind: int, items: np.ndarray, groups: int, keys: bool = False) -> Iterator[tuple[int, int, bytes]]:
    return ((kind, g, packed(items_g, keys)) for _, g, items_g in unpacked_groups(items, groups))


def unpacked_groups(items: np.ndarray, groups: int) -> Iterator[tuple[int, int, np.ndarray]]:
    if not len(items):
        return
    part = group_of(items["row"], groups)
    order = np.lexsort((items["at"], items["row"], items["doc"], part))
    items, part = items[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip([0, *cuts], [*cuts, len(part)]):
        yield 0, int(part[s]), items[s:e]


def cut_out(items: np.ndarray, texts: list[bytes]) -> bytes:
    """Open runs with their own text."""
    head = packed(items, True)
    sizes = np.array([len(t) for t in texts], "<u4").tobytes()
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(texts))


def cut_in(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    size = int.from_bytes(data[:4], "little")
    items = unpacked(data[4 : 4 + size])
    raw = zstandard.ZstdDecompressor().decompress(data[4 + size :])
    sizes = np.frombuffer(raw, "<u4", len(items))
    end = 4 * len(items) + np.cumsum(sizes.astype(np.int64))
    return items, [raw[e - n : e] for e, n in zip(end.tolist(), sizes.tolist())]


def long_spans(items: np.ndarray) -> np.ndarray:
    """The same windows in order of row and start, as few spans of up to 127."""
    if not len(items):
        return items
    items = items[np.lexsort((items["at"], items["row"], items["doc"]))]
    new = np.ones(len(items), bool)
    new[1:] = (items["row"][1:] != items["row"][:-1]) | (items["doc"][1:] != items["doc"][:-1])
    row = np.cumsum(new) << 32  # starts are below
    end = np.maximum.accumulate(row + items["at"] + items["n"])
    new[1:] |= (row + items["at"])[1:] > end[:-1]
    head = np.flatnonzero(new)
    n = end[np.append(head[1:], len(items)) - 1] - (row + items["at"])[head]
    cuts = -(-n // 127)
    inside = 127 * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    out = items[np.repeat(head, cuts)]
    out["at"] += inside
    out["n"] = np.minimum(np.repeat(n, cuts) - inside, 127)
    return out


def of_rows(items: np.ndarray) -> Callable[[int, int], np.ndarray]:
    """A function of document and row: those of ``items`` found in it, in order of start."""
    items = items[np.lexsort((items["at"], items["row"]))]
    row = np.ascontiguousarray(items["row"])

    def own(d: int, r: int) -> np.ndarray:
        s, e = np.searchsorted(row, r, "left"), np.searchsorted(row, r, "right")
        return items[s:e][items["doc"][s:e] == d]

    return own


class Repeats:
    """The five steps for one kind of symbols; see ``suffix_dedup`` and ``recompression_dedup``.

    ``runs(texts)`` yields RUNS arrays of ``((doc, row), bytes)`` pairs, ``windows(text,
    spans)`` names the windows of open spans of hot anchors, ``pieces(text, spans)`` cuts
    out the text of other open spans, ``buckets(pieces)`` gives the first buckets
    of their symbols, their depth and the number of symbols of each piece.
    ``same_doc`` tells whether an earlier start in the same document counts.
    """

    width: int
    same_doc: bool

    def runs(self, texts: Iterator[tuple[tuple[int, int], bytes]]) -> Iterator[np.ndarray]:
        raise NotImplementedError

    def windows(self, text: bytes, spans: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def pieces(self, text: bytes, spans: np.ndarray) -> list[bytes]:
        raise NotImplementedError

    def buckets(self, pieces: list[bytes]) -> tuple[np.ndarray, int, np.ndarray]:
        raise NotImplementedError

    def repeats_of(self, payloads: list[bytes]) -> np.ndarray:
        """The spans of ``CUT`` payloads that repeat earlier windows."""
        got = [cut_in(b) for b in payloads]
        every, texts = np.concatenate([i for i, _ in got]), [t for _, of in got for t in of]
        found = []
        for step in steps(every["k"], np.array([len(t) for t in texts], np.int64), STEP_BYTES):
            items = every[step]
            ids, depth, size = self.buckets([texts[i] for i in step.tolist()])
            n = np.minimum(items["n"].astype(np.int64), np.maximum(size - self.width + 1, 0))
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.repeat(np.arange(len(items)), n)
            start, at, doc = (np.cumsum(size) - size)[own] + inside, items["at"][own] + inside, items["doc"][own]
            gone = refine(ids, depth, start, doc, at, self.width, self.same_doc)
            out = np.zeros(int(gone.sum()), RUNS)
            out["doc"], out["row"], out["at"], out["n"] = doc[gone], items["row"][own[gone]], at[gone], 1
            found.append(long_spans(out))
        return long_spans(np.concatenate(found))

    def find(self, docs: DataFrame, finish: Callable[[bytes, np.ndarray], tuple], schema: str) -> DataFrame:
        """``finish(text, spans)`` for every row, with the spans of repeated windows found in it."""
        n = common.parallel(docs)
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = groups = max(n, -(-total // PART_BYTES))
        same_doc = self.same_doc
        body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("body"))
        body = body.select("doc", F.xxhash64("doc", "body").alias("row"), "body")

        def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, size = [], 0
            for got in self.runs(((d, r), bytes(b)) for f in frames for d, r, b in zip(f["doc"].tolist(), f["row"].tolist(), f["body"])):
                held.append(got)
                size += len(got)
                if size > FLUSH:
                    yield frame(send_runs(np.concatenate(held), same_doc, parts, groups))
                    held, size = [], 0
            if held:
                yield frame(send_runs(np.concatenate(held), same_doc, parts, groups))

        def by_anchor(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for kinds in by_part(frames):
                every = joined(kinds.pop(OPEN, []))
                gone, hot, cut = [], [], []
                for step in steps(every["k"], 1, FLUSH):
                    items = every[step]
                    marks = items["n"] == 0
                    shared = np.unique(items["k"][marks])
                    _, items, repeats = settle(items[~marks], same_doc)
                    gone.append(items[repeats])
                    left = items[~repeats]
                    if not len(left):
                        continue
                    new = np.ones(len(left), bool)
                    new[1:] = left["k"][1:] != left["k"][:-1]
                    differ = np.zeros(len(left), bool)
                    differ[1:] = ~new[1:] & (left["r"][1:] != left["r"][:-1])
                    several = np.add.reduceat(differ, np.flatnonzero(new)) > 0
                    size = np.diff(np.flatnonzero(np.append(new, True)))
                    is_hot = (left["n"] >= HOT_FLAG) | np.isin(left["k"], shared)
                    hot.append(left[is_hot])
                    cut.append(left[np.repeat(several, size) & ~is_hot])
                del every
                gone, hot, cut = (np.concatenate([np.zeros(0, RUNS), *x]) for x in ([*gone, joined(kinds[SETTLED])], hot, cut))
                hot["n"] &= HOT_FLAG - 1
                gone["n"] &= HOT_FLAG - 1
                yield frame([*spans_by_group(OPEN, hot, groups), *spans_by_group(CUT, cut, groups, True), *spans_by_group(SETTLED, gone, groups)])

        def open_up(text: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
            kinds = next(by_part(iter([spans])), defaultdict(list))
            hot, cold = of_rows(joined(kinds[OPEN])), of_rows(joined(kinds[CUT]))
            found, taken, pieces = [], [], []
            for d, r, b in zip(text["doc"].tolist(), text["row"].tolist(), text["body"]):
                own, mine = hot(d, r), cold(d, r)
                if not len(own) and not len(mine):
                    continue
                whole = zstandard.ZstdDecompressor().decompress(bytes(b))
                if len(own):
                    found.append(self.windows(whole, own))
                    found[-1]["doc"], found[-1]["row"] = d, r
                if len(mine):
                    taken.append(mine)
                    pieces += self.pieces(whole, mine)
            out = [(SETTLED, k % parts, p) for k, p in zip(itertools.repeat(int(spans["part"].iloc[0]) if len(spans) else 0), kinds[SETTLED])]
            if found:
                _, named, repeats = settle(np.concatenate(found), same_doc)
                gone, left = named[repeats], named[~repeats]
                out += [*dealt(OPEN, (mix(left["k"]) % np.uint64(parts)).astype(np.int32), left), *dealt(SETTLED, group_of(gone["row"], parts), gone)]
            if taken:
                mine = np.concatenate(taken)
                part = (mix(mine["k"]) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                for s, e in zip([0, *cuts], [*cuts, len(order)]):
                    out.append((CUT, int(part[order[s]]), cut_out(mine[order[s:e]], [pieces[i] for i in order[s:e]])))
            return frame(out)

        def by_window(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for kinds in by_part(frames):
                every, found = joined(kinds.pop(OPEN, [])), []
                for step in steps(every["k"], 1, FLUSH):
                    _, items, repeats = settle(every[step], same_doc)
                    found.append(long_spans(items[repeats]))
                gone = [long_spans(np.concatenate(found)), joined(kinds[SETTLED])]
                if kinds[CUT]:
                    gone.append(self.repeats_of(kinds[CUT]))
                yield frame(list(spans_by_group(SETTLED, np.concatenate(gone), groups)))

        def lay_over(text: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
            found = of_rows(joined([bytes(p) for p in spans["payload"]]))
            out = []
            for d, r, b in zip(text["doc"].tolist(), text["row"].tolist(), text["body"]):
                out.append((d, *finish(zstandard.ZstdDecompressor().decompress(bytes(b)), found(d, r))))
            return pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in f"doc long, {schema}".split(",")])

        def grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pack = zstandard.ZstdCompressor(level=1)
            for f in frames:
                yield pd.DataFrame({"part": group_of(f["row"].to_numpy(np.int64), groups), "doc": f["doc"], "row": f["row"], "body": [pack.compress(bytes(b)) for b in f["body"]]})

        # One exchange of the texts, compressed, serves steps 3 and 5.
        text = body.mapInPandas(grouped, "part int, doc long, row long, body binary")
        runs = body.mapInPandas(anchors, SCHEMA).repartitionById(n, F.col("part")).sortWithinPartitions("part").mapInPandas(by_anchor, SCHEMA)
        opened = text.groupBy("part").cogroup(runs.groupBy("part")).applyInPandas(open_up, SCHEMA)
        spans = opened.repartitionById(n, F.col("part")).sortWithinPartitions("part").mapInPandas(by_window, SCHEMA)
        laid = text.groupBy("part").cogroup(spans.groupBy("part")).applyInPandas(lay_over, f"doc long, {schema}")
        return laid.withColumn("doc_id", F.nullif("doc", F.lit(NONE))).drop("doc")


def covered(length: int, spans: np.ndarray, width: int) -> np.ndarray:
    """Which of ``length`` symbols lie in windows that start in ``spans``."""
    edge = np.zeros(length + 1, np.int32)
    start = np.minimum(spans["at"], length)
    end = np.minimum(spans["at"] + spans["n"] - 1 + width, length)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:length]) > 0
