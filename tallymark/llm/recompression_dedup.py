"""Substring dedup by recompression, on words.

Rounds of recompression name first the runs of one symbol, then the pairs of a
left and a right symbol; a hash bit of its name tells a symbol's side, so who
pairs with whom depends on the two names alone.  Names are hashes of what they
stand for and hence the same in every document and task: each round is global
without a table of names.  Equal substrings get equal symbols in their
interior.  Every symbol carries the span of words that it stands for and the
zone of words that decided it; a window of 20 words files itself under the
zone of the least name among the symbols whose zone lies in the window, so equal
windows share a symbol, and windows without such a symbol under a name of their own.
Shared symbols then reveal long repeats: equal runs of windows are settled at
once, and where runs with one symbol differ, the words themselves are compared
window by window (see ``anchored``).

Runs of more than ``LONG_RUN`` equal symbols keep single symbols, marked as
parts of a long run: their zone stays short.

Removed is each word covered by a window of 20 words that also starts earlier
(a smaller doc_id, or an earlier start in the same document).  Defined results:
null has no words; a null doc_id comes first; rows that repeat a doc_id are the
same document: windows at equal starts count as one, and each row loses only
what it repeats itself; fewer than 20 words lose nothing.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .anchored import RUNS, Repeats, covered, rows
from .hashing import mix, spans, word_bounds

WIDTH, ROUNDS, LONG_RUN, BLOCK = 20, 2, 3, 1 << 19
FAR = 1 << 40  # beyond any text: the zone of a symbol at a border


def hashed_words(data: np.ndarray, cuts: np.ndarray, seed: int) -> np.ndarray:
    """A hash per word, in order."""
    h = spans(seed)
    first, last = word_bounds(data, cuts)
    return h.of(h.prefix(data), first, last)


def recompress(name: np.ndarray, text: np.ndarray, rounds: int = ROUNDS, long_run: int = LONG_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after ``rounds``, and the zone ``[from, to)`` of words that decided each.

    ``text`` tells the text of each word; nothing reaches from one into another.
    """
    start = np.arange(len(name), dtype=np.int64)
    end = start + 1
    for level in range(rounds):
        salt = np.uint64(2 * level + 1)
        # Blocks: maximal runs of a symbol.
        same = (name[1:] == name[:-1]) & (text[1:] == text[:-1])
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        size = np.diff(np.append(head, len(name)))
        whole = size <= long_run
        # In a long run each symbol stays; whether a run is long shows within long_run symbols to either side.
        keep = np.repeat(~whole, size)
        keep[head[whole]] = True
        pick = np.flatnonzero(keep)
        run = (np.cumsum(np.concatenate(([True], ~same))) - 1)[pick]
        long = ~whole[run]
        tail = np.where(long, pick, head[run] + size[run] - 1)
        new = np.where(long, mix(name[pick] + np.uint64(977)), np.where(size[run] > 1, mix(name[pick] * np.uint64(31) + size[run].astype(np.uint64) + salt), name[pick]))
        # A whole run is known by its two neighbours; the first parts of a long one by the neighbour before and
        # long_run + 1 equal symbols, later parts by the symbols before.  Such zones never step back along the text.
        top = len(name) - 1
        early = pick - head[run] < long_run
        lo = np.where(long & ~early, pick - long_run, head[run] - 1)
        hi = np.where(long, np.where(early, head[run] + long_run, pick), tail + 1)
        start_out = np.where((lo >= 0) & (text[np.maximum(lo, 0)] == text[pick]), start[np.maximum(lo, 0)], -FAR)
        end_out = np.where((hi <= top) & (text[np.minimum(hi, top)] == text[pick]), end[np.minimum(hi, top)], FAR)
        name, start, end, text = new, start_out, end_out, text[pick]
        # Pairs: a left symbol and a right one after it.
        left = (mix(name + salt) & np.uint64(1)) == 0
        join = np.zeros(len(name), bool)
        join[:-1] = left[:-1] & ~left[1:] & (text[1:] == text[:-1])
        inside = np.concatenate(([False], text[1:] == text[:-1]))
        # A left symbol looks at the next one, a right symbol at the one before.
        nxt, prv = np.append(end[1:], FAR), np.append(-FAR, start[:-1])
        follows = np.append(inside[1:], False)
        end_own = np.where(left, np.where(follows, np.maximum(nxt, end), FAR), end)
        start_own = np.where(~left, np.where(inside, np.minimum(prv, start), -FAR), start)
        second = np.concatenate(([False], join[:-1]))
        at = np.flatnonzero(~second)
        two = join[at]
        mate = np.minimum(at + 1, len(name) - 1)
        new = np.where(two, mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + name[mate] + salt), name[at])
        name, start, end, text = new, np.where(two, start[at], start_own[at]), np.where(two, end[mate], end_own[at]), text[at]
    return name, start, end


class WordRepeats(Repeats):
    same_doc = True

    def __init__(self, width: int = WIDTH, rounds: int = ROUNDS) -> None:
        self.width, self.rounds = width, rounds

    def runs(self, texts: Iterator[tuple[tuple[int, int], bytes]]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for doc, text in texts:
            held.append((doc, text))
            size += len(text)
            if size >= BLOCK:
                yield from self.block_runs(held)
                held, size = [], 0
        if held:
            yield from self.block_runs(held)

    def block_runs(self, texts: list[tuple[tuple[int, int], bytes]]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b" ".join(t for _, t in texts), np.uint8)
        length = np.array([len(t) + 1 for _, t in texts], np.int64)
        cuts = np.cumsum(length) - length
        first, last = word_bounds(data, cuts)
        if not len(first):
            return
        h = spans(4)
        word = h.of(h.prefix(data), first, last)
        text = np.searchsorted(cuts, first, "right") - 1
        name, zone_from, zone_to = recompress(word, text, self.rounds)
        n = len(word) - self.width + 1
        if n <= 0:
            return
        begin = np.searchsorted(text, np.arange(len(texts)))  # first word of each text
        # Zones that reach over a border of a text serve no window.
        good = np.flatnonzero((zone_from >= 0) & (zone_to < FAR))
        name, zone_from, zone_to = name[good], zone_from[good], zone_to[good]
        start = np.arange(n, dtype=np.int64)
        lo, hi = np.searchsorted(zone_from, start, "left"), np.searchsorted(zone_to, start + self.width, "right")
        some = hi > lo
        where = np.where(some, lo, 0)
        if len(name):
            # Leftmost least name of each stretch [lo, hi): two overlapping powers of two.
            size, best = np.where(some, hi - lo, 1), np.arange(len(name))
            power = np.floor(np.log2(size)).astype(np.int64)
            value = mix(name)
            table = [best]
            for p in range(int(power.max())):
                b = table[-1]
                step = 1 << p
                other = np.append(b[step:], np.full(min(step, len(b)), len(name) - 1))[: len(b)]
                table.append(np.where(value[other] < value[b], other, b))
            for p, b in enumerate(table):
                mine = np.flatnonzero(some & (power == p))
                x, y = b[lo[mine]], b[hi[mine] - (1 << p)]
                where[mine] = np.where(value[y] < value[x], y, x)
        prefix = h.prefix(word)
        own = h.of(prefix, start, start + self.width)
        # The key is all that decided the symbol, not only what it stands for: it is rarer.
        key = np.where(some, mix(h.of(prefix, zone_from, zone_to) + np.uint64(5))[where] if len(name) else own, own)
        real = text[self.width - 1 :] == text[:n]
        new = np.ones(n + 1, bool)
        new[1:n] = (where[1:] != where[:-1]) | ~real[:-1] | ~some[1:] | ~some[:-1]
        head = np.flatnonzero(real & new[:n])
        tail = np.flatnonzero(real & (new[1:] | ~np.append(real[1:], False)))
        ids = np.array([d for d, _ in texts], np.int64)
        own_text = text[head]
        yield rows(key[head], h.of(prefix, head, tail + self.width), ids[own_text], head - begin[own_text], tail - head + 1)

    def windows(self, text: bytes, open_spans: np.ndarray) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        n = open_spans["n"].astype(np.int64)
        at = np.repeat(open_spans["at"], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = None
        for name, seed in (("k", 5), ("r", 6)):
            h = spans(seed)
            prefix = h.prefix(hashed_words(data, np.zeros(0, np.int64), seed))
            if out is None:
                at = at[at + self.width < len(prefix)]
                out = np.zeros(len(at), RUNS)
            out[name] = h.of(prefix, at, at + self.width)
        out["at"], out["n"] = at, 1
        return out


    def pieces(self, text: bytes, open_spans: np.ndarray) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[at : at + n - 1 + self.width]) for at, n in zip(open_spans["at"].tolist(), open_spans["n"].tolist())]

    def buckets(self, pieces: list[bytes]) -> tuple[np.ndarray, int, np.ndarray]:
        names: dict[bytes, int] = {}
        each = [t.split(b" ") for t in pieces]
        ids = np.array([names.setdefault(w, len(names)) for t in each for w in t], np.int64)
        return ids, 1, np.array([len(t) for t in each], np.int64)


def dedup_passages(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: kept words joined by one space."""

    def finish(text: bytes, found: np.ndarray) -> tuple:
        words = text.split()
        gone = covered(len(words), found, width)
        n = int(gone.sum())
        return len(words), n, b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n else words)

    return WordRepeats(width, rounds).find(docs.select("doc_id", "text"), finish, "n_words long, n_removed long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_passages(common.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
p2 AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o AS w2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p4 AS (SELECT doc_id, i, w2 || ' ' || lead(w2, 2) OVER o AS w4 FROM p2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p8 AS (SELECT doc_id, i, w4, w4 || ' ' || lead(w4, 4) OVER o AS w8 FROM p4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, w8 || ' ' || lead(w8, 8) OVER o || ' ' || lead(w4, 16) OVER o AS g FROM p8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g WHERE g IS NOT NULL) WHERE k > 1),
b AS (SELECT p.doc_id, p.i, p.word, coalesce(max(s.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) > p.i - 20, false) AS gone FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.i = p.i),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM b GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""
