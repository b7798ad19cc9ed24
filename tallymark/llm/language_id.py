"""Language ID by cross-parsing entropy.

Per language, a bounded sample of labelled text (``SAMPLE_DOCS`` distinct texts
with letters, ``SAMPLE_CHARS`` characters shared evenly among them and taken
from pieces over the length of each; both are parameters) is turned into a
suffix automaton.  A text is parsed against it: the longest match with the sample is
one phrase, the next phrase starts at the character that broke it.  Phrases
times the logarithm of the longest sample's length, and for a character that the
sample does not hold a letter code over all letters, estimate the cross entropy,
and the language that needs fewest wins (ties: the smallest name).  The logarithm
is one for all, so a tiny sample does not make phrases cheap.

Samples are small, so they are broadcast as text and each worker builds the
automata once.  A batch of texts is parsed for all languages at once, one table
look-up per character, with NumPy.  Long texts are read in lanes of ``LANE``
characters side by side, each from the root at first; then each lane is read
again from the state in which the lane before it ends, until that meets the
states of the first reading.  So the result is the parse of the text as a whole.

Defined results: null or no letter gives ``und`` and score 0; with no labelled
rows all texts are ``und``; a null doc_id is neither held out nor learned from;
rows that repeat get equal results.  ``score`` is the margin to the second
language, 0 to 1.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCS, SAMPLE_CHARS, LANE, TRACE, SPREAD, PIECES = 64, 20_000, 2048, 256, 64, 4


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def water_level(lengths: list[int], room: int) -> int:
    """The largest level at which ``lengths``, each cut to the level, fit ``room``."""
    left, level = room, 0
    for i, n in enumerate(sorted(lengths)):
        level = left // (len(lengths) - i)
        if n > level:
            return level
        left -= n
    return max([level, *lengths])


def spread(text: Column, level: Column) -> Column:
    """A text of at most ``level`` characters: ``PIECES`` pieces at even distances of a longer one."""
    size = F.greatest(F.expr(f"level div {PIECES}"), F.lit(1))
    begin = lambda i: F.floor((F.length(text) - size) * (i / (PIECES - 1))).cast("int") + 1
    pieces = F.concat_ws(" ", *[F.substring(text, begin(i), size) for i in range(PIECES)])
    return F.when(F.length(text) <= level, text).otherwise(pieces)


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Language -> training text: at most ``sample_docs`` distinct texts with letters and ``sample_chars`` characters each."""
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.xxhash64("text").alias("t"))
    rows = usable.groupBy("lang", "t").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.length("text").alias("size"))).alias("d")).select("lang", "t", "d.*")
    # Two steps, so that no task sorts all documents of a language.
    first = rows.select("*", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(SPREAD))).orderBy("h", "doc_id", "t")).alias("r")).where(F.col("r") <= sample_docs)
    chosen = first.select("doc_id", "lang", "t", "size", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t")).alias("nth")).where(F.col("nth") <= sample_docs).collect()  # numbers of at most sample_docs texts a language
    levels = {lang: water_level([c["size"] for c in chosen if c["lang"] == lang], sample_chars) for lang in {c["lang"] for c in chosen}}
    wanted = docs.sparkSession.createDataFrame([(c["doc_id"], c["lang"], c["t"], c["nth"], levels[c["lang"]]) for c in chosen], "doc_id long, lang string, t long, nth int, level int")
    texts = usable.join(F.broadcast(wanted), ["doc_id", "lang", "t"]).select("lang", "nth", spread(F.col("text"), F.col("level")).alias("text")).dropDuplicates(["lang", "nth"])
    out: dict[str, str] = {}
    for lang, _, text in sorted(tuple(r) for r in texts.collect()):
        out[lang] = (out.get(lang, "") + " " + text)[: sample_chars + sample_docs * PIECES]
    return {lang: text for lang, text in out.items() if any(c.isalpha() for c in text)}


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return to


class Parser:
    """Dense parse table of all languages: next state and whether a phrase ended, by state and character class."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.langs = [lang for lang, _ in samples]
        letters = sorted({c for _, t in samples for c in t.lower() if c.isalpha()})
        self.classes = len(letters) + 2  # 0: no letter, 1: a letter that no sample holds
        self.kind = np.zeros(0x110000, np.uint16)
        alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.alpha = alpha
        self.letter = math.log2(int(alpha.sum()) + 1)
        self.kind[alpha] = 1
        for i, c in enumerate(letters):
            self.kind[ord(c)] = i + 2
        for i in range(0x3000):  # capitals of the samples' letters
            low = chr(i).lower()
            if len(low) == 1:
                self.kind[i] = self.kind[ord(low)]
        tables, self.roots, longest, at = [], [], 0, 0
        for _, text in samples:
            symbols = self.symbols(text).tolist()
            to = suffix_automaton(symbols)
            start = [to[0].get(c, 0) for c in range(self.classes)]
            row = np.array([[((s + at) * self.classes) << 2 | (0 if s else 2) | 1 for s in start]], np.int64)  # a phrase ends, the next starts here; 2: with a character that the sample lacks
            table = np.repeat(row, len(to), axis=0)
            for s, moves in enumerate(to):
                for c, t in moves.items():
                    table[s, c] = ((t + at) * self.classes) << 2
            tables.append(table)
            self.roots.append(at * self.classes)
            longest = max(longest, len(symbols))
            at += len(to)
        self.log = math.log2(longest + 2)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
        if len(self.table) and self.table.max() < 2**31:
            self.table = self.table.astype(np.int32)

    def symbols(self, text: str) -> np.ndarray:
        """Character classes, runs without letters as one."""
        c = self.kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(c) > 1:
            c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
        return c

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases by text and language."""
        return self.parse(texts)[0]

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases, and characters that the sample lacks, by text and language."""
        lanes, owner, before = [], [], []
        for i, t in enumerate(texts):
            s = self.symbols(t)
            for at in range(0, len(s), LANE):
                before.append(len(lanes) - 1 if at else -1)
                lanes.append(s[at : at + LANE])
                owner.append(i)
        out, lacking = np.zeros((2, len(texts), len(self.langs)), np.int64)
        if not lanes:
            return out, lacking
        order = sorted(range(len(lanes)), key=lambda i: -len(lanes[i]))
        sizes = np.array([len(lanes[i]) for i in order])
        place = np.empty(len(lanes), np.int64)
        place[order] = np.arange(len(lanes))
        prev = np.array([place[before[i]] if before[i] >= 0 else -1 for i in order])
        grid = np.zeros((sizes[0], len(order)), np.int32)
        for k, i in enumerate(order):
            grid[: len(lanes[i]), k] = lanes[i]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes longer than t
        shape = (len(self.langs), len(order))
        state = np.repeat(np.array(self.roots, self.table.dtype)[:, None], len(order), axis=1)
        count, lacks = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        follows = int((prev >= 0).sum())
        trace = np.zeros((min(TRACE, sizes[0]) if follows else 0, 3, *shape), np.int32 if self.table.dtype == np.int32 else np.int64)
        for t in range(sizes[0]):
            n = active[t]
            entry = self.table[state[:, :n] + grid[t, :n]]
            count[:, :n] += entry & 1
            lacks[:, :n] += (entry >> 1) & 1
            state[:, :n] = entry >> 2
            if t < len(trace):
                trace[t] = state, count, lacks
        if follows:
            self.stitch(grid, sizes, prev, trace, state, count, lacks)
        count[:, prev < 0] += 1  # the first phrase of each text
        np.add.at(out, np.array(owner)[order], count.T)
        np.add.at(lacking, np.array(owner)[order], lacks.T)
        return out, lacking

    def stitch(self, grid: np.ndarray, sizes: np.ndarray, prev: np.ndarray, trace: np.ndarray, end: np.ndarray, count: np.ndarray, lacks: np.ndarray) -> None:
        """Correct ``count`` and ``lacks`` of lanes that follow another one of their text, in place."""
        first_count, first_lacks, first_end = count.copy(), lacks.copy(), end.copy()
        follower = np.full(len(sizes), -1)
        follower[prev[prev >= 0]] = np.flatnonzero(prev >= 0)
        lane = np.repeat(np.flatnonzero(prev >= 0), len(self.langs))
        lang = np.tile(np.arange(len(self.langs)), len(lane) // len(self.langs))
        while len(lane):
            state, n, no = end[lang, prev[lane]].copy(), np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
            again, t = [], 0
            while len(lane):
                entry = self.table[state + grid[t, lane]]
                n, no, state = n + (entry & 1), no + ((entry >> 1) & 1), entry >> 2
                same = state == trace[t, 0, lang, lane] if t < len(trace) else np.zeros(len(lane), bool)
                t += 1
                over = ~same & (t >= sizes[lane])
                g, k = lang[same], lane[same]  # from here on as in the first reading
                new_end = first_end[g, k]
                count[g, k] = n[same] + first_count[g, k] - trace[t - 1, 1, g, k] if len(g) else 0
                lacks[g, k] = no[same] + first_lacks[g, k] - trace[t - 1, 2, g, k] if len(g) else 0
                g2, k2 = lang[over], lane[over]
                count[g2, k2], lacks[g2, k2] = n[over], no[over]
                for gs, ks, ends in ((g, k, new_end), (g2, k2, state[over])):
                    moved = (end[gs, ks] != ends) & (follower[ks] >= 0)
                    end[gs, ks] = ends
                    again.append((gs[moved], follower[ks[moved]]))
                go = ~same & ~over
                lane, lang, state, n, no = lane[go], lang[go], state[go], n[go], no[go]
            lang, lane = (np.concatenate(x) for x in zip(*again))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        real = [i for i, t in enumerate(texts) if t and self.alpha[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()]
        if not real or not self.langs:
            return lang, score
        at, size, groups = 0, 0, [[]]
        for i in real:  # bounded memory: a few million characters at once
            groups[-1].append(i)
            size += len(texts[i])
            if size > 4_000_000:
                groups.append([])
                size = 0
        for g in groups:
            count, lacking = self.parse([texts[i] for i in g])
            cost = count * self.log + lacking * self.letter
            for i, row in zip(g, cost):
                best = int(row.argmin())
                rest = np.delete(row, best)
                lang[i], score[i] = self.langs[best], float(1 - row[best] / rest.min()) if len(rest) else 1.0
        return lang, score


@functools.lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """Built once per worker."""
    return Parser(samples)


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    learned = sample(docs, sample_docs, sample_chars)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(learned.items())))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = parser(shared.value)
        for f in frames:
            lang, score = p.predict(list(f["text"]))
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "lang_pred": lang, "score": score})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return identify(common.documents(spark, sf_dir))
