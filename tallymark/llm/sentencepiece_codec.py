"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped (space becomes U+2581, one more in front) and cut where no
piece of the vocabulary can reach across: before a U+2581 that follows another
character, around characters that no longer piece holds,
and between letters and other characters if no piece joins them.  Each segment is
encoded by a score-ordered agenda of adjacent symbol pairs: the best pair (on
ties the leftmost) is merged, its new neighbours enter the agenda, and entries
whose symbols have changed are skipped.  Characters outside the vocabulary fall
back to bytes.

Segments repeat, so a worker keeps a bounded memo of them.  Every segment that
enters it is checked, batch by batch, against the sentencepiece library, for
encoding and decoding; a difference raises.

Defined results: null is the empty text, which has no ids; whole texts of any
length; rows that repeat get equal results; extra columns stay with the caller.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

META = "▁"
NEVER = 2**31 - 1
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder of one model file; ``memo`` bounds the segments kept."""

    def __init__(self, path: str, memo: int = 400_000) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("only merge-type models without normalisation or user pieces are supported")
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [p.piece for p in model.pieces]
        self.names, self.texts = [str(i) for i in range(len(self.pieces))], [p.replace(META, " ") for p in self.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        longer = [p for p in self.ids if len(p) > 1]
        inner = {c for p in longer for c in p} - {META}
        if any(b == META != a for p in longer for a, b in zip(p, p[1:])):
            self.cut = lambda s: [s] if s else []  # pieces may span words: one segment a text
        else:
            pairs = {(a, b) for p in longer for a, b in zip(p, p[1:])}
            letters = {c for c in inner if c.isalpha()}
            apart = not any((a in letters) != (b in letters) for a, b in pairs if a != META != b)
            kinds = [k for k in ((letters, inner - letters) if apart else (inner,)) if k]
            sets = ["".join(map(re.escape, sorted(k))) for k in kinds]
            self.cut = re.compile("|".join([f"{META}*[{k}]+" for k in sets] + [f"{META}+", f"[^{''.join(sets)}{META}]"])).findall if inner else list
        self.memo, self.fresh, self.old = memo, {}, {}
        # The agenda's two tables: order of merges by score, and for a pair of pieces the piece it makes.
        order = sorted(set(self.score.values()))
        place = {v: i for i, v in enumerate(order)}
        pairs = sorted((self.ids[p[:i]] * len(self.pieces) + self.ids[p[i:]], place[self.score[p]], self.ids[p]) for p in longer for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids)
        self.pair_key = np.array([k for k, _, _ in pairs] + [-1], np.int64)[np.argsort([k for k, _, _ in pairs] + [2**62])]
        self.pair_key[-1] = 2**62
        self.pair_order = np.array([r for _, r, _ in pairs] + [NEVER], np.int32)
        self.pair_piece = np.array([p for _, _, p in pairs] + [0], np.int32)

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment: merge the best adjacent pair until none is left."""
        score = self.score
        symbols = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(score[pair], i, pair) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbols[k]) in score:
                    heapq.heappush(heap, (score[new], i, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + pair) in score:
                heapq.heappush(heap, (score[new], h, new))
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out.extend([i] if i is not None else [self.bytes[b] for b in s.encode()] if self.bytes else [self.unknown])
        return out

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order of merges (``NEVER`` if the pair makes no piece) and the piece made."""
        key = left.astype(np.int64) * len(self.pieces) + right
        at = np.searchsorted(self.pair_key, key)
        hit = (self.pair_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_order[at], NEVER), self.pair_piece[at]

    def agendas(self, segments: list[str]) -> list[list[int]]:
        """``agenda`` for many segments of similar length at once: a row each, one merge a round."""
        sizes = np.array([len(s) for s in segments])
        width = int(sizes.max())
        chars = np.frombuffer("".join(s.ljust(width, "\0") for s in segments).encode("utf-32-le"), np.uint32).reshape(len(segments), width)
        kinds, place = np.unique(chars, return_inverse=True)
        sym = np.array([self.ids.get(chr(c), -2 - int(c)) for c in kinds], np.int64)[place].reshape(chars.shape)
        sym[np.arange(width) >= sizes[:, None]] = -1
        sym = np.concatenate([sym, np.full((len(sym), 1), -1)], axis=1)
        order, piece = self.look_up(sym[:, :-1], sym[:, 1:])
        done: list = [None] * len(segments)
        rows, column = np.arange(len(segments)), np.arange(width + 1)
        while len(rows):
            at = order.argmin(axis=1)
            every = np.arange(len(rows))
            over = order[every, at] == NEVER
            if over.any():
                ended = sym[over]
                for r, n, odd, line in zip(rows[over].tolist(), (ended != -1).sum(axis=1).tolist(), (ended < -1).any(axis=1).tolist(), ended.tolist()):
                    done[r] = self.finish(line) if odd else line[:n]
                keep = ~over
                rows, sym, order, piece, at = rows[keep], sym[keep], order[keep], piece[keep], at[keep]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            made = piece[every, at]
            after = column > at[:, None]
            sym = np.where(after, np.concatenate([sym[:, 1:], np.full((len(sym), 1), -1)], axis=1), sym)
            sym[every, at] = made
            moved = after[:, :-1]
            order = np.where(moved, np.concatenate([order[:, 1:], np.full((len(sym), 1), NEVER, order.dtype)], axis=1), order)
            piece = np.where(moved, np.concatenate([piece[:, 1:], np.zeros((len(sym), 1), piece.dtype)], axis=1), piece)
            order[every, at], piece[every, at] = self.look_up(made, sym[every, at + 1])
            inside = np.flatnonzero(at > 0)
            h = at[inside] - 1
            order[inside, h], piece[inside, h] = self.look_up(sym[inside, h], made[inside])
        return done

    def finish(self, symbols: list[int]) -> list[int]:
        """Ids of a merged row: characters without a piece (-2 and below) become bytes; -1 ends the row."""
        out: list[int] = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            elif s < -1:
                out.extend([self.bytes[b] for b in chr(-2 - s).encode()] if self.bytes else [self.unknown])
        return out

    def spell(self, ids: list[int], first: bool) -> str:
        """Text of ids; runs of byte pieces are decoded together."""
        if self.byte_of.keys().isdisjoint(ids):
            parts = map(self.texts.__getitem__, ids)
        else:
            parts, run = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                parts.append(self.texts[i])
            if run:
                parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts)
        return text[1:] if first and text.startswith(" ") else text

    def learn(self, segments: set[str]) -> None:
        """Encode new segments, check them against the library, and keep them."""
        if len(self.fresh) + len(segments) > self.memo:  # two generations: what was used lately stays
            self.old, self.fresh = self.fresh, {}
        todo = []
        for s in segments:
            if (ids := self.old.get(s)) is not None:
                self.fresh[s] = ids
            else:
                todo.append(s)
        # The library puts a U+2581 in front of what it gets, so segments go in behind a character that cuts there.
        theirs = self.lib.encode(["\n" + s for s in todo], num_threads=1) if todo else []
        head = len(self.lib.encode("\n"))
        todo_ids: list = [None] * len(todo)
        by_length = sorted(range(len(todo)), key=lambda i: len(todo[i]))
        for at in range(0, len(todo), 4096):
            rows = [i for i in by_length[at : at + 4096] if len(todo[i]) <= 48]
            for i, ids in zip(rows, self.agendas([todo[i] for i in rows]) if rows else []):
                todo_ids[i] = ids
        every: list[int] = []
        name = self.names.__getitem__
        for s, ids, lib_ids in zip(todo, todo_ids, theirs):
            ids = self.agenda(s) if ids is None else ids
            if ids != lib_ids[head:] and "\n" not in s:
                raise ValueError(f"the library encodes {s!r} differently")
            every.extend(ids)
            self.fresh[s] = ",".join(map(name, ids))
        if self.spell(every, False) != "".join(todo).replace(META, " "):
            raise ValueError("segments do not decode to themselves")

    def encode(self, text: str) -> str:
        """All ids of a text, decimal, joined by commas."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[str]:
        """``encode`` for a batch of texts, whose new segments are learned together."""
        cut = [self.cut(META + t.replace(" ", META)) if t else [] for t in texts]
        out, at = [], 0
        while at < len(cut):
            end, n = at, 0
            while end < len(cut) and (n == 0 or n + len(cut[end]) <= self.memo // 4):
                n += len(cut[end])
                end += 1
            if n <= self.memo // 2:
                while new := set().union(*cut[at:end]).difference(self.fresh):
                    self.learn(new)
                out.extend(",".join(map(self.fresh.__getitem__, segments)) for segments in cut[at:end])
            else:  # one long text: more segments than the memo may hold
                parts = []
                for k in range(0, n, self.memo // 4):
                    part = cut[at][k : k + self.memo // 4]
                    while new := set(part).difference(self.fresh):
                        self.learn(new)
                    parts.append(",".join(map(self.fresh.__getitem__, part)))
                out.append(",".join(parts))
            at = end
        return out

    def decode(self, ids: list[int]) -> str:
        return self.spell(ids, True)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and model."""
    return Codec(path)


def batches(frame: pd.DataFrame, chars: int = 1_500_000) -> Iterator[pd.DataFrame]:
    """Parts of a frame with about ``chars`` characters of ``body``."""
    part = (frame["body"].str.len().cumsum() // chars).to_numpy()
    for k in np.unique(part):
        yield frame[part == k]


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` (decimal, joined by commas) ``, decoded`` of every row."""
    path = model or default_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for f in frames:
            for part in batches(f):
                ids = c.encode_many(list(part["body"]))
                numbers = [list(map(int, x.split(","))) if x else [] for x in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [len(x) for x in numbers], "ids": ids, "decoded": c.lib.decode(numbers)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    return rows.mapInPandas(run, "doc_id string, n_tokens long, ids string, decoded string").withColumn("doc_id", F.col("doc_id").cast("long"))


def digest_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests are made where the ids are."""
    path = model or default_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for f in frames:
            for part in batches(f):
                ids = c.encode_many(list(part["body"]))
                decoded = [sha(c.lib.decode(list(map(int, x.split(","))) if x else [])) for x in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [x.count(",") + 1 if x else 0 for x in ids], "ids_sha256": [sha(x) for x in ids], "decoded_sha256": decoded})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    return rows.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest_documents(common.documents(spark, sf_dir))
