"""SentencePiece encoding and decoding for merge-type vocabularies with a score-ordered agenda."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .common import as_bytes, map_texts

MODEL = "piece_bpe_32k.model"
#: Bytes of segments remembered for reuse in a task: two generations of so many. An entry counts as ENTRY bytes more.
REMEMBERED, ENTRY = 64 << 20, 200
#: Longer segments use one heap; shorter ones are merged together in arrays.
ARRAY_CHARS = 48
SPACE = "▁"


def _fields(b: bytes):
    """Fields of a protocol-buffer message: (number, value)."""

    def varint(i):
        r = s = 0
        while True:
            r |= (b[i] & 127) << s
            s, i = s + 7, i + 1
            if b[i - 1] < 128:
                return r, i

    i = 0
    while i < len(b):
        k, i = varint(i)
        if k & 7 == 0:
            v, i = varint(i)
        else:
            n, i = varint(i) if k & 7 == 2 else ({5: 4, 1: 8}[k & 7], i)
            v, i = b[i : i + n], i + n
        yield k >> 3, v


class Vocabulary:
    """A merge-type model file: pieces, scores, merges and the way to write bytes."""

    def __init__(self, path: str):
        self.path = path
        self.pieces: list[str] = []
        scores, kinds, trainer, normal = [], [], {}, {}
        for f, v in _fields(open(path, "rb").read()):
            if f == 1:
                x = dict(_fields(v))
                self.pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0])
                kinds.append(x.get(3, 1))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                normal = dict(_fields(v))
        if trainer.get(3) != 2 or normal.get(1) != b"identity" or normal.get(4, 1) or not normal.get(3, 1) or not trainer.get(35):
            raise ValueError("a merge-type model with identity normalisation, dummy prefix and byte fallback is needed")
        if any(k not in (1, 2, 3, 6) for k in kinds) or any(not re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p, k in zip(self.pieces, kinds) if k == 1):
            raise ValueError("the pieces don't allow segments to be encoded one by one")
        self.unk, self.bos, self.eos = trainer.get(40, 0), trainer.get(41, 1), trainer.get(42, 2)
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 1}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 6}
        # how each id is written: a space for its sign, raw bytes for byte pieces, nothing for control pieces
        self.written = [{1: p.replace(SPACE, " ").encode(), 6: bytes([int(p[3:5], 16)]) if k == 6 else b"", 2: b" \xe2\x81\x87 "}.get(k, b"") for p, k in zip(self.pieces, kinds)]
        # symbols: pieces and single characters; merges by pair of symbols
        self.symbol = dict(self.id)
        for p in self.id:
            for c in p:
                self.symbol.setdefault(c, len(self.pieces) + len(self.symbol))
        names = {i: p for p, i in self.symbol.items()}
        size = max(names) + 2
        self.text = [names.get(i, "") for i in range(size)]
        # a lower rank is merged first; equal scores share a rank, and then the leftmost pair goes first
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.id.values()}, reverse=True))}
        self.rank = {i: order[scores[i]] for i in self.id.values()}
        self.merge: dict[tuple[int, int], int] = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                if p[:k] in self.symbol and p[k:] in self.symbol:
                    self.merge[self.symbol[p[:k]], self.symbol[p[k:]]] = i
        # the merges again as an open-addressing table for arrays
        self.mask = (1 << (4 * len(self.merge) - 1).bit_length()) - 1
        self.slot_key = np.full(self.mask + 1, -1, np.int64)
        self.slot_piece = np.zeros(self.mask + 1, np.int32)
        for (a, b), i in self.merge.items():
            key = a << 32 | b
            h = self._hash(key)
            while self.slot_key[h] >= 0:
                h = h + 1 & self.mask
            self.slot_key[h], self.slot_piece[h] = key, i
        self.rank_of = np.full(size, np.iinfo(np.int32).max, np.int32)
        for i, r in self.rank.items():
            self.rank_of[i] = r

    def _hash(self, key):
        if isinstance(key, np.ndarray):
            return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(30)).astype(np.int64) & self.mask
        return ((key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 30) & self.mask

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank that each pair of symbols merges to; the largest rank if none."""
        key = left.astype(np.int64) << 32 | right
        out = np.full(len(key), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        h = self._hash(key[todo])
        while todo.size:
            at = self.slot_key[h]
            hit = at == key[todo]
            out[todo[hit]] = self.slot_piece[h[hit]]
            go = ~hit & (at >= 0)
            todo, h = todo[go], h[go] + 1 & self.mask
        return out, np.where(out >= 0, self.rank_of[out], np.iinfo(np.int32).max)

    def spell(self, symbols: Sequence[str]) -> bytes:
        """Ids of final symbols as little-endian 32-bit integers."""
        ids: list[int] = []
        for s in symbols:
            if (i := self.id.get(s)) is not None:
                ids.append(i)
            else:
                ids += [self.byte_id[b] for b in s.encode()]
        return struct.pack(f"<{len(ids)}I", *ids)

    def agenda(self, segment: str) -> bytes:
        """Encodes one segment: the agenda holds adjacent pairs by score, then by place; a popped pair is
        merged unless a symbol of it has changed, and the pairs it makes join the agenda."""
        sym = [self.symbol.get(c, -1) for c in segment]
        text, n = list(segment), len(segment)
        before, after, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n and (p := self.merge.get((sym[i], sym[j]))) is not None:
                heapq.heappush(heap, (self.rank[p], i, j, p, sym[i], sym[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, j, p, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or after[i] != j or not text[i] or not text[j]:
                continue
            sym[i], text[i] = p, text[i] + text[j]
            sym[j], text[j] = -2, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return self.spell([x for x in text if x])

    def agendas(self, segments: list[str]) -> list[bytes]:
        """The same for many segments: each step pops the best pair of every open segment at once."""
        out: list[bytes] = [b""] * len(segments)
        groups: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            if len(s) > ARRAY_CHARS:
                out[k] = self.agenda(s)
            else:
                groups.setdefault(4 * -(-len(s) // 4), []).append(k)
        for width, rows in groups.items():
            for lo in range(0, len(rows), 1 << 15):
                part = rows[lo : lo + (1 << 15)]
                for k, ids in zip(part, self._arrays([segments[k] for k in part], width)):
                    out[k] = ids
        return out

    def _arrays(self, segments: list[str], width: int) -> list[bytes]:
        n = len(segments)
        points = np.frombuffer("".join(s.ljust(width, "\0") for s in segments).encode("utf-32-le"), np.uint32).reshape(n, width)
        chars, back = np.unique(points, return_inverse=True)
        of = np.array([self.symbol.get(chr(c), -1) for c in chars], np.int32)
        sym = of[back.reshape(n, width)]
        # a character unknown to the vocabulary keeps its code point, below -1
        sym = np.where(sym < 0, -2 - points.astype(np.int64), sym).astype(np.int32)
        size = np.array([len(s) for s in segments], np.int32)
        sym[np.arange(width)[None, :] >= size[:, None]] = -1
        final = np.full_like(sym, -1)
        piece, rank = (x.reshape(n, width - 1) for x in self.merged(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        open_, none = np.arange(n), np.iinfo(np.int32).max
        while True:
            best = rank.argmin(axis=1)  # the first of equal ranks
            go = rank[np.arange(len(open_)), best] < none
            if not go.all():
                final[open_[~go], : sym.shape[1]] = sym[~go]
                open_, sym, piece, rank, best = open_[go], sym[go], piece[go], rank[go], best[go]
            m, w = sym.shape
            if not m:
                break
            at = np.arange(m)
            sym[at, best] = piece[at, best]
            keep = np.ones((m, w), bool)
            keep[at, best + 1] = False
            sym = sym[keep].reshape(m, w - 1)
            if w == 2:
                final[open_, :1] = sym
                break
            keep = np.ones((m, w - 1), bool)
            keep[at, best] = False
            piece, rank = piece[keep].reshape(m, w - 2), rank[keep].reshape(m, w - 2)
            for i in (best - 1, best):  # the pairs on both sides of the new symbol
                ok = np.flatnonzero((i >= 0) & (i < w - 2))
                piece[ok, i[ok]], rank[ok, i[ok]] = self.merged(sym[ok, i[ok]], sym[ok, i[ok] + 1])
        used = final != -1
        odd = (used & ((final < 0) | (final >= len(self.pieces)))).any(axis=1)  # a symbol in it is no piece
        ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
        blob = final[used].astype("<u4").tobytes()
        out = [blob[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.spell([chr(-2 - x) if x < -1 else self.text[x] for x in final[k].tolist() if x != -1])
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Codec:
    """Encodes and decodes texts of one task. Segments (a space sign and what follows up to the next) are
    encoded once and remembered; check compares each newly encoded segment with the sentencepiece
    library, batch by batch, and stops at a difference."""

    def __init__(self, path: str, check: bool = True, remembered: int = REMEMBERED):
        self.v, self.remembered = vocabulary(path), remembered
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def segments(self, text: str) -> list[str]:
        """The text's segments without their leading space sign."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in text:
            return re.findall(f"{SPACE}({SPACE}*[^{SPACE}]*)", text)
        return text.split(SPACE)[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end ids, as little-endian unsigned 32-bit integers."""
        cut = [self.segments(t) for t in texts]
        new, old = self.new, self.old
        if self.held > self.remembered:
            self.old, self.new = old, new = new, {}
            self.held = 0
        added = set().union(*cut).difference(new)
        again = added & old.keys()
        new.update(zip(again, map(old.__getitem__, again)))
        missing = list(added - again)
        found = self.v.agendas([SPACE + s for s in missing])
        if self.library and missing:
            # the library puts the space sign before each itself, but for an empty text
            own = [(s, x) for s, x in zip(missing, found) if s]
            for (s, x), ids in zip(own, self.library.encode([s.replace(SPACE, " ") for s, _ in own], num_threads=1)):
                if x != struct.pack(f"<{len(ids)}I", *ids):
                    raise ValueError(f"the sentencepiece library encodes {s!r} otherwise")
        new.update(zip(missing, found))
        self.held += sum(map(len, added)) + sum(map(len, map(new.__getitem__, added))) + ENTRY * len(added)
        get, b, e = new.__getitem__, struct.pack("<I", self.v.bos), struct.pack("<I", self.v.eos)
        return [b"".join([b, *map(get, segs), e]) for segs in cut]

    def decode(self, ids: bytes | Sequence[int]) -> str:
        """Text of ids: pieces are joined, space signs become spaces and the first one goes; runs of byte
        pieces are read as UTF-8, with U+FFFD for each byte that isn't."""
        ids = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else list(ids)
        raw = b"".join(map(self.v.written.__getitem__, ids))
        first = next((i for i in ids if i not in (self.v.bos, self.v.eos)), None)
        if first is not None and self.v.pieces[first].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="surrogateescape").translate(dict.fromkeys(range(0xDC80, 0xDD00), "\ufffd"))


def encode_documents(docs: DataFrame, path: str | None = None, check: bool = True, keep: str = "digests", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text and decodes the ids again: doc_id, n_tokens (with begin and end ids),
    then with keep="digests" ids_sha256 and decoded_sha256, with keep="ids" ids (array) and decoded. With check the library decodes
    the ids of every batch too, and a difference stops the job.

    Null and empty texts have the two ids only. Each row of docs gives one row, repeats too, an empty table none; other
    columns aren't read. A very long text is a slice of its own."""
    path = path or public_tokenizers.path(MODEL)

    def start():
        return Codec(path, check)

    def run(ids, texts, codec):
        coded = codec.encode([x.decode() for x in as_bytes(texts)])
        out = {"doc_id": ids, "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64())}
        text = [codec.decode(x) for x in coded]
        if codec.library and codec.library.decode([np.frombuffer(x, "<i4").tolist() for x in coded]) != text:
            raise ValueError("the sentencepiece library decodes otherwise")
        if keep == "ids":
            return out | {"ids": pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32())), "decoded": pa.array(text, pa.string())}
        return out | {"ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text], pa.string())}

    kept = "ids array<int>, decoded string" if keep == "ids" else "ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, run, f"doc_id long, n_tokens long, {kept}", start, id_col, text_col)
