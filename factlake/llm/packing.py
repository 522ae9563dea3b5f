"""Packing of token sequences as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, map_texts, materialize

TOKENIZER, SEQUENCE, END_ID = "word_bpe_49k.json", 2048, 1
#: Tokens in a step of the length histogram that the program is solved on: lengths count as the next multiple.
GRAIN = 16
#: The program ends when its value is this near to the bound that its prices prove.
GAP = 0.0005
#: Bytes of chunks, and of words, remembered for reuse in a task: two generations of so many. An entry counts as ENTRY bytes more.
REMEMBERED, ENTRY = 64 << 20, 160
#: How the vocabulary cuts a chunk before its merges.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks below this character are in composed form, and Python lower-cases them as the library does.
PLAIN = "\u0250"
#: Byte-level spelling: printable bytes stand for themselves, the others for the code points from 256 on.
SPELLING = {}
for _b in range(256):
    SPELLING[_b] = _b if 33 <= _b <= 126 or 161 <= _b <= 172 or 174 <= _b <= 255 else 256 + sum(x > 255 for x in SPELLING.values())
#: Pieces ranked together; only the number of buckets grows with the table.
BUCKET_ROWS = 20_000


class Chunks:
    """Token ids of texts by way of their chunks between ASCII white space: the vocabulary drops white space
    and no token spans it, so each chunk is encoded by the tokenizers library once and remembered. A chunk of Latin letters goes
    straight to the library's merges; any other goes through all its steps."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = self.held_words = 0
        self.merge = self.tokenizer.model.tokenize

    def word(self, word: str) -> bytes:
        """Ids of one word of a chunk: the library's merges without the steps that a plain chunk doesn't need."""
        ids = self.words.get(word)
        if ids is None:
            spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(SPELLING)
            own = [t.id for t in self.merge(spelt)]
            if self.held_words >= self.remembered:
                self.words.clear()
                self.held_words = 0
            ids = self.words[word] = struct.pack(f"<{len(own)}I", *own)
            self.held_words += len(word) + len(ids) + ENTRY
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [x.split() for x in texts]
        new, old = self.new, self.old
        if self.held > self.remembered:
            self.old, self.new = old, new = new, {}
            self.held = 0
        missing = added = set().union(*cut).difference(new)
        if again := missing & old.keys():
            new.update(zip(again, map(old.__getitem__, again)))
            missing = missing - again
        if missing:
            odd = []
            for x in missing:
                text = x.decode()
                if b"<|" in x or max(text) >= PLAIN:
                    odd.append(x)
                else:
                    new[x] = b"".join(map(self.word, WORD.findall(text.lower())))
            coded = self.tokenizer.encode_batch_fast([x.decode() for x in odd], add_special_tokens=False)
            new.update((x, struct.pack(f"<{len(i)}I", *i)) for x, i in zip(odd, (c.ids for c in coded)))
        get = new.__getitem__
        self.held += sum(map(len, added)) + sum(map(len, map(get, added))) + ENTRY * len(added)
        return [b"".join(map(get, chunks)) for chunks in cut]


def token_pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, appends end_id and cuts every `sequence` tokens: doc_id, start, length,
    ids_crc32, doc_tokens."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(ids, texts, chunks):
        row, start, length, crc, total = [], [], [], [], []
        for k, coded in enumerate(chunks.encode(as_bytes(texts))):
            coded += struct.pack("<I", end_id)
            n = len(coded) // 4
            for lo in range(0, n, sequence):
                part = coded[4 * lo : 4 * (lo + sequence)]
                row.append(k)
                start.append(lo)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
        return {"doc_id": ids.take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64())}

    return map_texts(docs, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", lambda: Chunks(path), id_col, text_col)


def best_column(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of item sizes 1..capacity (prices[size - 1]) of
    the highest total price that fits the capacity."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        with_item = prices[:room] + best[room - 1 :: -1][:room]
        k = int(with_item.argmax())
        best[room], last[room] = (with_item[k], k + 1) if with_item[k] > best[room - 1] + 1e-12 else (best[room - 1], 0)
    column, room = np.zeros(capacity, np.int64), capacity
    while room > 0:
        if last[room]:
            column[last[room] - 1] += 1
        room -= last[room] or 1
    return float(best[capacity]), column


def patterns(demand: np.ndarray, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that size s (1..len(demand)) is used demand[s - 1] times and no
    pattern's sizes add up to more than len(demand).

    A linear program over patterns is solved by the simplex method with columns from best_column until within
    `gap` of its bound, then rounded down; what rounding leaves, fewer items than a pattern for each size
    holds, is packed first-fit decreasing."""
    capacity = len(demand)
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    sizes, need = rows + 1, demand[rows].astype(float)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    while True:
        use = inverse @ need
        price = inverse.sum(axis=0)  # every pattern costs one sequence
        full = np.zeros(capacity)
        full[rows] = price.clip(0)
        value, column = best_column(full, capacity)
        if value <= 1 + 1e-9 or use.sum() * (1 - 1 / value) <= gap * use.sum():
            break
        enter = column[rows].astype(float)
        move = inverse @ enter
        up = np.flatnonzero(move > 1e-9)
        out = up[(use[up].clip(0) / move[up]).argmin()]
        basis[:, out] = enter
        inverse[out] /= move[out]
        move[out] = 0
        inverse -= np.outer(move, inverse[out])
    count = np.floor(np.linalg.solve(basis, need) + 1e-6).clip(0).astype(np.int64)
    left = demand[rows] - (basis.astype(np.int64) @ count)
    while (left < 0).any():  # a rounding error took one too many
        k = int(np.flatnonzero(basis[int(left.argmin())] * (count > 0))[0])
        count[k] -= 1
        left += basis[:, k].astype(np.int64)
    out: list[tuple[np.ndarray, int]] = []
    for k in np.flatnonzero(count):
        pattern = np.zeros(capacity, np.int64)
        pattern[rows] = basis[:, k].astype(np.int64)
        out.append((pattern, int(count[k])))
    room: list[int] = []
    made: list[np.ndarray] = []
    for s, n in zip(sizes[::-1].tolist(), left[::-1].tolist()):
        for _ in range(n):
            k = min((k for k in range(len(room)) if room[k] >= s), key=room.__getitem__, default=None)
            if k is None:
                k = len(room)
                room.append(capacity)
                made.append(np.zeros(capacity, np.int64))
            made[k][s - 1] += 1
            room[k] -= s
    return out + [(m, 1) for m in made]


def slots(found: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size: where the ranks of each pattern that holds it begin, how many it holds, its first sequence
    and the first of its places there for that size."""
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, n in found:
        place = 0
        for s in np.flatnonzero(pattern)[::-1]:
            own = by.setdefault(int(s) + 1, [])
            begin = own[-1][4] if own else 0
            own.append((begin, int(pattern[s]), sequence, place, begin + n * int(pattern[s])))
            place += int(pattern[s])
        sequence += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*own)) for s, own in by.items()}


def pack(pieces: DataFrame, sequence: int = SEQUENCE, grain: int = GRAIN, gap: float = GAP) -> DataFrame:
    """Adds sequence_id and offset to pieces of (doc_id, start, length, ...), length 1 to `sequence`.

    Only the histogram of lengths, at most sequence / grain rows, comes to the driver. Pieces are ranked
    within their length by buckets of a hash, so that a common length is ranked by many tasks; each rank has its
    place in a pattern. Buckets take a number that each row gets when it is written, so rows that are equal in all columns are
    dealt out too; such rows may swap places. An empty table gives no rows."""
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "packing-pieces").withColumn("__size", F.ceil(F.col("length") / F.lit(grain)).cast("int"))
    histogram = pieces.groupBy("__size").count().collect()
    demand = np.zeros(-(-sequence // grain), np.int64)
    for size, n in histogram:
        demand[size - 1] = n
    table = slots(patterns(demand, gap))
    buckets = int(demand.sum()) // BUCKET_ROWS + 256
    pieces = pieces.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("__size", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("__size", "__bucket").orderBy("__row")
    ranked = pieces.withColumn("__rank", F.row_number().over(within) - 1).join(counts, ["__size", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__before", "__bucket", "__row")

    def place(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            size, rank = batch.column("__size").to_numpy(), batch.column("__rank").to_numpy()
            seq, at = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                begin, held, first, spot, _ = table[int(s)]
                own = np.flatnonzero(size == s)
                k = np.searchsorted(begin, rank[own], "right") - 1
                seq[own] = first[k] + (rank[own] - begin[k]) // held[k]
                at[own] = spot[k] + (rank[own] - begin[k]) % held[k]
            kept = [c for c in batch.schema.names if c not in ("__size", "__rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(seq), pa.array(at)], names=[*kept, "sequence_id", "__place"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name not in ("__size", "__rank"))
    placed = ranked.mapInArrow(place, f"{kept}, sequence_id long, __place long")
    inside = Window.partitionBy("sequence_id").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("__place")


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most `sequence` tokens, a row for each piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the end id only. A text longer than a sequence, however long, is cut at its multiples and only
    its rest shares a sequence. An empty table gives no rows; repeated rows are packed each; other columns aren't read."""
    return pack(token_pieces(docs, path, sequence, id_col=id_col, text_col=text_col), sequence)
