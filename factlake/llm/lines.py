"""Line deduplication with a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RUN_ROWS, as_bytes, bit_filter, bits_of, components, discard, lean, materialize, np_components, run_pairs, salted_runs, slices, whole_runs

#: Edits within which two lines are one, and code points from which a line takes part in that; shorter ones are one if equal.
EDITS, MIN_CHARS = 2, 20
#: Bits of the filter that keeps lines without candidates out of the shuffle of texts; its size doesn't grow.
FILTER_BITS = 1 << 26
#: Text bytes whose lines are signed at once: their arrays of characters take 60 times as much.
LINE_BYTES = 1 << 20
#: Pairs verified together, and characters of their grid; lines over LONG_CHARS are verified pair by pair.
VERIFY_PAIRS, VERIFY_CELLS, LONG_CHARS = 2048, 1 << 19, 4096
#: Characters that are signed at once.
SIGN_CHARS = 1 << 18
#: Lines that a task remembers so as not to send copies twice.
REMEMBERED = 1 << 18


def document_lines(text: str, min_chars: int = MIN_CHARS) -> list[tuple[int, str]]:
    """(number, stripped line) of the lines that take part."""
    return [(k, x) for k, line in enumerate(text.split("\n")) if len(line) >= min_chars and len(x := line.strip()) >= min_chars]


def line_hash(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line)


def text_hash(text: bytes) -> int:
    """The number that xxhash64 of Spark gives for a text."""
    return np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64).item()


@lru_cache(1 << 14)
def segments(n: int, edits: int) -> tuple[tuple[int, int], ...]:
    """(start, end) of the edits + 1 even segments of a line of n code points; the last ones are longer by one."""
    q, r = divmod(n, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        out.append((at, at := at + q + (i > edits - r)))
    return tuple(out)


@lru_cache(1 << 14)
def substrings(n: int, edits: int) -> tuple[tuple[int, int, int, bool], ...]:
    """What a line of n code points is looked up by: (start, end, seed, probe). First its own segments, as indexed; then the
    substrings that can equal segment i of a line of length n - d, d up to edits, if the two are within `edits`: by the
    multi-match-aware bounds on the shift from the left and from the right."""
    out = [(a, b, n << 8 | i, False) for i, (a, b) in enumerate(segments(n, edits))]
    for d in range(edits + 1):
        for i, (a, b) in enumerate(segments(n - d, edits)):
            lo, hi = max(a - i, a + d - (edits - i), 0), min(a + i, a + d + (edits - i), n - (b - a))
            out += [(p, p + b - a, n - d << 8 | i, True) for p in range(lo, hi + 1) if d or p != a]
    return tuple(out)


@lru_cache(1 << 12)
def _places(n: int, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The columns of substrings."""
    start, end, seed, probe = zip(*substrings(n, edits))
    return np.array(start), np.array(end), np.array(seed, np.uint64), np.array(probe, bool)


def _parities(lines: list[str]) -> np.ndarray:
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.cumsum(size) - size
    chars = np.uint64(1) << ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(59))
    pair = (points[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[1:]) * np.uint64(0x9E3779B97F4A7C15)
    pairs = np.uint64(2) << ((pair >> np.uint64(33)) % np.uint64(31))
    pairs = np.append(pairs, np.uint64(0))
    pairs[begin[1:] - 1] = 0  # no pair over two lines
    return np.bitwise_xor.reduceat(chars << np.uint64(32) | pairs, begin) if len(lines) else np.zeros(0, np.uint64)


def signatures(lines: list[str]) -> np.ndarray:
    """64 bits of each line: parities of its characters (32) and of its pairs of neighbours (31), the lowest bit free. A very long
    line is signed in parts that overlap by a character, whose own parity is taken out again."""
    out, lo, n = np.zeros(len(lines), np.uint64), 0, 0
    for k, line in enumerate([*lines, None]):
        if line is None or n + len(line) > SIGN_CHARS:
            out[lo:k] = _parities(lines[lo:k])
            lo, n = k, 0
        if line is not None and len(line) > SIGN_CHARS:
            parts = [line[at : at + SIGN_CHARS + 1] for at in range(0, len(line), SIGN_CHARS)]
            both = [*(_parities([x])[0] for x in parts), *(_parities([x[-1]])[0] for x in parts if len(x) > SIGN_CHARS)]
            out[k] = np.bitwise_xor.reduce(np.array(both, np.uint64))
            lo = k + 1
        elif line is not None:
            n += len(line)
    return out


def may_match(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """An edit changes at most 2 parities of characters and 4 of pairs."""
    x = a ^ b
    return (np.bitwise_count(x >> np.uint64(32)) <= 2 * edits) & (np.bitwise_count(x & np.uint64(0xFFFFFFFE)) <= 4 * edits)


def within(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Whether each left line is within `edits` insertions, deletions or substitutions of the right one.

    Pairs are sorted by length and verified in grids of VERIFY_CELLS characters at most, so one long line doesn't widen the
    others. A line over LONG_CHARS would need a step of Python for each character: its pairs are verified one by one by
    furthest-reaching diagonals, which walk equal stretches at once."""
    out = np.zeros(len(left), bool)
    size = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right)), np.int64, len(left))
    order = np.argsort(size, kind="stable")
    short = int(np.searchsorted(size[order], LONG_CHARS, "right"))
    lo = 0
    while lo < short:
        hi = lo + 1
        while hi < short and (hi + 1 - lo) * (size[order[hi]] + 4 * edits + 2) <= VERIFY_CELLS:
            hi += 1
        part = order[lo:hi]
        out[part] = _banded([left[k] for k in part], [right[k] for k in part], edits)
        lo = hi
    for k in order[short:].tolist():
        out[k] = _diagonals(left[k], right[k], edits)
    return out


def _banded(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Columns of a band of 2 * edits + 1 diagonals as bits, all pairs at once. Places outside a line hold code points that no text has."""
    a, b = zip(*((x, y) if len(x) >= len(y) else (y, x) for x, y in zip(left, right)))
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = 2 * edits + 1
    top, mask = width - 1, (1 << width) - 1
    wide = int(n.max()) + 2 * width

    def grid(lines, size, pad, fill):
        x = np.full((wide, len(lines)), fill, np.uint32)  # a row for each place
        points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        x[np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size) + pad, np.repeat(np.arange(len(lines)), size)] = points
        return x

    s1, s2 = grid(a, n, edits, 0x110000), grid(b, m, 0, 0x110001)
    vp = np.full(len(a), (mask << edits) & mask, np.int64)
    vn = np.zeros(len(a), np.int64)
    score = np.full(len(a), edits, np.int64)
    for i in range(int(m.max())):
        x = np.zeros(len(a), np.int64)
        for k in range(width):
            x |= (s1[i + k] == s2[i]).astype(np.int64) << k
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        slope = i < n - edits  # down the lowest diagonal first, then along the last row
        bit = np.where(slope, 0, top - 1 - (i - (n - edits))).clip(0)
        score += np.where(i >= m, 0, np.where(slope, 1 - (d0 >> top), (hp >> bit & 1) - (hn >> bit & 1)))
        d0 >>= 1
        vp = (hn | ~(d0 | hp)) & mask
        vn = d0 & hp
    return (score <= edits) & (n - m <= edits)


def _diagonals(a: str, b: str, edits: int) -> bool:
    """The same for one pair: how far each diagonal gets with 0, 1, ... edits."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    n, m = len(x), len(y)

    def along(i: int, d: int) -> int:
        step = 64
        while (k := min(step, n - i, m - i - d)) > 0:
            off = x[i : i + k] != y[i + d : i + d + k]
            if off.any():
                return i + int(off.argmax())
            i, step = i + k, 4 * step
        return i

    far = {0: along(0, 0)}
    for _ in range(edits):
        if far.get(m - n) == n:
            return True
        new = {}
        for d in range(min(far) - 1, max(far) + 2):
            steps = [far[d] + 1] if d in far else []
            steps += [far[d - 1]] if d - 1 in far else []
            steps += [far[d + 1] + 1] if d + 1 in far else []
            i = min(max(steps), n, m - d)
            if i >= 0 and i + d >= 0:
                new[d] = along(i, d)
        far = new
    return far.get(m - n) == n


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, line_no, line) with the line as a 128-bit hash. A document is its id and text: rows that repeat
    both are one."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for rows, texts in slices(pa.array(np.arange(batch.num_rows)), batch.column(2)):
                row, no, line = [], [], []
                for k, raw in zip(rows.to_pylist(), as_bytes(texts)):
                    own = document_lines(raw.decode(), min_chars)
                    row += [k] * len(own)
                    no += [i for i, _ in own]
                    line += [line_hash(x) for _, x in own]
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(no, pa.int32()), pa.array(line, pa.binary())], names=["doc_id", "text_hash", "line_no", "line"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, text_hash long, line_no int, line binary")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash")


def _fresh(texts: pa.Array, seen: set[bytes], min_chars: int) -> tuple[list[str], list[int]]:
    """Lines not yet sent by this task, and their short hashes: the first half of line_hash. A pair whose short hashes are equal
    though its lines differ isn't compared; that takes a collision of 64 bits between two lines that are near copies."""
    lines, short = [], []
    for raw in as_bytes(texts):
        for _, x in document_lines(raw.decode(), min_chars):
            h = line_hash(x)
            if h not in seen:
                seen.add(h)
                lines.append(x)
                short.append(int.from_bytes(h[:8], "big", signed=True))
    if len(seen) > REMEMBERED:
        seen.clear()
    return lines, short


_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: Characters from which the substrings of a line of that length are hashed one by one.
HASHED_CHARS = 1 << 14


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    base = np.full(n, _ODD, np.uint64)
    back = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


def _keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all substrings of the lines: key, number of the line, and whether it is a probe.

    A substring's hash is a difference of prefix sums of a polynomial modulo 2**64, for all substrings at once. Where the
    line looked up is longer than HASHED_CHARS they are hashed one by one. Keys only nominate pairs, so a collision costs a comparison."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(size, kind="stable")
    short = order[: int(np.searchsorted(size[order], HASHED_CHARS + edits, "right"))]
    at = 0
    while at < len(short):  # some LINE_BYTES characters at once
        end = at + max(1, int(np.searchsorted(np.cumsum(size[short[at:]]), LINE_BYTES, "right")))
        part = short[at:end]
        at = end
        points = np.frombuffer("".join([lines[k] for k in part.tolist()]).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        power, back = _powers(LINE_BYTES + HASHED_CHARS + 64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * power[: len(points)], dtype=np.uint64)])
        own = size[part]
        places = [_places(n, edits) for n in own.tolist()]
        count = np.array([len(x[0]) for x in places])
        start, stop, seed, probe = (np.concatenate(x) for x in zip(*places))
        begin = np.repeat(np.cumsum(own) - own, count)
        begin, stop = begin + start, begin + stop
        key = (total[stop] - total[begin]) * back[begin] + seed * _MIX
        key ^= key >> np.uint64(32)
        key *= _MIX
        key ^= key >> np.uint64(29)
        number = np.repeat(part, count)
        for j in np.flatnonzero(seed > HASHED_CHARS << 8 | 255).tolist():
            x, lo = lines[number[j]], int(start[j])
            key[j] = xxhash.xxh64_intdigest(x[lo : lo + int(stop[j] - begin[j])], int(seed[j]))
        out.append((key.view(np.int64), number, probe))
    for k in order[len(short) :].tolist():
        own = [(xxhash.xxh64_intdigest(lines[k][a:b], seed), p) for a, b, seed, p in substrings(len(lines[k]), edits)]
        out.append((np.array([h for h, _ in own], np.uint64).view(np.int64), np.full(len(own), k), np.array([p for _, p in own], bool)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _mapped(docs: DataFrame, run, schema: str, text_col: str) -> DataFrame:
    def over(batches: Iterable[pa.RecordBatch]):
        seen: set[bytes] = set()
        for batch in batches:
            for _, texts in slices(batch.column(0), batch.column(0), LINE_BYTES):
                yield from run(texts, seen)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(over), schema)


def line_links(docs: DataFrame, n_lines: int, edits: int = EDITS, min_chars: int = MIN_CHARS, text_col: str = "text") -> DataFrame:
    """Edges (a, b) between hashes of different lines that are joined by lines within `edits`, fewer than all pairs; written once.

    First only keys, short hashes and signatures meet: lines with a partner that the signature allows are marked. Then the
    texts of marked lines, found again with the help of a fixed-size bitmap, meet by the same keys and are
    verified. A run's verified lines point at one of them, so a group gives as many edges as lines."""
    spark = docs.sparkSession
    buckets = 1 << max(16, (16 * 12 * n_lines // RUN_ROWS).bit_length())

    def keyed(texts, seen):
        lines, short = _fresh(texts, seen, min_chars)
        key, number, probe = _keys(lines, edits)
        sig = signatures(lines)[number] & ~np.uint64(1) | probe.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(short, np.int64)[number]), pa.array(sig.view(np.int64))], names=["key", "short", "sig"])

    def counted(texts, seen):
        lines, _ = _fresh(texts, seen, min_chars)
        got, n = np.unique(_keys(lines, edits)[0] & (buckets - 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    counts = _mapped(docs, counted, "bucket long, n long", text_col).groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > RUN_ROWS)
    rows = _mapped(docs, keyed, "key long, short long, sig long", text_col)
    hot = materialize(counts, "lines-hot")
    dealt = salted_runs(rows, "short", "lines", hot=hot, buckets=buckets).select("run", "key", "short", "sig")

    def mark(batches):
        for table in whole_runs(batches):
            run, key, short, sig = (table.column(c).to_numpy() for c in ("run", "key", "short", "sig"))
            sig = sig.view(np.uint64)
            hit = np.zeros(len(run), bool)
            both = (run ^ (key * np.int64(-7046029254386353131))).view(np.int64)  # one number for the pair; adjacent rows only
            for i, j in run_pairs(both):
                ok = (short[i] != short[j]) & (sig[i] & sig[j] & np.uint64(1) == 0)
                i, j = i[ok], j[ok]
                ok = may_match(sig[i], sig[j], edits)
                hit[i[ok]] = hit[j[ok]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (key, short, sig.view(np.int64))], names=["key", "short", "sig"])

    marked = materialize(dealt.mapInArrow(lean(mark), "key long, short long, sig long"), "lines-marked")
    discard(hot)
    held = spark.sparkContext.broadcast(bit_filter(marked.select(F.col("short").alias("hash")), FILTER_BITS))

    def wanted(texts, seen):
        lines, short = _fresh(texts, seen, min_chars)
        ok = np.flatnonzero(bits_of(held.value, np.array(short, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([short[k] for k in ok], pa.int64()), pa.array([lines[k] for k in ok], pa.string())], names=["short", "line"])

    texts = _mapped(docs, wanted, "short long, line string", text_col)
    found, made = materialize(marked.distinct().join(texts, "short"), "lines-texts"), []
    discard(marked)
    again = salted_runs(found, "short", "lines2", made=made).select("run", "key", "sig", "line")

    def verify(batches):
        for table in whole_runs(batches, 1 << 15):
            run, key, sig = (table.column(c).to_numpy() for c in ("run", "key", "sig"))
            sig, lines = sig.view(np.uint64), table.column("line").to_pylist()
            size = np.array([len(x) for x in lines])
            both = run ^ (key * np.int64(-7046029254386353131))
            lab = np.arange(len(lines))
            at, to = [], []

            def flush():
                nonlocal lab, at, to
                i, j = np.concatenate(at), np.concatenate(to)
                open_ = lab[i] != lab[j]
                i, j = i[open_], j[open_]
                for lo in range(0, len(i), VERIFY_PAIRS):
                    p, q = i[lo : lo + VERIFY_PAIRS], j[lo : lo + VERIFY_PAIRS]
                    open_ = lab[p] != lab[q]
                    p, q = p[open_], q[open_]
                    good = within([lines[k] for k in p], [lines[k] for k in q], edits)
                    if good.any():
                        own = np.arange(len(lab))
                        lab = np_components(len(lab), np.concatenate([own, p[good]]), np.concatenate([lab, q[good]]))
                at, to = [], []

            for i, j in run_pairs(both):
                ok = (abs(size[i] - size[j]) <= edits) & (sig[i] & sig[j] & np.uint64(1) == 0) & may_match(sig[i], sig[j], edits) & (lab[i] != lab[j])
                at.append(i[ok])
                to.append(j[ok])
                if sum(map(len, at)) >= 4 * VERIFY_PAIRS:
                    flush()
            if at:
                flush()
            child = [k for k in np.flatnonzero(lab != np.arange(len(lab))).tolist() if lines[k] != lines[lab[k]]]
            yield pa.RecordBatch.from_arrays([pa.array([line_hash(lines[k]) for k in child], pa.binary()), pa.array([line_hash(lines[lab[k]]) for k in child], pa.binary())], names=["a", "b"])

    edges = materialize(again.mapInArrow(lean(verify), "a binary, b binary"), "lines-edges")
    discard(found, *made)
    return edges


def dropped_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """(doc_id, text_hash, lines, n_near, first_docs): of each document that loses lines their numbers, how many of them differ from
    the line that stays, and in which documents (ids, ascending, null left out) those that stay are.

    Lines that are equal once stripped, or joined by a chain of lines within `edits`, are one class; its first line by
    doc_id, text hash and number stays (null ids come first). With short, lines under min_chars take part too, but only
    with lines that are equal; empty ones don't. Null texts have no lines, and an empty table gives no rows. The rows are written, and
    all that was written on the way is deleted."""
    occ = materialize(occurrences(docs, 1 if short else min_chars, id_col, text_col), "lines-all")
    distinct = materialize(occ.groupBy("line").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("first"), F.count("*").alias("n")), "lines-distinct")
    edges = line_links(docs, distinct.count(), edits, min_chars, text_col)
    found = components(edges, "lines")
    discard(edges)
    joined = distinct.join(found, distinct.line == found.node, "left").select("line", "first", "n", F.coalesce("root", "line").alias("root"), F.col("root").isNotNull().alias("near"))
    joined = materialize(joined.where("near or n > 1"), "lines-rooted")
    discard(distinct, found)
    stays = materialize(joined.groupBy("root").agg(F.min(F.struct("first", "line")).alias("stays")), "lines-stays")
    named = joined.select("line", "root").join(stays, "root").select("line", F.col("stays.first").alias("stays"), (F.col("line") != F.col("stays.line")).alias("near"))
    named = materialize(named, "lines-named")
    discard(joined, stays)
    lost = occ.join(named, "line").where(~F.struct("doc_id", "text_hash", "line_no").eqNullSafe(F.col("stays")))
    out = lost.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("lines"), F.count_if("near").alias("n_near"), F.array_sort(F.collect_set("stays.doc_id")).alias("first_docs"))
    out = materialize(out, "lines-lost")
    discard(occ, named)
    return out


def drop_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """docs with the lines of text_col that repeat an earlier one, exactly or within `edits`, taken out, and columns
    __dropped (how many), __near (how many of them differ from the line that stays) and __first (ids of the documents of those that
    stay). Other columns stay, whatever their names; only columns of these three names are replaced.

    Lines shorter than min_chars stay, or with short, those that repeat an earlier one exactly go. Null and empty texts stay as
    they are, an empty table stays empty; rows that repeat id and text are one document and lose the same lines. A line of a
    third of all documents costs one row for each. Texts are cut whole, in time in proportion to their lines."""
    lost = dropped_lines(docs, edits, min_chars, id_col, text_col, short)
    # the rows of docs are one column, so that no name of theirs can clash
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(id_col).cast("long").alias("own_id"), _text_hash(text_col).alias("own_hash"))
    # what is lost follows the documents and has no bound: never broadcast
    out = rows.join(lost.hint("merge"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    text = F.col("row")[text_col]

    def kept(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lines"))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    # split once: what a lambda takes from outside is computed for each element otherwise
    cut = F.element_at(F.transform(F.array(F.split(text, "\n")), kept), 1)
    text = F.when(F.col("lines").isNull(), text).otherwise(cut).alias(text_col)
    own = [text if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("__dropped", "__near", "__first")]
    return out.select(*own, F.coalesce(F.size("lines"), F.lit(0)).alias("__dropped"), F.coalesce("n_near", F.lit(0)).cast("long").alias("__near"), F.coalesce("first_docs", F.array().cast("array<long>")).alias("__first"))


def line_dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, n_near (dropped lines that differ from the one that stays), first_docs
    (ids of the documents whose lines stay in their place) and kept_sha256 (of the text that is left; null counts as empty).

    Null ids come before all others where lines tie. A very long text is cut into lines whole. Repeated rows give repeated rows, an
    empty table none; other columns aren't read."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    kept = drop_lines(own.withColumn("__n", n), edits, min_chars, short=short)
    return kept.select("doc_id", F.col("__n").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"), F.col("__near").alias("n_near"), F.col("__first").alias("first_docs"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
