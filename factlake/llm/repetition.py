"""Quality rules with suffix-array repetition over the words of each text."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, flat, map_texts

#: Base limits: words a text needs, and percent of its words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: The method's limits: words from which a repeated substring counts, percent of words that such
#: substrings may cover, and words in the longest one. Repeats of 10 words may make up 10 % as in the rules of Gopher
#: (Rae et al. 2021), and 50 is the length from which Lee et al. (2022) take out repeated substrings, a passage.
MIN_SUBSTRING, MAX_COVERED_PERCENT, MAX_LONGEST = 10, 10, 50

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_WORD_CHAR = np.ones(256, np.uint8)  # first bytes of characters that aren't white space
_WORD_CHAR[list(b" \t\n\r\x0b\x0c")] = 0
_WORD_CHAR[0x80:0xC0] = 0


def suffix_ranks(word: np.ndarray, doc: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Prefix doubling over all texts at once. word: ids; doc: text of each position, ascending; end: where that
    text ends. Level k ranks positions by their text and next 2**k words; equal ranks mean equal words,
    and the last level is the suffix array's inverse. Only positions not yet told apart are sorted again."""
    n = len(word)
    order = np.lexsort((word, doc))
    w, d = word[order], doc[order]
    first = np.ones(n, bool)
    first[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = start
    levels, step = [rank], 1
    last = np.append(first[1:], True)
    open_ = order[~(first & last)]
    while open_.size:
        old, ahead = rank[open_].astype(np.int64), open_ + step
        inside = ahead < end[open_]
        nxt = np.where(inside, rank[np.where(inside, ahead, 0)], -1)
        key = old * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        open_, old, key = open_[order], old[order], key[order]
        at = np.arange(len(open_))
        group = np.ones(len(open_), bool)
        group[1:] = old[1:] != old[:-1]
        base = np.maximum.accumulate(np.where(group, at, 0))
        first = np.ones(len(open_), bool)
        first[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[open_] = old + np.maximum.accumulate(np.where(first, at, 0)) - base
        levels.append(rank)
        last = np.append(first[1:], True)
        open_ = open_[~(first & last)]
        step *= 2
    return levels


def repeat_lengths(word: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words in the longest substring from each position that is found elsewhere in its text: the deeper of the
    two longest-common-prefix intervals that the position has in the suffix array."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64)
    levels = suffix_ranks(word, doc, end)
    array = np.empty(n, np.int64)
    array[levels[-1]] = np.arange(n)
    a, b = array[:-1], array[1:]
    some = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[some].copy(), b[some].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((a < n) & (b < n))
        ok = ok[levels[k][a[ok]] == levels[k][b[ok]]]
        a[ok] += 1 << k
        b[ok] += 1 << k
        common[ok] += 1 << k
    out = np.zeros(n, np.int64)
    np.maximum.at(out, array[some], common)
    np.maximum.at(out, array[some + 1], common)
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Positions in the union of the spans [i, i + length[i]) of at least `least`."""
    n = len(length)
    at = np.flatnonzero(length >= least)
    reach = np.zeros(n, np.int64)
    reach[at] = at + length[at]
    return np.maximum.accumulate(reach) > np.arange(n)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def rules(ids: pa.Array, texts: pa.Array) -> dict:
    raw = as_bytes(texts)
    split = [x.split() for x in raw]
    number: dict[bytes, int] = defaultdict(count().__next__)
    n_words = np.array([len(x) for x in split], np.int64)
    word = np.fromiter((number[w] for words in split for w in words), np.int32, int(n_words.sum()))
    edge = np.concatenate([[0], np.cumsum(n_words)])
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), n_words)
    length = repeat_lengths(word, doc, edge[1:][doc])
    # a span never passes its text's end, so the union over all texts is the union in each
    n_repeat = _sums(covered(np.where(length >= WINDOW, WINDOW, 0), WINDOW), edge)
    n_covered = _sums(covered(length, MIN_SUBSTRING), edge)
    longest = np.zeros(len(raw), np.int64)
    np.maximum.at(longest, doc, length)
    n_dup = []
    for x in raw:
        lines = x.split(b"\n")
        seen = set(lines)
        n_dup.append(0 if len(seen) == len(lines) else sum(1 for y in lines if y and not y.isspace()) - sum(1 for y in seen if y and not y.isspace()))
    data, offsets = flat(texts)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    method = (100 * n_covered <= MAX_COVERED_PERCENT * n_words) & (longest <= MAX_LONGEST)
    return {
        "doc_id": ids, "n_words": n_words, "word_chars": _sums(_WORD_CHAR[data], offsets), "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": pa.array(n_dup, pa.int64()), "n_repeat_words": n_repeat, "base_failed": failed, "kept": ~failed & method,
        "n_covered_words": n_covered, "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts, base_failed and kept (see the limits above), with
    n_covered_words (words in maximal repeated substrings of at least MIN_SUBSTRING words) and longest_repeat.

    Null text has no words and so fails. Texts are handled whole, a slice of them at a time; a very long
    text is a slice of its own. Repeated rows give repeated rows; other columns aren't read."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
    return map_texts(docs, rules, schema, id_col=id_col, text_col=text_col)
