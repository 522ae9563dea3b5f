"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, flat, lean, map_texts, slices

#: Bounds of the training sample: trusted positives and unlabelled texts.
POSITIVES, UNLABELLED = 2048, 4096
#: Text bytes that keep_good looks at together.
FILTER_BYTES = 1 << 20
HIDDEN, STEPS, RATE, DECAY, SEED = 24, 500, 0.01, 1e-3, 7

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,),
    "stop": b".,", "loud": b"!?", "mark": b"#*$%&@~^=+", "bar": b"|<>{}[]_/\\", "other": range(128, 192), "first": range(192, 256),
}
NAMES = [*_CLASSES, "log_bytes", "word_bytes", "log_line_bytes", "distinct_words", "top_word", "repeated_lines", "squeeze", "long_words", "marked_words"]


def features(texts: pa.Array) -> np.ndarray:
    """What a text looks like, a row each: shares of byte classes, sizes of words and lines, and repetition. Empty texts are zeros."""
    data, offsets = flat(texts)
    size = np.diff(offsets)
    n, some = len(size), np.maximum(size, 1)
    out = np.zeros((n, len(NAMES)))
    table = np.full(256, len(_CLASSES), np.uint8)
    for k, own in enumerate(_CLASSES.values()):
        table[list(own)] = k
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * (len(_CLASSES) + 1) + table[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)
    out[:, : len(_CLASSES)] = counts[:, : len(_CLASSES)] / some[:, None]
    at = len(_CLASSES)
    for k, text in enumerate(as_bytes(texts)):
        words = text.split()
        if not words:
            continue
        low = [w.lower() for w in words]
        seen: dict[bytes, int] = {}
        for w in low:
            seen[w] = seen.get(w, 0) + 1
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
        out[k, at:] = (
            np.log1p(len(text)), (len(text) - len(words)) / len(words), np.log1p(len(text) / len(lines)), np.log1p(len(seen)) / np.log1p(len(words)), max(seen.values()) / len(words),
            1 - len(set(lines)) / len(lines), len(zlib.compress(text, 1)) / (len(text) + 64), sum(len(w) > 20 for w in words) / len(words), marked / len(words),
        )
    return out


@dataclass
class Net:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.parts
        return np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ w + b) @ v + c

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x).clip(-30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.05) -> float:
    """Estimated share of positives among the unlabelled, from scores of held-back positives and of the unlabelled:
    the least ratio of the shares above any score, with a bound for the error of each (best-bin estimation)."""
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / sure) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    ok = p > 0.1
    best = int(((u + slack) / np.where(ok, p, np.nan))[ok].argmin())
    return float(np.clip((u / np.maximum(p, 1e-9))[ok][best], 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, nonnegative: bool = True, steps: int = STEPS, seed: int = SEED) -> Net:
    """Minimises the unbiased positive-unlabelled risk of the sigmoid loss with Adam over whole batches. Where the
    negative part of the risk falls below zero, the step goes up its gradient instead (non-negative correction)."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    net = Net(mean, scale, [rng.normal(0, both.shape[1] ** -0.5, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())])
    x = ((both - mean) / scale).clip(-8, 8)
    n = len(positive)
    first, second = [np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts]
    for step in range(1, steps + 1):
        w, b, v, c = net.parts
        hidden = np.tanh(x @ w + b)
        loss = 1 / (1 + np.exp((hidden @ v + c).clip(-30, 30)))  # of label 1; that of label 0 is 1 - loss
        slope = loss * (1 - loss)  # minus the derivative of loss
        negative = (1 - loss[n:]).mean() - prior * (1 - loss[:n]).mean()
        grad = np.empty(len(x))
        if nonnegative and negative < 0:
            grad[:n], grad[n:] = prior * slope[:n] / n, -slope[n:] / (len(x) - n)
        else:
            grad[:n], grad[n:] = -2 * prior * slope[:n] / n, slope[n:] / (len(x) - n)
        back = grad[:, None] * v[None, :] * (1 - hidden**2)
        grads = [x.T @ back + DECAY * w, back.sum(axis=0), hidden.T @ grad + DECAY * v, grad.sum()]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.parts[k] = net.parts[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    return net


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Net | None:
    """Estimates the prior with a net that tells a half of the positives from a half of the unlabelled, then trains on all."""
    if len(positive) < 8 or len(unlabelled) < 8:
        return None
    if prior is None:
        teller = train(positive[::2], unlabelled[::2], 0.5, nonnegative=False, steps=200)
        prior = class_prior(teller.score(positive[1::2]), teller.score(unlabelled[1::2]))
    return train(positive, unlabelled, prior)


def _sampled(docs: DataFrame, ids: DataFrame, bound: int) -> np.ndarray:
    """Features of at most `bound` of the ids, those with the least hash in each of `bound` slots. Of rows that repeat an id the one
    with the smallest features is taken, so the driver gets no more rows than were picked."""
    h = F.xxhash64("doc_id")
    picked = ids.where("doc_id is not null").groupBy(F.pmod(h, F.lit(bound)).alias("slot")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("x")).select("x.doc_id").collect()
    if not picked:
        return np.zeros((0, len(NAMES)))
    small = docs.sparkSession.createDataFrame([(r.doc_id,) for r in picked], "doc_id long")  # bound rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(small), "doc_id", "left_semi")
    rows = map_texts(texts, lambda ids, texts: {"doc_id": ids, "x": pa.array(list(features(texts)), pa.list_(pa.float64()))}, "doc_id long, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    return np.array([r.x for r in sorted(rows, key=lambda r: r.doc_id)]).reshape(-1, len(NAMES))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Net | None:
    """The net learned from bounded samples: trusted positives are training rows with labels.quality 1, the unlabelled are
    training documents, their labels unseen. None with fewer than 8 of either."""
    own = F.crc32(F.col("doc_id").cast("string")) % folds != held_fold
    good = labels.where(own & (F.col("quality") == 1)).select(F.col("doc_id").cast("long").alias("doc_id"))
    web = docs.where(own).select(F.col("doc_id").cast("long").alias("doc_id"))
    return fit(_sampled(docs, good, positives), _sampled(docs, web, unlabelled))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    The samples are bounded; every text is scored, a very long one whole. Null and empty texts score as empty ones do. Labels of null
    ids or null quality count for nothing. With fewer than 8 positives or 8 training documents every score is 0.5. Repeated
    rows give repeated rows, an empty table none; other columns aren't read."""
    net = learn(docs, labels, folds, held_fold, positives, unlabelled)

    def run(ids, texts):
        return {"doc_id": ids, "score": pa.array(net.score(features(texts)) if net else np.full(len(ids), 0.5), pa.float64())}

    out = map_texts(docs, run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores 0.5 or more, all columns as they are; repeated rows stay or go together. The decision is
    made in the row: no join. Where there is too little to learn from (see learn), all rows stay; an empty table stays empty."""
    net = learn(docs, labels)

    def run(batches):
        for batch in batches:
            at, lo = batch.schema.get_field_index(text_col), 0
            for part, texts in slices(batch.column(at), batch.column(at), FILTER_BYTES):
                rows = batch.slice(lo, len(part))
                lo += len(part)
                yield rows.filter(pa.array(net.score(features(texts)) >= 0.5)) if net else rows

    return docs.mapInArrow(lean(run), docs.schema)
