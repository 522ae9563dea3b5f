"""Language identification with a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, flat, map_texts

#: Bounds of the training sample: texts and landmarks of each language.
PER_LANG, LANDMARKS = 256, 32
RIDGE, SHARPNESS = 1e-3, 6.0
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

#: Alphabet of 64 signs over UTF-8 bytes: 0 for ASCII other than letters, 1-26 letters without case, 27-58 second and
#: later bytes by their low five bits (which pairs the cases of Latin-1 letters), 59 up first bytes by their low bits.
ALPHABET = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isascii():
        ALPHABET[_b] = _b % 32 if chr(_b).isalpha() else 0
    else:
        ALPHABET[_b] = 27 + _b % 32 if _b < 0xC0 else 59 + _b % 5
#: n-grams of one, two and three signs have codes one after another.
CODES = 64 + 64**2 + 64**3


def gram_codes(sign: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of one text's signs, repeats included."""
    s = sign.astype(np.int32)
    two = s[:-1] * 64 + s[1:]
    return np.concatenate([s, two + 64, two[:-1] * 64 + s[2:] + 64 + 64**2])


#: Signs whose n-grams are marked at once.
STEP = 1 << 20


def mark_grams(mark: np.ndarray, sign: np.ndarray) -> None:
    """Marks the n-grams of one text's signs; a very long text in steps that overlap by two signs."""
    for a in range(0, len(sign), STEP):
        mark[gram_codes(sign[a : a + STEP + 2])] = True


def present(text: bytes) -> np.ndarray:
    """The distinct n-grams of a text, ascending: its presence vector."""
    mark = np.zeros(CODES, bool)
    mark_grams(mark, ALPHABET[np.frombuffer(text, np.uint8)])
    return np.flatnonzero(mark).astype(np.int32)


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # codes that any landmark holds
    landmarks: np.ndarray  # grams x landmarks, presence over the landmark's norm
    whiten: np.ndarray  # landmarks x features
    weights: np.ndarray  # features x languages
    bias: np.ndarray

    def kernel(self, marks: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """Normalised presence kernel of texts (their marks at self.grams) with every landmark."""
        return (marks.astype(np.float32) @ self.landmarks) / np.sqrt(np.maximum(distinct, 1))[:, None]

    def decide(self, marks: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        return self.kernel(marks, distinct) @ self.whiten @ self.weights + self.bias


def fit(grams: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fits one-versus-rest ridge regression in the Nyström features of at most `landmarks` texts a language."""
    names = sorted(set(langs))
    if not names:
        return None
    chosen = [i for n in names for i in [k for k, x in enumerate(langs) if x == n][:landmarks]]
    own = np.unique(np.concatenate([grams[i] for i in chosen]))
    marks = np.array([np.isin(own, g, assume_unique=True) for g in grams])
    distinct = np.array([len(g) for g in grams])
    base = marks[chosen].astype(np.float32) / np.sqrt(np.maximum(distinct[chosen], 1))[:, None]
    value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    model = Model(names, own, np.ascontiguousarray(base.T), (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32), None, None)
    x = (model.kernel(marks, distinct) @ model.whiten).astype(np.float64)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([1 / langs.count(n) for n in langs])  # languages count alike
    mean = share @ x / share.sum()
    centre = (share @ y) / share.sum()
    a = (x - mean) * share[:, None]
    weights = np.linalg.solve((x - mean).T @ a + ridge * np.eye(x.shape[1]), a.T @ (y - centre))
    model.weights, model.bias = weights.astype(np.float32), (centre - mean @ weights).astype(np.float32)
    return model


#: Languages that are learned: those of the most training rows, so that a column of stray values sends no more to the driver.
MOST_LANGS = 256


def has_letter(text: str) -> bool:
    """Whether a character is a letter by its Unicode category; the pattern alone would take other numbers for one."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def sample(docs: DataFrame, train: F.Column, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS) -> tuple[list[np.ndarray], list[str]]:
    """N-grams and languages of at most per_lang training rows a language, of the most_langs languages with the most of them (equal ones by
    name), picked by a hash of the id: the first
    pass reads ids and languages only, and the texts of the picked (id, language) become n-grams on the executors. Of rows that
    share both, the one whose text has the smallest hash is learned from, so neither order nor repeats decide and
    the driver gets no more rows than were picked."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    most = [r.lang for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_langs).collect()]
    rows = rows.where(F.col("lang").isin(most)) if most else rows
    h = F.xxhash64(F.col("doc_id").cast("long"))
    picked = rows.groupBy("lang", F.pmod(h, F.lit(per_lang)).alias("slot")).agg(F.min(F.struct(h.alias("h"), F.col("doc_id").cast("long").alias("id"))).alias("x"))
    ids = [(r.id, r.lang) for r in picked.select(F.col("x.id").alias("id"), "lang").collect()]  # per_lang rows a language at most
    if not ids:
        return [], []
    small = docs.sparkSession.createDataFrame(ids, "__id long, __lang string")
    texts = rows.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("__id"), F.col("lang").alias("__lang"), "text").join(F.broadcast(small), ["__id", "__lang"])

    def run(batches):
        for batch in batches:
            raw = as_bytes(batch.column(2))
            grams = pa.array([present(x) for x in raw], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), grams], names=["id", "lang", "h", "grams"])

    got = texts.mapInArrow(run, "id long, lang string, h binary, grams array<int>").where(F.size("grams") > 0)
    got = got.groupBy("id", "lang").agg(F.min(F.struct("h", "grams")).alias("x")).select("id", "lang", "x.grams").collect()
    got = sorted(got, key=lambda r: (r.id, r.lang))
    return [np.array(r.grams, np.int32) for r in got], [r.lang for r in got]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """doc_id, lang_pred and score of every whole text, by products of blocks of texts with the landmarks."""

    def run(ids, texts):
        data, offsets = flat(texts)
        sign = ALPHABET[data]
        n = len(ids)
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        known = [k for k, t in enumerate(texts.to_pylist()) if t and has_letter(t)] if model else []
        mark = np.zeros(CODES, bool)
        for lo in range(0, len(known), block):
            part = known[lo : lo + block]
            marks, distinct = np.zeros((len(part), len(model.grams)), bool), np.zeros(len(part))
            for row, k in enumerate(part):
                mark[:] = False
                mark_grams(mark, sign[offsets[k] : offsets[k + 1]])
                distinct[row], marks[row] = np.count_nonzero(mark), mark[model.grams]
            out = SHARPNESS * model.decide(marks, distinct)
            e = np.exp(out - out.max(axis=1, keepdims=True))
            best = out.argmax(axis=1)
            lang[part] = np.array(model.langs, object)[best]
            score[part] = (e / e.sum(axis=1, keepdims=True))[np.arange(len(part)), best]
        return {"doc_id": ids, "lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(score, pa.float64())}

    return map_texts(docs, run, "doc_id long, lang_pred string, score double", id_col=id_col, text_col=text_col)


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    Learns from documents whose crc32(doc_id) mod folds isn't held_fold and that have a language. A null text
    or one without a letter is `und` with score 0, and so is every text if there is nothing to learn from. A null id
    isn't held out and never learned from; of rows that repeat id and language one is learned from, with its own language.
    Repeated rows give repeated rows, an empty table none. A very long text counts whole, in steps; of other columns only lang is
    read, and only to learn."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit(*sample(docs, fold != held_fold))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
