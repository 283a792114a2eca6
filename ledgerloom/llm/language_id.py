"""Language identification: averaged hashed subword embeddings with a linear softmax.

Lower-cased letter n-grams (with word borders) are hashed into buckets, each with an embedding; a text is the
mean of its n-grams' embeddings and a linear softmax names the language. Trained by stochastic gradient descent
in numpy on a bounded sample, with letters in random order as one more class, so that text in no language has
somewhere to go. A temperature fitted on rows not trained on calibrates the probabilities, and a text whose
calibrated probability is below a threshold taken from those rows is rejected.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.shared import bounded_batches, lean

#: Fitting: rows of each language (of smallest seeded hash) and characters of each row (from a seeded place) that
#: are sent to the driver; share of these rows kept for calibration.
ROWS_PER_LANG, CHARS_PER_ROW, CALIBRATION = 700, 1200, 0.25
#: Rows of a language that are ranked, as a multiple of those sent.
NEAR = 4
BUCKETS, DIM, GRAMS = 1 << 16, 16, (1, 2, 3, 4)
#: Rejected are texts less probable than all but this share of the calibration rows and of short stretches of them,
#: but none that is more probable than so many times chance; a fit of too few rows to calibrate rejects below chance.
REJECT_SHARE, TIMES_CHANCE = 0.005, 2.0
UNKNOWN = "und"
#: Code points scored at once.
PIECE = 1 << 20

_alpha: np.ndarray | None = None


def is_letter(points: np.ndarray) -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _alpha[points]


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, all but letters as 0."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(is_letter(p), p, np.uint32(0))


def gram_buckets(p: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram at each place, -1 where it isn't one: a border may stand first or last only, and
    not alone."""
    if len(p) < n:
        return np.zeros(0, np.int32)
    m = len(p) - n + 1
    h = np.full(m, np.uint32(2166136261 + n))
    for i in range(n):
        h = (h ^ p[i : i + m]) * np.uint32(16777619)
        h ^= h >> np.uint32(13)
    letter = p != 0
    ok = letter[:m] | letter[n - 1 :]
    for i in range(1, n - 1):
        ok &= letter[i : i + m]
    return np.where(ok, (h & np.uint32(BUCKETS - 1)).astype(np.int32), np.int32(-1))


def text_buckets(text: str) -> np.ndarray:
    p = np.concatenate([[np.uint32(0)], code_points(text), [np.uint32(0)]])
    found = np.concatenate([gram_buckets(p, n) for n in GRAMS])
    return found[found >= 0]


@dataclass
class LanguageModel:
    #: The last class of the scores, letters in random order, has no name.
    langs: list[str]
    #: Class scores of each bucket: its embedding through the linear layer.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean class scores of whole texts, and whether each has a letter. Texts are joined and scored in
        pieces, so neither many short nor one very long text needs more memory."""
        sums, grams, letters = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts)), np.zeros(len(texts), bool)

        table = np.vstack([self.table, np.zeros((1, self.table.shape[1]), np.float32)])  # the last row for places without an n-gram

        def score(parts: list[tuple[int, np.ndarray, int]]) -> None:
            p = np.concatenate([x for _, x, _ in parts] + [np.zeros(max(GRAMS) - 1, np.uint32)])
            sizes = np.array([len(x) for _, x, _ in parts])
            rows, first = np.array([i for i, _, _ in parts]), np.cumsum(sizes) - sizes
            # What a piece has beyond its own places begins n-grams of the next one.
            again = np.concatenate([np.arange(len(x)) >= own for _, x, own in parts])
            for n in GRAMS:
                h = gram_buckets(p, n)[: sizes.sum()]
                h[again] = -1
                np.add.at(grams, rows, np.add.reduceat(h >= 0, first, dtype=np.int64))
                np.add.at(sums, rows, np.add.reduceat(np.take(table, h, axis=0, mode="wrap"), first, axis=0))

        held, size = [], 0
        for i, text in enumerate(texts):
            p = code_points(text)
            letters[i] = p.any()
            p = np.concatenate([[np.uint32(0)], p, [np.uint32(0)]])
            # Pieces of a very long text overlap, so that n-grams across a cut are whole in the first.
            for at in range(0, len(p), PIECE):
                held.append((i, p[at : at + PIECE + max(GRAMS) - 1], min(PIECE, len(p) - at)))
                size += len(held[-1][1])
                if size >= PIECE:
                    score(held)
                    held, size = [], 0
        if held:
            score(held)
        return sums / np.maximum(grams, 1)[:, None] + self.bias, letters

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, calibrated probability of it, and whether the text has a letter."""
        z, letters = self.logits(texts)
        p = softmax(z / self.temperature)[:, : len(self.langs)]
        return p.argmax(axis=1), p.max(axis=1), letters


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 3, epochs: int = 4, rate: float = 0.5) -> LanguageModel:
    """Fits on labelled texts: every row also gives a short stretch of itself, so short texts are learned too."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(texts))
    cut = int(CALIBRATION * len(texts)) if len(texts) >= 8 * len(names) else 0
    held, used = order[:cut], order[cut:]

    def stretch(text: str) -> str:
        n = int(rng.integers(8, 120))
        at = int(rng.integers(0, max(1, len(text) - n)))
        return text[at : at + n]

    def mixed_up(text: str) -> str:
        """Its letters in random order, its borders where they were."""
        p = np.array(list(stretch(text)))
        at = np.nonzero(np.char.isalpha(p))[0] if len(p) else np.zeros(0, np.int64)
        p[at] = p[rng.permutation(at)]
        return "".join(p)

    emb, w, b = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM, np.zeros((DIM, len(names) + 1)), np.zeros(len(names) + 1)
    cases = [(t, k) for i in used for t, k in ((texts[i], y[i]), (stretch(texts[i]), y[i]), (mixed_up(texts[i]) if rng.random() < 1 / len(names) else "", len(names)))]
    rows = [(np.unique(text_buckets(t), return_counts=True), k) for t, k in cases]
    rows = [r for r in rows if len(r[0][0])]
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for j in rng.permutation(len(rows)):
            (u, c), k = rows[j]
            share = (c / c.sum())[:, None]
            e = (emb[u] * share).sum(axis=0)
            g = softmax(e @ w + b)
            g[k] -= 1
            lr = rate * (1 - done / steps)
            ge = w @ g
            w -= lr * np.outer(e, g)
            b -= lr * g
            # The mean's gradient reaches a bucket by its share; scaled as if each gram had weight one.
            emb[u] -= lr * np.minimum(1.0, share * len(u)) * ge
            done += 1
    model = LanguageModel(names, (emb @ w).astype(np.float32), b, 1.0, 1 / (len(names) + 1))
    if cut:
        z, _ = model.logits([texts[i] for i in held] + [stretch(texts[i]) for i in held])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(2 * cut), np.tile(y[held], 2)] + 1e-12).mean()
        model.temperature = min((float(t) for t in np.geomspace(0.2, 20, 61)), key=loss)
        score = softmax(z / model.temperature)[:, : len(names)].max(axis=1)
        model.threshold = float(min(TIMES_CHANCE / (len(names) + 1), np.quantile(score, REJECT_SHARE)))
    return model


def held_out(doc_id: Column) -> Column:
    """The rows kept for measuring: crc32 of the id as text, a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, seed: int = 3) -> LanguageModel:
    """Fits on (doc_id, text, lang) rows with a text and a lang, ROWS_PER_LANG of each language. Rows are picked by id
    alone: only those whose hash lies in the lowest share, about NEAR * ROWS_PER_LANG of a language however many rows
    and tasks there are, are ranked. Of those picked, a bounded number, CHARS_PER_ROW characters are sent."""
    rows = docs.filter("lang is not null and text is not null and length(trim(text)) > 0")
    place = F.xxhash64("doc_id", F.lit(seed))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    start = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.greatest(F.lit(1), F.length("text") - CHARS_PER_ROW)) + 1).cast("int")
    sent = rows.select("doc_id", "lang", F.substring(F.col("text"), start, F.lit(CHARS_PER_ROW)).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))  # a row a language, as the model has a column
    near = place / F.lit(2.0**64) + 0.5 <= F.lit(float(NEAR * ROWS_PER_LANG)) / F.col("rows")
    picked = rows.select("doc_id", "lang").join(F.broadcast(sizes), "lang").filter(near).withColumn("k", rank).filter(F.col("k") <= ROWS_PER_LANG).select("doc_id", "lang").distinct()
    # Picked are ROWS_PER_LANG ids of each language at most; an id that repeats is limited once more.
    picked = sent.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")
    got = picked.withColumn("k", rank).filter(F.col("k") <= ROWS_PER_LANG).orderBy("lang", "k").select("text", "lang").toArrow()
    return train(got["text"].to_pylist(), got["lang"].to_pylist(), seed) if got.num_rows else LanguageModel([UNKNOWN], np.zeros((BUCKETS, 2), np.float32), np.zeros(2), 1.0, 0.0)


def identify(df: DataFrame, model: LanguageModel) -> DataFrame:
    """df with lang_pred (``und`` where the text is null or has no letter), score (0 to 1; 0 for ``und``) and
    rejected (``und``, or a score below the threshold), in place of its own columns of these names.

    Whole texts, however long; no shuffle; equal texts get equal answers; nothing but the text is looked at."""
    bounded_batches(df.sparkSession)
    others = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    held = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one number for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            k, s, letters = m.predict([x or "" for x in b.column("text").to_pylist()])
            known = letters & (m.langs != [UNKNOWN])
            names = np.where(known, np.array(m.langs, object)[k], UNKNOWN)
            score = np.where(known, s, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in others] + [pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < m.threshold))], names=[*others, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in others)
    return df.select(*others).mapInArrow(lean(run), f"{fields}, lang_pred string, score double, rejected boolean")
