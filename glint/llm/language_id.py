"""Language ID by nearest centroid.

A text's vector has the normalised TF-IDF weights of its 1- to 3-character n-grams (letters in lower case, anything
else one space), hashed to ``DIMS`` places. Each language has several centroids, found by spherical k-means on its
training texts; a text gets the language of the centroid with the largest cosine, which is its score. It is rejected
if that cosine is below what the centroid's own training texts have, by a margin.

The model is fitted on at most ``per_language`` texts for each language (a documented bound, chosen by hash of doc_id);
prediction reads every whole text and nothing but the text.

Defined cases: null text or one without a letter is ``und`` with score 0 and rejected; ties go to the language first in
order; training rows without a language are ignored; without any training text all is ``und``; repeated rows are
predicted alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

DIMS = 4096
PER_LANGUAGE = 300
CENTROIDS = 4
MARGIN = 0.5
_LETTER = np.zeros(0x110000, bool)
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(i).isalpha() for i in range(0x110000)]
    return _LETTER


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the whole text's hashed n-grams; None without a letter."""
    if not text:
        return None
    out, any_letter, block = np.zeros(DIMS, np.float32), False, 1 << 20
    for at in range(0, len(text), block):  # n-grams across the edges of blocks come from the two characters before
        c = np.frombuffer(text[max(0, at - 2) : at + block].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        any_letter |= bool(letter.any())
        c = np.where(letter, c, np.uint32(32))
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
        h = c * _FACTORS[0]
        lo = min(2, at)
        for n in range(3):
            if n:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _FACTORS[n] + c[n:]
            out += np.bincount(((h[max(0, lo - n) :] * _FACTORS[2]) >> np.uint32(20)).astype(np.int64), minlength=DIMS)[:DIMS].astype(np.float32)
    return out if any_letter else None


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    language: np.ndarray
    least: np.ndarray

    def vector(self, n: np.ndarray) -> np.ndarray:
        v = np.log1p(n) * self.idf
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        n = counts(text) if len(self.centres) else None
        if n is None:
            return "und", 0.0, True
        near = self.centres @ self.vector(n)
        best = int(np.argmax(near))
        return self.languages[self.language[best]], float(min(1.0, max(0.0, near[best]))), bool(near[best] < self.least[best])


def _means(v: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; the first centres are the rows furthest from those before."""
    centres = v[:1]
    for _ in range(min(k, len(v)) - 1):
        centres = np.vstack((centres, v[np.argmin((v @ centres.T).max(1))]))
    for _ in range(rounds):
        own = (v @ centres.T).argmax(1)
        sums = np.stack([v[own == i].sum(0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (v @ centres.T).argmax(1)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, margin: float = MARGIN) -> Centroids:
    """Learn from the text and language of the rows where ``train`` holds."""
    labelled = F.col("lang").isNotNull() & F.col("text").isNotNull()
    rows = docs.where(train & labelled).select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id")).alias("h"), F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").count()  # a row for each language
    # a share of each language by hash, enough for its bound, then exactly the bound
    sizes = sizes.select("lang", F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("count")).alias("share"))
    near = rows.join(F.broadcast(sizes), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "h", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, h, texts = batch.columns
            found = [(a, b, n.tobytes()) for a, b, t in zip(langs.to_pylist(), h.to_pylist(), texts, strict=True) if (n := counts(t.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "v"])

    held = near.mapInArrow(vectors, "lang string, h long, v binary")
    bounded = held.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "v"))).where(F.col("r") <= per_language)
    sample = sorted((r.lang, r.h, bytes(r.v)) for r in bounded.select("lang", "h", "v").toLocalIterator())
    if not sample:
        return Centroids([], np.zeros(DIMS), np.zeros((0, DIMS)), np.zeros(0, int), np.zeros(0))
    n = np.stack([np.frombuffer(v, np.float32) for _, _, v in sample])
    idf = np.log((1 + len(n)) / (1 + (n > 0).sum(0))).astype(np.float32) + 1
    v = np.log1p(n) * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    names = np.array([x[0] for x in sample])
    model = Centroids(sorted(set(names)), idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    for i, name in enumerate(model.languages):
        own = v[names == name]
        centres, of = _means(own, centroids)
        near_own = (own @ centres.T).max(1)
        least = [margin * float(np.quantile(near_own[of == c], 0.01)) if (of == c).any() else 0.0 for c in range(len(centres))]
        model.centres, model.language, model.least = np.vstack((model.centres, centres)).astype(np.float32), np.append(model.language, [i] * len(centres)), np.append(model.least, least)
    return model


def predict(docs: DataFrame, model: Centroids, *keep: str) -> DataFrame:
    """lang_pred, score and rejected for the text of each row, beside the columns named in ``keep``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x DIMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [sent.value.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array([s[2] for s in said], pa.bool_())], [*batch.schema.names[1:], "_lang_pred", "_score", "_rejected"])

    rows = docs.select(F.col("text").cast("string").alias("_read_"), *[F.col(c).alias(f"_{i}_") for i, c in enumerate(keep)])
    schema = StructType([*rows.schema[1:], StructField("_lang_pred", StringType()), StructField("_score", DoubleType()), StructField("_rejected", BooleanType())])
    said = rows.mapInArrow(run, schema).withColumnsRenamed({f"_{i}_": c for i, c in enumerate(keep)})
    return said.select(*keep, *[F.col(f"_{c}").alias(c) for c in ("lang_pred", "score", "rejected")])


def accepted(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows whose language the model knows, with their columns as they are, whatever these are called."""
    names = docs.columns
    rows = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(names)])
    said = predict(rows, model, *rows.columns).where("not rejected")
    return said.select(*[F.col(own).alias(c) for own, c in zip(rows.columns, names, strict=True)])
