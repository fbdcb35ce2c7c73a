"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

Labels say toxic or not; a grade is 0 for rows that aren't toxic, and 1 to 3 by how much of the text the words take that go
with the toxic label in the other half of the training rows: a text's own label and words have no part in its grade. One weight vector is shared by all thresholds:
P(grade > k) = sigmoid(w . x - theta_k) with theta_1 <= theta_2 <= theta_3. The result is the expected grade.

Features are the rates of words and of words' first five bytes, known by a 64-bit hash, that the training labels speak for
beyond chance. The fit uses at most ``max_rows`` labelled rows (a documented bound, chosen by hash of doc_id), one for
each smallest 5-word shingle, and a word counts once in each context, so copies of a text or passage aren't further
evidence. Where a text starts to count as toxic is set on the training rows (largest F0.5). Scoring reads every whole text.

Defined cases: null or empty text has no features, so the intercept's severity; without labels of both kinds nothing
is toxic and severity is 0; a doc_id labelled twice is toxic if one label says so; repeated rows are scored alike;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.llm.words import mix, shingle_set, word_hashes

MAX_ROWS = 6000
MAX_FEATURES = 400
CHANCE = 100.0
STEM = 5
PRIOR = 50
_STEM_MARK = np.uint64(0x5DEECE66D)


@dataclass
class Severity:
    features: np.ndarray
    weights: np.ndarray
    theta: np.ndarray
    edge: float

    def counts(self, words: np.ndarray) -> np.ndarray:
        if not len(self.features) or not len(words):
            return np.zeros(len(self.features))
        at = np.minimum(np.searchsorted(self.features, words), len(self.features) - 1)
        return np.bincount(at[self.features[at] == words], minlength=len(self.features))

    def score(self, text: str | None) -> tuple[float, int, bool]:
        """Expected severity, most likely grade, and whether the text counts as toxic."""
        words, stems = _features(text)
        x = _values(self.counts(np.concatenate((words, stems))), len(words))
        over = 1 / (1 + np.exp(-(x @ self.weights - self.theta)))
        each = -np.diff(np.concatenate(([1.0], over, [0.0])))
        return float(over.sum()), int(np.argmax(each)), bool(over[0] >= self.edge)


def _plain(text: str | None) -> str:
    """White space for ASCII characters that aren't letters, so that stops don't hide a word."""
    return (text or "").lower().translate(_TABLE)


def _values(counts: np.ndarray, words) -> np.ndarray:
    """Of features: log(1 + their rate in a hundred words), with PRIOR more words so that one hit in a short text isn't a high rate."""
    return np.log1p(100 * counts / (np.asarray(words)[..., None] + PRIOR))


def _features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, then those of their beginnings."""
    plain = _plain(text)
    return word_hashes(plain), word_hashes(plain, prefix=STEM) ^ _STEM_MARK


_TABLE = {i: " " for i in range(128) if not chr(i).isalpha()}


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int = 4, l2: float = 0.02, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the largest penalised likelihood, by Adam on the whole sample."""
    k, n = grades - 1, len(x)
    share = np.array([(grade > i).mean() for i in range(k)]).clip(1e-4, 1 - 1e-4)
    first = -np.log(share / (1 - share))
    p = np.concatenate((np.zeros(x.shape[1]), first[:1], np.log(np.maximum(np.diff(first), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, steps = p[: -k], np.exp(p[-k + 1 :])
        theta = p[-k] + np.concatenate(([0.0], np.cumsum(steps)))
        over = 1 / (1 + np.exp(-(x @ w)[:, None] + theta))
        cum = np.concatenate((np.ones((n, 1)), over, np.zeros((n, 1))), 1)
        own = np.maximum(cum[np.arange(n), grade] - cum[np.arange(n), grade + 1], 1e-9)
        slope = cum * (1 - cum)
        d = np.zeros((n, k))  # of the log likelihood by each (w.x - theta_k)
        rows = np.arange(n)
        has = grade > 0
        d[rows[has], grade[has] - 1] += slope[rows[has], grade[has]] / own[has]
        has = grade < k
        d[rows[has], grade[has]] -= slope[rows[has], grade[has] + 1] / own[has]
        by_theta = -d.sum(0)
        g = np.concatenate((x.T @ d.sum(1) / n - l2 / n * w, [by_theta.sum() / n], np.array([by_theta[i + 1 :].sum() for i in range(k - 1)]) * steps / n))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:-k], p[-k] + np.concatenate(([0.0], np.cumsum(np.exp(p[-k + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Severity:
    """Learn from the texts that ``labels`` (doc_id, toxic) speaks about."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, 1.2 * max_rows / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("of"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marked, F.col("doc_id") == F.col("of")).select("doc_id", "toxic", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shingles = shingle_set(text, 5)
                w, stems = _features(text)
                if not len(w):
                    continue
                own, first, n = np.unique(np.concatenate((w, stems)), return_index=True, return_counts=True)
                around = mix(np.concatenate((w[:1], w[:-1])) ^ mix(np.concatenate((w[1:], w[-1:]))))
                around = np.concatenate((around, around))
                found.append((i, toxic, int(shingles[0].astype(np.int64)), own.tobytes(), n.astype("<u4").tobytes(), around[first].tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(kinds)], ["doc_id", "toxic", "least", "words", "n", "around"])

    one = rows.mapInArrow(words, "doc_id long, toxic int, least long, words binary, n binary, around binary").groupBy("least").agg(F.min_by(F.struct("doc_id", "toxic", "words", "n", "around"), F.struct("doc_id", "toxic")).alias("r")).select("r.*")
    sample = sorted(one.orderBy(F.xxhash64("doc_id")).limit(max_rows).toLocalIterator(), key=lambda r: r.doc_id)
    y = np.array([r.toxic > 0 for r in sample], bool)
    none = Severity(np.zeros(0, np.uint64), np.zeros(0), np.full(3, 40.0), 0.5)
    if not y.any() or y.all():
        return none
    held = [(np.frombuffer(r.words, "<u8"), np.frombuffer(r.n, "<u4")) for r in sample]
    vocabulary, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
    row = np.repeat(np.arange(len(held)), [len(w) for w, _ in held])
    around = np.concatenate([np.frombuffer(r.around, "<u8") for r in sample])
    pick = _telling(at, around, y[row], len(vocabulary))
    if not len(pick):
        return none
    n = np.concatenate([c for _, c in held]).astype(float)
    counts = _counted(at, row, n, pick, len(held), len(vocabulary))
    words = np.bincount(row, weights=n, minlength=len(held)) / 2  # each word is there twice, whole and by its beginning
    half = np.array([r.doc_id for r in sample]).astype(np.uint64)
    half = mix(half) >> np.uint64(63) == 1
    density = np.zeros(len(held))
    for side in (False, True):  # the words are chosen on one half, the other half is graded by them
        other = half[row] != side
        told = _telling(at[other], around[other], y[row][other], len(vocabulary))
        own = _counted(at, row, n, told, len(held), len(vocabulary)).sum(1)
        density[half == side] = (own / np.maximum(1, words))[half == side]
    edges = np.quantile(density[y & (density > 0)], [1 / 3, 2 / 3]) if (y & (density > 0)).any() else np.zeros(2)
    grade = np.where(y, 1 + (density > edges[0]).astype(int) + (density > edges[1]), 0)
    x = _values(counts, words)
    weights, theta = fit_ordinal(x, grade)
    over = 1 / (1 + np.exp(-(x @ weights - theta[0])))
    return Severity(vocabulary[pick], weights, theta, _edge(over, y))


def _telling(at: np.ndarray, around: np.ndarray, toxic: np.ndarray, n: int) -> np.ndarray:
    """Of n words those (MAX_FEATURES at most, ascending) that go with the label beyond chance, from their places."""
    n1, n0 = (_contexts(at[own], around[own], n) for own in (toxic, ~toxic))
    if not n1.any() or not n0.any():
        return np.zeros(0, int)
    all_, base = n1 + n0, n1.sum() / (n1.sum() + n0.sum())
    share = np.clip(n1 / np.maximum(all_, 1), 1e-9, 1 - 1e-9)
    # Chernoff's bound on the chance that a word meets the label so often; one in CHANCE of all words may by accident
    bits = np.where(share > base, all_ * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))), 0.0)
    pick = np.argsort(-bits, kind="stable")[:MAX_FEATURES]
    return np.sort(pick[bits[pick] >= np.log(n * CHANCE)])


def _counted(at: np.ndarray, row: np.ndarray, n: np.ndarray, pick: np.ndarray, rows: int, words: int) -> np.ndarray:
    """How often each row has each picked word."""
    place = np.full(words, -1)
    place[pick] = np.arange(len(pick))
    counts = np.zeros((rows, len(pick)))
    known = place[at] >= 0
    np.add.at(counts, (row[known], place[at[known]]), n[known])
    return counts


def _contexts(at: np.ndarray, around: np.ndarray, n: int) -> np.ndarray:
    """For each word, in how many different contexts it stands: a passage that many texts share is evidence once."""
    order = np.lexsort((around, at))
    at, around = at[order], around[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (around[1:] != around[:-1])
    return np.bincount(at[new], minlength=n)


def _edge(over: np.ndarray, y: np.ndarray) -> float:
    """The probability of grade 1 or more from which the training rows are best told apart (largest F0.5: a clean text called toxic costs more than a toxic one missed), half way to the next below."""
    values, at = np.unique(over, return_inverse=True)
    hits, all_ = np.bincount(at[y], minlength=len(values)), np.bincount(at, minlength=len(values))
    tp, said = np.cumsum(hits[::-1])[::-1], np.cumsum(all_[::-1])[::-1]
    best = int(np.argmax(1.25 * tp / (said + 0.25 * y.sum())))
    return float(values[best] + values[best - 1]) / 2 if best else float(values[0])


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """doc_id, expected_severity (0 to 3), severity (the likeliest grade) and toxic for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [sent.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[i] for s in said], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.bool_())))], ["doc_id", "expected_severity", "severity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_severity double, severity long, toxic boolean")
