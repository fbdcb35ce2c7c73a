"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi.

A page is the sequence of its leaf blocks (``html_blocks``); each is article or not. A block's score is the sum of the weights of its
features (the tags and names above it, its section path, its parent, the shape of its text), neighbours are tied by four transition weights,
and the most likely sequence as a whole is taken. Weights maximise the likelihood of labelled pages, with a Gaussian prior.

Fit: at most ``PAGES`` labelled pages are read; features that fewer than ``LEAST`` of their blocks have are left out. Applying it is a
map over pages: nothing is shuffled.

Defined cases: a null or empty page, and one without article blocks, has an empty text; blocks of any length and number are read
whole; broken markup is read as browsers would; rows that repeat a page are extracted each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.llm.html_blocks import blocks

PAGES = 3000
LEAST = 3
PRIOR = 0.02
STEPS = 150
MEMORY = 8


@dataclass(frozen=True)
class Model:
    """What speaks for the article in each feature, and weights of passing from label to label (0 other, 1 article)."""

    weights: dict[str, float]
    passes: tuple[tuple[float, float], tuple[float, float]]


# ---- fit ---------------------------------------------------------------------------------------------------------


def labelled(html: str | None, main: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features of each block, and whether it is the next one of the article's; nothing if not all of these are blocks of the page."""
    features, labels, at = [], [], 0
    for text, own in blocks(html):
        hit = at < len(main) and text == " ".join(main[at].split())
        at += hit
        features.append(own)
        labels.append(int(hit))
    return (features, labels) if at == len(main) else ([], [])


def _likelihood(x: np.ndarray, rows: np.ndarray, at: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Negative log likelihood with prior, and its gradient.

    x: a weight for each of n features and the four passes. rows: block and feature of each entry. at: the place of each block
    in a grid of pages (the longest first) x blocks, which labels fill as far as lengths say.
    """
    block, feature = rows
    width = labels.shape[1]
    s = np.zeros(labels.shape)
    s[at[0], at[1]] = np.bincount(block, x[feature], minlength=len(at[0]))
    emit = np.stack((-s / 2, s / 2))
    move = x[n:].reshape(2, 2)
    open_ = [int((lengths > t).sum()) for t in range(width)]  # the first so many pages have a block t
    forward, back = np.zeros(emit.shape), np.zeros(emit.shape)
    forward[:, :, 0] = emit[:, :, 0]
    for t in range(1, width):
        k = open_[t]
        for z in (0, 1):
            forward[z, :k, t] = np.logaddexp(forward[0, :k, t - 1] + move[0, z], forward[1, :k, t - 1] + move[1, z]) + emit[z, :k, t]
    for t in range(width - 2, -1, -1):
        k = open_[t + 1]
        for a in (0, 1):
            back[a, :k, t] = np.logaddexp(move[a, 0] + emit[0, :k, t + 1] + back[0, :k, t + 1], move[a, 1] + emit[1, :k, t + 1] + back[1, :k, t + 1])
    pages = np.arange(len(lengths))
    total = np.logaddexp(forward[0, pages, lengths - 1], forward[1, pages, lengths - 1])
    real = np.arange(width) < lengths[:, None]
    both = real[:, 1:]
    chance = np.exp((forward[1] + back[1] - total[:, None])[at[0], at[1]])
    pair = np.array([[np.exp((forward[a, :, :-1] + move[a, z] + (emit + back)[z, :, 1:] - total[:, None])[both]).sum() for z in (0, 1)] for a in (0, 1)])
    first, then = labels[:, :-1][both], labels[:, 1:][both]
    own = np.where(labels == 1, emit[1], emit[0])[real].sum() + move[first, then].sum()
    seen = np.bincount(2 * first + then, minlength=4)
    wrong = chance - labels[at[0], at[1]]
    slope = np.concatenate((np.bincount(feature, wrong[block], minlength=n), pair.ravel() - seen))
    return total.sum() - own + PRIOR * (x @ x), slope + 2 * PRIOR * x


def minimised(f, x: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a halving search."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, marks = -slope, []
        for s, y in reversed(past):
            k = (s @ d) / (s @ y)
            d = d - k * y
            marks.append(k)
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), k in zip(past, reversed(marks), strict=True):
            d = d + s * (k - (y @ d) / (s @ y))
        step = 1.0 if past else 1.0 / max(1.0, float(np.abs(slope).sum()))
        while step > 1e-10:
            after, new = f(x + step * d)
            if after <= value + 1e-4 * step * (slope @ d):
                break
            step /= 2
        else:
            break
        moved, bent = step * d, new - slope
        if moved @ bent > 1e-12:
            past = [*past[1 - MEMORY :], (moved, bent)]
        done = value - after < 1e-6 * max(1.0, abs(value))
        x, value, slope = x + moved, after, new
        if done:
            break
    return x


def trained(pages: list[tuple[list[list[str]], list[int]]]) -> Model:
    """Weights of the labelled block sequences."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    count = Counter(f for features, _ in pages for own in features for f in own)
    names = sorted(f for f, c in count.items() if c >= LEAST)
    number = {f: i for i, f in enumerate(names)}
    lengths = np.array([len(p[0]) for p in pages], np.int64)
    labels = np.zeros((len(pages), lengths.max(initial=1)), np.int64)
    place: list[tuple[int, int]] = []
    entries: list[tuple[int, int]] = []
    for i, (features, own) in enumerate(pages):
        labels[i, : len(own)] = own
        for t, f in enumerate(features):
            entries += [(len(place), number[x]) for x in f if x in number]
            place.append((i, t))
    n = len(names)
    rows, at = np.array(entries, np.int64).reshape(-1, 2).T, np.array(place, np.int64).reshape(-1, 2).T
    x = minimised(lambda x: _likelihood(x, rows, at, labels, lengths, n), np.zeros(n + 4)) if pages else np.zeros(4)
    return Model(dict(zip(names, x[:n].tolist(), strict=True)), tuple(map(tuple, x[n:].reshape(2, 2).tolist())))


def fit(pages: DataFrame, limit: int = PAGES) -> Model:
    """The model of labelled pages (html, main: the texts of the article's blocks in order), of which at most ``limit`` are used;
    pages whose texts aren't found as blocks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labelled(html, main or []) for html, main in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.list_(pa.string()))), pa.array([y for _, y in found], pa.list_(pa.int32()))], ["features", "labels"])

    few = pages.select(F.col("html").cast("string").alias("html"), "main").orderBy(F.xxhash64("html")).limit(limit)
    return trained([(r["features"], r["labels"]) for r in few.mapInArrow(run, "features array<array<string>>, labels array<int>").collect()])


# ---- application --------------------------------------------------------------------------------------------------


def decoded(scores: list[float], passes: tuple[tuple[float, float], tuple[float, float]]) -> list[int]:
    """The most likely labels of blocks whose features speak for the article by ``scores`` (Viterbi; of equals not the article)."""
    if not scores:
        return []
    (oo, oa), (ao, aa) = passes
    other, article, steps = -scores[0] / 2, scores[0] / 2, []
    for s in scores[1:]:
        stay, come = other + oo >= article + ao, article + aa > other + oa
        steps.append((stay, come))
        other, article = (other + oo if stay else article + ao) - s / 2, (article + aa if come else other + oa) + s / 2
    out = [int(article > other)]
    for stay, come in reversed(steps):
        out.append(int(come) if out[-1] else int(not stay))
    return out[::-1]


def main_text(html: str | None, model: Model) -> str:
    weights = model.weights
    found = [(text, sum([weights[f] for f in own])) for text, own in blocks(html, weights)]
    kept = decoded([s for _, s in found], model.passes)
    return " ".join(text for (text, _), k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # a weight for each feature of the bounded fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), sent.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
