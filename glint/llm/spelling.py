"""Spelling variants: words one edit apart, found by probing their edits against broadcast Bloom filters.

Words. Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased, counted over all whole texts; the vocabulary has
those of at least ``LEAST`` code points and ``COUNT`` occurrences.

Neighbours. Of each word all deletions of one code point, and all replacements by a larger one of the ``ALPHABET``, are hashed
(a polynomial hash, so an edit's hash comes from the word's by two multiplications) and looked up in the filter of the
words of that length. Insertions and smaller replacements are the same pairs seen from the other word. Only hits are
shuffled, as three numbers, to the vocabulary, where an exact comparison removes the filter's false positives and equal hashes.

Filters. A shard for each length, of 64-bit blocks in which a word sets five bits, ``BITS`` a word. All shards of a pass together
have at most ``BOUND`` bits, which is the most that is broadcast: a larger vocabulary is dealt by hash to more passes, each with filters of its
own. Lengths that have no partner are not probed.

Roots. A form has at least twice its word's count, so chains have no cycles and at most the logarithm of the largest count as
their length; they are followed by doubling.

Defined cases: a null text has no words; a null doc_id counts as the empty string where hashed; rows that repeat a doc_id count each;
an empty table gives an empty result; runs of any length are compared whole; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.llm import scratch
from glint.llm.words import mix

LEAST = 5
COUNT = 3
TIMES = 2
DAMAGED = 97
BITS = 24
BOUND = 1 << 28
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
_RUN = re.compile("[a-zÀ-ÿ]+").findall
_HELD = 1 << 19  # different words that a task holds before it gives their counts on
_TOGETHER = 1 << 21  # probes made at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def damaged(word: str, code: int) -> str:
    """The run without one code point where DAMAGED divides its code."""
    if code % DAMAGED:
        return word
    at = code % len(word)
    return word[:at] + word[at + 1 :]


def counts(docs: DataFrame) -> DataFrame:
    """word, n of all words of at least LEAST code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (raw := text.as_py()):
                    continue
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(_RUN(raw.encode().lower().decode())).items():  # of bytes only A-Z are lower-cased
                    word = damaged(word, zlib.crc32(word.encode(), start))
                    if len(word) >= LEAST:
                        held[word] += n
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- hashes and filters ----------------------------------------------------------------------------------------


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))), dtype=np.uint64)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial, from 0 to the whole."""
    terms = codes * _powers(codes.shape[1])[:-1]
    return np.concatenate((np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)


def identified(words: DataFrame) -> DataFrame:
    """word, n, id (its hash) and len."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [int(mix(_sums(_codes([w]))[:, -1])[0].view(np.int64)) for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int32())], ["word", "n", "id", "len"])

    return words.mapInArrow(run, "word string, n long, id long, len int")


def _place(ids: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the five bits of hashes."""
    h = mix(ids ^ _BASE)
    bits = np.zeros(h.shape, np.uint64)
    for k in range(5):
        bits |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), bits


def filters(words: DataFrame, sizes: dict[int, int], turn: int, passes: int) -> dict[int, np.ndarray]:
    """The blocks of each length's filter over the words whose turn it is."""
    blocks = {n: max(1, -(-BITS * c // (64 * passes))) for n, c in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for k in np.unique(n).tolist():
                at, bits = _place(ids[n == k], blocks[k])
                np.bitwise_or.at(own.setdefault(k, np.zeros(blocks[k], np.uint64)), at, bits)
        for k, x in own.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array(at), pa.array(x[at].view(np.int64))], ["len", "block", "bits"])

    # BOUND / 64 rows at most
    found = words.where(F.pmod("id", F.lit(passes)) == turn).select("id", "len").mapInArrow(run, "len int, block long, bits long")
    rows = found.groupBy("len", "block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = {n: np.zeros(b, np.uint64) for n, b in blocks.items()}
    n, at, bits = (rows.column(c).to_numpy() for c in ("len", "block", "bits"))
    for k in np.unique(n).tolist():
        out[k][at[n == k]] = bits[n == k].view(np.uint64)
    return out


def _hits(words: list[str], shards: dict[int, np.ndarray], turn: int, passes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(id, id of an edit that the filters know, its place, whether it is a deletion) of words of one length."""
    codes = _codes(words)
    m, n = codes.shape
    sums, powers = _sums(codes), _powers(n)
    own = mix(sums[:, -1])

    def known(ids: np.ndarray, shard: np.ndarray) -> np.ndarray:
        at, bits = _place(ids, len(shard))
        ok = shard[at] & bits == bits
        return ok & (ids.view(np.int64) % passes == turn) if passes > 1 else ok

    if n - 1 in shards:
        step = max(1, _TOGETHER // m)
        for a in range(0, n, step):
            i = np.arange(a, min(n, a + step))
            ids = mix(sums[:, i] + (sums[:, -1:] - sums[:, i + 1]) * _INVERSE)
            first = np.ones(ids.shape, bool)  # of a repeated code point only the first is taken out
            first[:, i > 0] = codes[:, i[i > 0]] != codes[:, i[i > 0] - 1]
            w, k = np.nonzero(known(ids, shards[n - 1]) & first)
            yield own[w], ids[w, k], i[k], np.ones(len(w), bool)
    if n in shards:
        step = max(1, _TOGETHER // (m * len(ALPHABET)))
        for a in range(0, n, step):
            i = np.arange(a, min(n, a + step))
            ids = mix(sums[:, -1][:, None, None] + (ALPHABET - codes[:, i][:, :, None]) * powers[i][None, :, None])
            w, k, c = np.nonzero(known(ids, shards[n]) & (ALPHABET > codes[:, i][:, :, None]))
            yield own[w], ids[w, k, c], i[k], np.zeros(len(w), bool)


def pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb) of the words (word, n, id, len) that one edit tells apart, each pair once."""
    spark = words.sparkSession
    sizes = {r["len"]: r["c"] for r in words.groupBy("len").agg(F.count("*").alias("c")).collect()}  # a row for each length
    passes = max(1, -(-BITS * sum(sizes.values()) // BOUND))
    same = {n for n, c in sizes.items() if c > 1}
    found = None
    for turn in range(passes):
        shards = filters(words, sizes, turn, passes)
        sent = spark.sparkContext.broadcast(shards)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                by_length: dict[int, list[str]] = {}
                for w in batch.column(0).to_pylist():
                    by_length.setdefault(len(w), []).append(w)
                for n, own in by_length.items():
                    shards = {k: sent.value[k] for k in (n - 1, n) if k in sent.value and (k < n or n in same)}
                    step = max(1, _TOGETHER // (n * len(ALPHABET)))
                    for a in range(0, len(own), step):
                        for x, y, at, gone in _hits(own[a : a + step], shards, turn, passes):
                            if len(x):
                                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(at, pa.int32()), pa.array(gone)], ["x", "y", "at", "gone"])

        hits = scratch.cut(words.select("word").mapInArrow(run, "x long, y long, at int, gone boolean"), "hits")
        sent.unpersist()
        found = hits if found is None else found.union(hits)
    side = lambda key, c: words.select(F.col("id").alias(key), F.col("word").alias(c), F.col("n").alias(f"n{c}")).hint("merge")
    met = found.join(side("y", "b"), "y").join(side("x", "a"), "x")
    rest = "substr(b, if(gone, at + 1, at + 2)) = substr(a, at + 2) and length(a) = length(b) + int(gone)"
    return met.where(f"a <> b and substr(a, 1, at) = substr(b, 1, at) and {rest}").select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and the last form that its forms (word, form) lead to."""
    known = scratch.cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        after = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.cut(known.join(after.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        moved = not step.where("moved").isEmpty()
        scratch.drop(known)
        known = step.select("word", "root")
        if not moved:
            return known


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary."""
    words = scratch.cut(identified(counts(docs).where(F.col("n") >= COUNT)), "vocabulary")
    near = pairs(words)
    both = near.union(near.select("b", "nb", "a", "na"))
    best = both.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("n"), F.col("b").alias("form"))).alias("best"))
    known = scratch.cut(words.select("word", "n").join(best.withColumnRenamed("a", "word").hint("merge"), "word", "left"), "nearest")
    known = known.withColumn("form_n", F.when(-F.col("best.n") >= TIMES * F.col("n"), -F.col("best.n"))).withColumn("form", F.when(F.col("form_n").isNotNull(), F.col("best.form")))
    led = roots(known.where("form is not null").select("word", "form"))
    out = known.join(led.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
