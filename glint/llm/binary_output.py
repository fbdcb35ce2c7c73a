"""Token-ID output: raw id payloads in shards, with a minimal perfect hash index from document keys to offsets.

Format. A folder of Parquet files, a row for each shard, shards ascending by (part, seq), documents ascending by
doc_id (null first) over all shards:

* ``payload``: the ids of the shard's documents end to end, little-endian, ``width`` bytes each;
* ``keys``: its doc_ids in order (int64) and ``null_keys`` (how many leading ones are null), ``copy``: for each
  document how many earlier rows have the same doc_id (uint32);
* ``seeds`` (int32 for each bucket), ``prints`` (uint32 for each slot), ``offsets`` and ``counts`` (int64 and uint32
  for each slot): the index. A key's bucket gives a seed; the seed gives its slot, which no other key of the shard
  has; the fingerprint there tells keys that aren't in the shard; offset and count (in ids) lead into the payload.

A shard closes at ``shard_ids`` ids or ``shard_docs`` documents; a longer document is a shard of its own, so a row
is bounded by those or by one document. Everything moves as Parquet, so any store that Spark writes will do.

Defined cases: a null or empty text has only the end id; repeated doc_ids are kept, told apart by ``copy`` and
ordered by text; an empty table gives an empty folder; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glint.llm.words import mix

SHARD = "part int, seq int, first_key long, last_key long, null_keys long, n_docs long, n_ids long, width int, payload binary, keys binary, copy binary, seeds binary, prints binary, offsets binary, counts binary"
_EMPTY, _GOLD = np.uint64(0xD1B54A32D192ED03), np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 1_000_000
_TOGETHER, _LENGTH = 2048, 1 << 22  # texts encoded together, and their bytes (but for one longer text)
_MARK = r"[!-&(-/:-@\[-`{}~]"
#: Of each word: marks, Latin letters, marks, which are separate pieces for the tokenizer (no apostrophe, and no | as in its own tokens); or the word.
_PARTS = re.compile(rf"(?:({_MARK}*)([A-Za-zÀ-ÖØ-öø-ÿ]+)({_MARK}*)|([^ ]+))(?: |$)").findall
_tokenizers: dict = {}
_known: dict[tuple[str, int], tuple[dict[str, bytes], dict[str, bytes]]] = {}


# ---- the index -------------------------------------------------------------------------------------------------


def key_hash(keys: np.ndarray, copy: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64 bits for each (doc_id, copy)."""
    h = mix(keys.astype(np.int64).view(np.uint64) + _GOLD)
    h = mix(h ^ (copy.astype(np.uint64) * _GOLD))
    return np.where(null, mix(h ^ _EMPTY), h)


def _slot(h: np.ndarray, seed, n: int) -> np.ndarray:
    return (mix(h + np.uint64(seed * int(_GOLD) % (1 << 64))) % np.uint64(n)).astype(np.int64)


def build_index(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by bucket and the slot of each key; a negative seed names the slot of a bucket's only key."""
    n = len(h)
    buckets = max(1, n // 3)
    bucket = (mix(h ^ _EMPTY) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    seeds, slots, taken = np.zeros(buckets, np.int32), np.empty(n, np.int64), np.zeros(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    for b in by_size:
        if sizes[b] < 2:
            break
        own = order[starts[b] : starts[b + 1]]
        seed = 1
        while True:
            s = _slot(h[own], seed, n)
            if not taken[s].any() and len(np.unique(s)) == len(s):
                break
            seed += 1
            if seed > 1 << 24:
                raise ValueError("two keys of a shard have one hash")
        seeds[b], slots[own] = seed, s
        taken[s] = True
    singles = by_size[sizes[by_size] == 1]
    free = np.flatnonzero(~taken)
    seeds[singles] = -free - 1
    slots[order[starts[singles]]] = free
    return seeds, slots


def find(h: np.ndarray, seeds: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The slot of each key hash, -1 where the fingerprint says that the shard hasn't got the key."""
    n = len(prints)
    if not n:
        return np.full(len(h), -1, np.int64)
    seed = seeds[(mix(h ^ _EMPTY) % np.uint64(len(seeds))).astype(np.int64)]
    slot = np.where(seed < 0, -seed.astype(np.int64) - 1, (mix(h + np.maximum(seed, 0).astype(np.uint64) * _GOLD) % np.uint64(n)).astype(np.int64))
    return np.where(prints[slot] == fingerprint(h), slot, -1)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h + _EMPTY) >> np.uint64(32)).astype(np.uint32)


# ---- encoding ---------------------------------------------------------------------------------------------------


def encoder(path: str, width: int = 4):
    """A function from texts to their ids (little-endian, ``width`` bytes each).

    The tokenizer's normaliser and splitter never look across ASCII white space, so a text's ids are those of its
    white-space-separated words; the library encodes each word once for as long as the worker remembers it. What words
    of several texts are new is found and encoded together.
    """
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _tokenizers[path] = tokenizer, ends
    tokenizer, ends = _tokenizers[path]
    known, pieces = _known.setdefault((path, width), ({}, {}))
    kind = np.dtype(f"<u{width}")

    def stored(ids: list[int]) -> np.ndarray:
        if ids and max(ids) >> (8 * width):
            raise ValueError("an id needs more bytes than width")
        return np.asarray(ids, kind)

    def ids_of(words: list[str]) -> list[bytes]:
        return [stored(e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def ids_of_stems(stems: list[str]) -> list[bytes]:
        """The same for words that are one piece each: encoded as one text, whose pieces end where a token ends a word."""
        if not stems:
            return []
        ids = stored(tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids)
        stops = ((np.flatnonzero(ends[ids]) + 1) * width).tolist()
        if len(stops) != len(stems):
            return ids_of(stems)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def learn(new: list[str]) -> list[bytes]:
        if not new:
            return []
        cut = _PARTS(" ".join(new).lower())
        stems = [stem for _, stem, _, _ in cut]
        for words, encode in ((set(stems), ids_of_stems), ({m for a, _, b, _ in cut for m in (a, b)}, ids_of)):
            words = [w for w in words if w not in pieces]
            pieces.update(zip(words, encode(words), strict=True))
        out = [pieces[s] if not a and not b else pieces[a] + pieces[s] + pieces[b] for a, s, b, _ in cut]
        others = [i for i, c in enumerate(cut) if c[3]]
        for i, x in zip(others, ids_of([new[i] for i in others]), strict=True):
            out[i] = x
        known.update(zip(new, out, strict=True))
        return out

    def encode(texts: pa.Array) -> list[bytes]:
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        at, different = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        for memory in (known, pieces):
            if len(memory) > CACHE_WORDS:  # the words met first are the frequent ones: they stay
                kept = dict(islice(memory.items(), CACHE_WORDS // 4))
                memory.clear()
                memory.update(kept)
        known[""] = pieces[""] = b""
        found = list(map(known.get, different))
        new = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(new, learn([different[i] for i in new]), strict=True):
            found[i] = x
        ids, n = np.frombuffer(b"".join(found), kind), np.fromiter(map(len, found), np.int64, len(found)) // width
        first = np.cumsum(n) - n
        own = n[at]
        ends = np.cumsum(own)
        out = ids[np.repeat(first[at] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        stops = (np.concatenate(([0], ends))[words.offsets.to_numpy() - words.offsets[0].as_py()] * width).tolist()
        return [out[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    return encode


def write(docs: DataFrame, to: str, tokenizer: str, end_id: int = 1, width: int = 2, shard_ids: int = 1_000_000, shard_docs: int = 65_536) -> None:
    """Encode every whole text and write shards and their index to ``to``.

    Documents are dealt by ranges of doc_id and sorted within them; a task holds one shard at a time.
    """
    kind = np.dtype(f"<u{width}")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(tokenizer, width), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], kind).tobytes()
        keys: list = []
        copy: list[int] = []
        pieces: list[bytes] = []
        held, last, repeat = 0, object(), 0

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple]:
            keys, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            sizes = pc.binary_length(texts).fill_null(0).to_numpy()
            while at < len(keys):
                stop = at + max(1, min(_TOGETHER, int(np.searchsorted(np.cumsum(sizes[at : at + _TOGETHER]), _LENGTH))))
                yield from zip(keys[at:stop], [x + end for x in encode(texts.slice(at, stop - at))], strict=True)
                at = stop

        def close() -> pa.RecordBatch:
            null = np.array([k is None for k in keys])
            k = np.array([0 if x is None else x for x in keys], np.int64)
            c = np.array(copy, np.uint32)
            h = key_hash(k, c, null)
            seeds, slots = build_index(h)
            n = np.array([len(p) // width for p in pieces], np.int64)
            offsets, counts, prints = np.empty(len(n), np.int64), np.empty(len(n), np.uint32), np.empty(len(n), np.uint32)
            offsets[slots], counts[slots], prints[slots] = np.cumsum(n) - n, n, fingerprint(h)
            row = [part, seq, None if null.all() else int(k[~null][0]), None if null.all() else int(k[-1]), int(null.sum()), len(n), int(n.sum()), width, b"".join(pieces)]
            row += [x.tobytes() for x in (k, c, seeds, prints, offsets, counts)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], _NAMES)

        for batch in batches:
            for key, piece in encoded(batch):
                if keys and (held + len(piece) // width > shard_ids or len(keys) >= shard_docs):
                    yield close()
                    seq, held = seq + 1, 0
                    keys, copy, pieces = [], [], []
                repeat = repeat + 1 if key == last and type(key) is type(last) else 0
                last = key
                keys.append(key)
                copy.append(repeat)
                pieces.append(piece)
                held += len(piece) // width
        if keys:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(shards, SHARD).write.option("compression", "zstd").parquet(to)


_NAMES = [c.split()[0] for c in SHARD.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SHARD.split(", ")]


# ---- reading -----------------------------------------------------------------------------------------------------


def open_index(row: dict) -> tuple[np.ndarray, ...]:
    """seeds, prints, offsets, counts of a shard."""
    return tuple(np.frombuffer(row[c], t) for c, t in (("seeds", "<i4"), ("prints", "<u4"), ("offsets", "<i8"), ("counts", "<u4")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each document found through the index of its shard: doc_id, copy, start, n_tokens, ids (binary, as stored), ids_crc32.

    Starts come from two small sums: of ids by shard within its part, and of ids by part.
    """
    files = spark.read.schema(SHARD).parquet(path)
    small = files.select("part", "seq", "n_ids")
    parts = small.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    in_part = small.select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("shards_before"))
    base = in_part.join(before, "p").select("p", "s", (F.col("parts_before") + F.col("shards_before")).alias("base"))
    joined = files.join(base, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seeds, prints, offsets, counts = open_index(row)
                keys, copy = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["copy"], "<u4")
                null = np.arange(len(keys)) < row["null_keys"]
                slot = find(key_hash(keys, copy, null), seeds, prints)
                if (slot < 0).any():
                    raise ValueError("a key of the shard isn't in its index")
                at, n, w = offsets[slot], counts[slot].astype(np.int64), row["width"]
                ids = [row["payload"][a * w : (a + m) * w] for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                crc = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(copy.astype(np.int64)), pa.array(row["base"] + at), pa.array(n), pa.array(ids, pa.binary()), pa.array(crc, pa.int64())], ["doc_id", "copy", "start", "n_tokens", "ids", "ids_crc32"])

    return joined.select("base", "null_keys", "width", "payload", "keys", "copy", "seeds", "prints", "offsets", "counts").mapInArrow(documents, "doc_id long, copy long, start long, n_tokens long, ids binary, ids_crc32 long")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one key, one list for each row that had it.

    The key's range picks the shards, their indexes (no payload is read for that) the place, and of the payload only the ids at
    that place come back.
    """
    files = spark.read.schema(SHARD).parquet(path)
    near = files.where((F.col("first_key") <= doc_id) & (F.col("last_key") >= doc_id)).select("part", "seq", "width", "seeds", "prints", "offsets", "counts")
    out: list[list[int]] = []
    for row in near.orderBy("part", "seq").toLocalIterator():
        seeds, prints, offsets, counts = open_index(row.asDict())
        own, w = [], row["width"]
        while (slot := find(key_hash(np.array([doc_id]), np.array([len(out) + len(own)]), np.array([False])), seeds, prints)[0]) >= 0:
            own.append((int(offsets[slot]) * w + 1, int(counts[slot]) * w))
        if own:
            shard = files.where((F.col("part") == row["part"]) & (F.col("seq") == row["seq"]))
            found = shard.select(*[F.substring("payload", at, n).alias(f"c{i}") for i, (at, n) in enumerate(own)]).first()
            out += [np.frombuffer(x, f"<u{w}").tolist() for x in found]
    return out
