"""Line dedup by a segment-partition edit join.

Lines with a word are compared. Two are linked if they are equal, or within ``edits(n)`` edits (code points inserted, deleted or
replaced), n being the shorter length: one for each ``LEAST`` code points, at most ``EDITS``, so lines under ``LEAST`` must be equal.
A line of n code points is split into edits(n) + 1 segments; of two linked lines, the longer has one of the shorter's
segments at nearly the same place. So each line posts its segments under (length, segment number, hash), and probes for
each length that it could be linked with the few substrings that can be such a segment (those where the edits left and
right of the match suffice). Lines that share a key and whose counts of code points (in ``BUCKETS`` classes) are near enough
are pairs, and these are verified by bit-parallel edit distance in a band of 2 * EDITS + 1 diagonals.

Equal lines are one node, known by a 64-bit hash. Linked lines form classes (components); of each class the first
occurrence, by doc_id, the text's hash and line number, is kept and all others are dropped. Keys that more than
``linking.LONG`` lines post are joined in blocks of so many, a task for each block, where links are counted; where only classes
are asked for, by stars and then across components (see ``linking``). A line that makes up a large share of all is dealt to
``SALT`` tasks where occurrences are looked up.

Defined cases: lines without a word and lines of rows without a doc_id are kept; null texts have no lines; rows that repeat a
doc_id with another text are documents of their own; of rows that repeat both, the first keeps its lines and all lines
of the others are copies; lines end at \\n only; an empty table gives an empty result; further columns, whatever their
names, are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glint.llm import linking, scratch
from glint.llm.words import _BASE, _power, mix

LEAST = 15
EDITS = 2
BUCKETS = 32
HOT = 256
SALT = 64
_BLOCK = 1 << 20
_M = 1 << 64
_WORD = r"[^\x20\x09-\x0D]"


def edits(n):
    """Edits allowed for a line of n code points (a number or an array)."""
    return np.minimum(EDITS, n // LEAST)


def windows(t: int, delta: int) -> list[tuple[int, int]]:
    """(segment, shift) of the substrings to probe: the segment's place in a line shorter by delta, moved by shift."""
    out = []
    for i in range(t + 1):
        for shift in range(-t, t + 1):
            if abs(shift) <= i and abs(shift - delta) <= t - i:
                out.append((i, shift))
    return out


def segments(n: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the t + 1 segments of lines of n code points; the later ones are longer by one where n isn't divisible."""
    parts = t + 1
    base, more = n // parts, n % parts
    i = np.arange(parts)[:, None]
    length = base + (i >= parts - more)
    return np.cumsum(length, 0) - length, length


def keys(hashes: np.ndarray, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, line hashes and whether each is a posted segment (else a probe), for different lines of at least LEAST code points."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(n) - n
    up, down = _power(len(codes))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)))
    out: list[tuple] = []
    for t in range(1, EDITS + 1):
        for delta in range(t + 1):
            pick = np.flatnonzero((n - delta >= LEAST) & (edits(n - delta) == t))
            if not len(pick):
                continue
            size = n[pick] - delta
            at, length = segments(size, t)
            for i, shift in windows(t, delta):
                first = at[i] + shift
                fits = (first >= 0) & (first + length[i] <= n[pick])
                lo = start[pick] + np.where(fits, first, 0)
                h = (total[lo + np.where(fits, length[i], 0)] - total[lo]) * down[lo]
                k = mix(mix(h) + size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(i * 0xC2B2AE3D27D4EB4F % _M))
                out.append((k[fits], hashes[pick][fits], np.full(int(fits.sum()), delta == 0 and shift == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool))


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``.

    After equal ends are cut off, the vertical differences of the distance matrix are kept for a band of 2 * most + 1
    rows around the diagonal, a bit for each row; a column is a few operations on one small integer.
    """
    if abs(len(a) - len(b)) > most:
        return False
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return max(len(a), len(b)) <= most
    width = 2 * most + 1
    full = (1 << width) - 1
    # bit r of column j is row j + r - most; rows above the first are held at falling distances, so that they never help
    plus, minus, score = (full << most) & full, full >> (width - most), most
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    for j, c in enumerate(b):
        # rows j - most .. j + most of a, counted from 0
        window = places.get(c, 0) << most
        match = (window >> j) & full
        zero = ((((match & plus) + plus) ^ plus) | match | minus) & full
        right, left = (minus | ~(zero | plus)) & full, plus & zero
        # along the diagonal a cell is equal to or one above the last; the band's last row is the one followed
        score += 0 if zero >> (width - 1) & 1 else 1
        plus, minus = (left | ~((zero >> 1) | right)) & full, (zero >> 1) & right & full
        if score > 2 * most + max(0, len(b) - len(a)) + most:
            return False
    # from the band's last row (beyond the end of a, if need be) up to row len(a)
    row, value = len(b) + most, score
    while row > len(a):
        bit = row - len(b) + most - 1
        value -= (plus >> bit & 1) - (minus >> bit & 1)
        row -= 1
    return value <= most


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), pos, line and its id, for each line with a word."""
    text = F.col("text").cast("string")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(_WORD)).withColumn("id", F.xxhash64("line"))


def _copies(docs: DataFrame) -> DataFrame:
    """doc_id, h and how many rows have them."""
    return docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h")).agg(F.count("*").alias("copies"))


def _posts(lines: DataFrame) -> DataFrame:
    """(key, id, index) for each different line of a task's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            texts = batch.column(1).take(pa.array(first)).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= _BLOCK):
                    size += len(texts[end])
                    end += 1
                k, own, index = keys(ids[at:end], texts[at:end])
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(own), pa.array(index)], ["key", "id", "index"])
                at = end

    return lines.select("id", "line").mapInArrow(run, "key long, id long, index boolean")


def _texts(posts: DataFrame, lines: DataFrame) -> DataFrame:
    """id, line, and how many of its code points fall in each of BUCKETS classes, for the lines that share a key with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.bincount(np.frombuffer(t.as_py().encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS, minlength=BUCKETS).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], ["id", "line", "h"])

    # the ids grow with the input, so their join is never a broadcast; equal lines are one before they meet
    ids = posts.select("id").distinct()
    own = linking.sift(lines.select("id", "line"), "id", ids).groupBy("id").agg(F.first("line").alias("line"))
    return own.join(ids.hint("merge"), "id", "left_semi").mapInArrow(run, "id long, line string, h array<int>")


#: An edit changes at most two of the counts by one.
_CLOSE = f"aggregate(zip_with(ha, hb, (x, y) -> abs(x - y)), 0, (s, v) -> s + v) <= {2 * EDITS}"


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of line hashes within the allowed edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within(x, y, int(edits(min(len(x), len(y))))) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    a, b = (texts.select(F.col("id").alias(c), F.col("line").alias(f"t{c}"), F.col("h").alias(f"h{c}")) for c in "ab")
    near = pairs.join(a, "a").join(b, "b").where(_CLOSE).select("a", "b", "ta", "tb")
    return scratch.cut(near.mapInArrow(run, "a long, b long"), "line-links")


def _met(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """The pairs (a, b) of posted segments and of all entries with the same key that can be links."""
    left, right = left.select(*on, F.col("id").alias("a"), F.col("h").alias("ha")), right.select(*on, F.col("id").alias("b"), "index", F.col("h").alias("hb"))
    return left.join(right, list(on)).where(f"a <> b and (not index or a < b) and {_CLOSE}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _met_in_blocks(posts: DataFrame, many: DataFrame) -> DataFrame:
    """All pairs of the long lists: the posted segments of a key are dealt to blocks of about LONG, each of which meets all entries."""
    dealt = posts.join(many.select("key", F.ceil(F.col("c") / linking.LONG).alias("blocks")), "key")
    left = dealt.where("index").withColumn("block", F.pmod("id", "blocks"))
    return _met(left, dealt.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))), "key", "block")


def classes(docs: DataFrame, counted: bool = True) -> DataFrame:
    """doc_id, h (hash of the text), pos, id (the line's hash), n_links, class, kept, exact for each compared line; exact: a copy of a line that stands before it.

    n_links are all links of the line with other texts; null if not ``counted``, which doesn't make pairs whose class is known.
    """
    lines = _lines(docs)
    key = Window.partitionBy("key")
    posts = _posts(lines.where(F.length("line") >= LEAST)).withColumn("lo", F.min("id").over(key)).withColumn("hi", F.max("id").over(key)).withColumn("posted", F.sum(F.col("index").cast("int")).over(key))
    posts = scratch.cut(posts.where("lo <> hi and posted > 0").select("key", "id", "index").distinct(), "line-posts")
    texts = scratch.cut(_texts(posts, lines), "line-texts")
    bare, posts = posts, scratch.cut(posts.join(texts.select("id", "h"), "id"), "line-posts")
    scratch.drop(bare)
    many = posts.where("index").groupBy("key").agg(F.count("*").alias("c")).where(f"c > {linking.LONG}")
    short, long = posts.join(many, "key", "left_anti"), posts.join(many, "key", "left_semi")
    links = _verified(_met(short.where("index"), short, "key"), texts)
    long = scratch.cut(long, "line-long")
    if counted and not long.isEmpty():
        links = links.union(_verified(_met_in_blocks(long, many), texts))
    elif not long.isEmpty():
        links = links.union(_verified(linking.star(long), texts))
        links = links.union(_verified(linking.across(long, linking.components(links), ("h",), _CLOSE), texts))
    links = scratch.cut(links.distinct(), "line-links")
    for done in (posts, texts, long):
        scratch.drop(done)
    roots = linking.components(links)
    degree = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    first = lines.groupBy("id").agg(F.min(F.struct("doc_id", "h", "pos")).alias("first"), F.count("*").alias("c"))
    named = scratch.cut(first.join(roots, "id", "left").join(degree, "id", "left").select("id", "first", "c", F.coalesce("root", "id").alias("class"), (F.coalesce("n_links", F.lit(0)) if counted else F.lit(None).cast("long")).alias("n_links")), "line-classes")
    keeper = named.groupBy("class").agg(F.min("first").alias("keeper"), F.count("*").alias("texts"))
    # a class of one line keeps its own first occurrence, so only the others need the keeper
    shared = named.join(keeper.where("texts > 1"), "class", "left").select("id", "c", "class", "n_links", "first", F.coalesce("keeper", "first").alias("keeper"))
    total = named.agg(F.sum("c")).first()[0] or 0
    hot = F.col("c") * HOT > total  # so many lines can't be more than HOT
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALT))).otherwise(F.lit(0).cast("long"))
    dealt = lines.select("doc_id", "h", "pos", "id").join(F.broadcast(named.where(hot).select("id", F.lit(True).alias("hot"))), "id", "left").withColumn("salt", salt)
    shared = shared.withColumn("salt", F.explode(F.when(hot, F.expr(f"sequence(0L, {SALT - 1}L)")).otherwise(F.expr("array(0L)"))))
    here = F.struct("doc_id", "h", "pos")
    return dealt.join(shared, ["id", "salt"]).select("doc_id", "h", "pos", "id", "n_links", "class", (here == F.col("keeper")).alias("kept"), (here != F.col("first")).alias("exact"))


def summary(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_lines compared, n_kept, n_exact and n_near (dropped as copies, as near copies), n_links and class_id.

    n_links sums the links of its lines with other texts; class_id is the class of its first compared line.
    """
    found = classes(docs)
    n = lambda c: F.count_if(c).alias
    by_doc = found.groupBy("doc_id", "h").agg(
        F.count("*").alias("n_lines"), n(F.col("kept"))("n_kept"), n(~F.col("kept") & F.col("exact"))("n_exact"), n(~F.col("kept") & ~F.col("exact"))("n_near"), F.sum("n_links").alias("n_links"), F.min_by("class", "pos").alias("class_id")
    )
    rows = _copies(docs).join(by_doc, ["doc_id", "h"], "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    # rows that repeat a document have each its lines once, and those after the first only copies
    one = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_lines", "n_kept", "n_exact", "n_near", "n_links")}
    one = {c: F.floor(v / F.col("copies")) for c, v in one.items()}
    later = {**one, "n_kept": F.lit(0), "n_exact": one["n_lines"], "n_near": F.lit(0)}
    return rows.select("doc_id", *[F.when(F.col("nth") == 1, one[c]).otherwise(later[c]).cast("long").alias(c) for c in one], "class_id")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs without the dropped lines, and without the documents that had words and have none left."""
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    text = F.col(at["text"]).cast("string")
    dropped = classes(docs, counted=False).groupBy("doc_id", "h").agg(F.collect_list(F.when(~F.col("kept"), F.col("pos"))).alias("gone"), F.count_if("kept").alias("left")).where("size(gone) > 0")
    dropped = scratch.cut(dropped, "line-dropped")
    again = _copies(docs.where(F.col("text").cast("string").rlike(_WORD) & F.col("doc_id").isNotNull())).where("copies > 1")
    marked = dropped.join(again, ["doc_id", "h"], "full")
    joined = rows.withColumn("h", F.xxhash64(text)).withColumn("doc_id", F.col(at["doc_id"]).cast("long")).join(marked, ["doc_id", "h"], "left")
    joined = joined.where("left is null or left > 0")
    held = [*rows.columns, "gone"]
    # of rows that repeat a document one is left, and they meet only after each task has chosen one
    one = joined.where("copies > 1").groupBy("doc_id", "h").agg(F.min_by(F.struct(*held), F.xxhash64(F.to_json(F.struct(*rows.columns)))).alias("r")).select("r.*")
    joined = joined.where("copies is null").select(*held).union(one)
    # the lines are split once for a text: they are a variable of the outer function
    rest = F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn("rest", F.when(F.col("gone").isNotNull(), F.get(rest, F.lit(0))))
    new = {"text": F.coalesce("rest", text), "n_chars": F.coalesce(F.length("rest"), F.col(at["n_chars"])) if "n_chars" in at else None}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(at[c])).alias(c) for c in names])
