"""Near-duplicates, line dedup and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.llm import line_dedup, linking, near_dups, scratch
from glint.llm.words import shingle_set
from tests.llm.helpers import ODD, components, docs, edit_distance, prose, shingles


def mutated(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def touched(line, rng):
    at = rng.randrange(len(line))
    return line if rng.random() < 0.4 else line[:at] + rng.choice("xyz") + line[at + rng.randrange(2) :]


def corpus():
    rng = random.Random(3)
    texts = list(ODD)
    for g in range(6):
        base = prose(g)
        texts += [base, base.upper(), *(mutated(base, rng, rng.randrange(1, 8)) for _ in range(8))]
    big = prose(99, 80)
    texts += [mutated(big, rng, rng.randrange(1, 5)) for _ in range(90)]  # a long inverted list
    return texts


def equal_brute_force(spark, texts, size):
    sets = [shingles(t, size) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(range(len(texts)), links)
    got = {r.doc_id: r for r in near_dups.find(docs(spark, texts), size).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    return links


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    equal_brute_force(spark, corpus(), size)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("common", [near_dups.COMMON, 300])
def test_large_groups_of_copies_with_words_of_their_own(spark, seed, common, monkeypatch):
    # templates with copies that append, lose, replace and mix words, so that many pairs are just above or below the threshold
    monkeypatch.setattr(near_dups, "COMMON", common)
    monkeypatch.setattr(near_dups, "BLOCK", 50)
    rng = random.Random(seed)
    texts, own = [], lambda i, n: "".join(f" own{i}x{k}" for k in range(n))
    for t in range(3):
        base = prose(100 * seed + t, 300)
        words = base.split()
        texts += [mutated(base, rng, rng.randrange(1, 40)) for _ in range(60)]
        texts += [base + own(f"{t}y{i}", rng.randrange(60, 76)) for i in range(60)]
        texts += [" ".join(words[: rng.randrange(220, 300)]) + own(f"{t}z{i}", rng.randrange(0, 30)) for i in range(40)]
        texts += [" ".join(w for w in words if rng.random() > 0.1) for _ in range(40)]
        short = prose(100 * seed + t, 12)
        texts += [mutated(short, rng, rng.randrange(2)) + own(f"{t}s{i}", rng.randrange(3)) for i in range(30)]
    assert len(equal_brute_force(spark, texts, 2)) > 500


def test_near_copies_with_text_of_their_own_in_a_large_group(spark):
    # each is linked with the base alone, and what they share is in long lists
    rng = random.Random(11)
    base = prose(42, 120)
    texts = [prose(7), *(base + "".join(f" own{i}x{k}" for k in range(rng.randrange(18, 25))) for i in range(200)), base]
    sets = [shingles(t, 2) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in near_dups.find(docs(spark, texts), 2).collect()}
    assert len(links) >= 200 and got == components(range(len(texts)), links)


def test_copies_of_texts_with_near_copies(spark, monkeypatch):
    # what copies have alone counts once, though the sample doesn't know it
    monkeypatch.setattr(near_dups, "COMMON", 1)
    texts = []
    for g in range(4):
        base = prose(g, 100)
        texts += [base + "".join(f" own{g}{t}{i}" for i in range(8)) for t in "aaaaabbbb"] + [base]
    assert equal_brute_force(spark, [*texts, *(prose(50 + i) for i in range(5))], 2)


def test_values_of_copies_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "COMMON", 1)
    write, rows = scratch.cut, {}

    def cut(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(scratch, "cut", cut)
    base = prose(5, 200)
    near_dups.find(docs(spark, [base + " end"] * 30 + [base + " of it"] * 30), 2)
    assert 0 < rows["values"] <= 2 * len(shingles(base, 2)) + 4


def test_written_tables_have_small_row_groups(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(scratch, "GROUP", 1 << 20)
    out = scratch.cut(spark.range(0, 600_000, 1, 1).select(F.xxhash64("id").alias("h")), "groups")
    for f in out.inputFiles():
        m = __import__("pyarrow.parquet").parquet.ParquetFile(f.removeprefix("file://")).metadata
        seen += [m.row_group(i).total_byte_size for i in range(m.num_row_groups)]
    assert len(seen) > 2 and max(seen) < 2 << 20 and out.agg(F.countDistinct("h")).first()[0] == 600_000
    read = "spark.sql.parquet.columnarReaderBatchSize"
    before = int(spark.conf.get(read))
    with scratch.small_batches(spark):
        assert int(spark.conf.get(read)) <= 1024 < before
    assert int(spark.conf.get(read)) == before


def test_a_link_is_kept_whatever_its_sketch_says(spark):
    # 50 of 250 values differ, and nearly all of these are among the 64 smallest
    words = [f"word{i}" for i in range(201)]
    own = list(words)
    for i in range(50):
        own.append(next(w for w in (f"own{i}x{k}" for k in range(100_000)) if shingle_set(f"{own[-1]} {w}", 2)[0] < 1 << 58))
    texts = [" ".join(words), " ".join(own), prose(3)]
    low = [set(shingle_set(t, 2)[: near_dups.SKETCH].tolist()) for t in texts[:2]]
    union = set(sorted(low[0] | low[1])[: near_dups.SKETCH])
    assert len(union & low[0] & low[1]) < 20 and equal_brute_force(spark, texts, 2) == [(1, 0)]


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert near_dups.find(docs(spark, [])).count() == 0
    df = docs(spark, [prose(1), prose(1)]).unionByName(docs(spark, [prose(1)])).withColumn("doc_id", __import__("pyspark").sql.functions.expr("if(doc_id = 1, null, doc_id)"))
    got = near_dups.find(df).collect()
    assert len(got) == 3 and sorted(str(r.component_id) for r in got) == ["0", "0", "None"]


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, write, seen = spark.conf.get(rows), scratch.cut, {}

    def cut(df, name):
        seen[name] = int(spark.conf.get(rows))
        return write(df, name)

    monkeypatch.setattr(scratch, "cut", cut)
    near_dups.find(docs(spark, corpus()), 2)
    assert max(seen["sets"], seen["full"]) <= 1024 < int(before) and spark.conf.get(rows) == before

    def sizes(batches):
        for b in batches:
            yield b.slice(0, 1).set_column(0, "id", __import__("pyarrow").array([b.num_rows]))

    with scratch.small_batches(spark):
        got = [r.id for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "id long").collect()]
    assert sum(got) == 5000 and max(got) <= 1024 and spark.conf.get(rows) == before


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    ids = {x for l in links for x in l}
    want = components(ids, links)
    got = {r.id: r.root for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for i in got} and {i for i in ids if want[i] != i} <= set(got)


def test_banded_distance_equals_the_full_matrix():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        for most in (1, 2):
            assert line_dedup.within(a, b, most) == (edit_distance(a, b) <= most), (a, b, most)


def test_linked_lines_share_a_key():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(15, 60)))
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b))
            rng.choice([lambda: b.insert(at, "z"), lambda: b.pop(at), lambda: b.__setitem__(at, "z")])()
        b = "".join(b)
        short = min(len(a), len(b))
        if short < line_dedup.LEAST or edit_distance(a, b) > line_dedup.edits(short) or a == b:
            continue
        k, own, index = line_dedup.keys(np.array([1, 2]), [a, b])
        posted, asked = ({x for x, o, p in zip(k, own, index) if o == i and (p or not only)} for i, only in ((1, True), (2, False)))
        posted2, asked2 = ({x for x, o, p in zip(k, own, index) if o == i and (p or not only)} for i, only in ((2, True), (1, False)))
        assert posted & asked or posted2 & asked2, (a, b)


def test_line_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linking, "LONG", 4)
    rng = random.Random(8)
    base = [prose(i, 6) for i in range(8)] + ["short line 1", "exactly 15 chars"[:15], "exactly 16 chars", "x"]
    texts = [None, "", "\n"] + ["\n".join(touched(l, rng) if len(l) > 12 else l for l in rng.sample(base, 4)) for _ in range(25)]
    lines = [(i, p, l) for i, t in enumerate(texts) if t is not None for p, l in enumerate(t.split("\n")) if l.strip()]
    different = sorted({l for *_, l in lines})
    links = [(a, b) for b in range(len(different)) for a in range(b) if edit_distance(different[a], different[b]) <= line_dedup.edits(min(len(different[a]), len(different[b])))]
    cls = components(range(len(different)), links)
    seen, keep = set(), {}
    for i, p, l in sorted(lines):
        c = cls[different.index(l)]
        keep[i, p] = c not in seen
        seen.add(c)
    got = {(r.doc_id, r.pos): r.kept for r in line_dedup.classes(docs(spark, texts)).collect()}
    assert got == keep and links
    n = {r.doc_id: (r.n_lines, r.n_kept) for r in line_dedup.summary(docs(spark, texts)).collect()}
    assert n == {i: (sum(k[0] == i for k in keep), sum(v for k, v in keep.items() if k[0] == i)) for i in range(len(texts))}
    clean = {r.doc_id: r.text for r in line_dedup.cleaned(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        rest = None if t is None else "\n".join(l for p, l in enumerate(t.split("\n")) if keep.get((i, p), True))
        assert clean.get(i, "gone") == (rest if rest == t or rest.strip() else "gone")


def test_rows_that_repeat_a_document(spark):
    shared, alone = prose(1, 8), prose(2, 8)
    rows = [(1, shared), (5, shared), (5, alone), (5, alone), (7, "own line of seven\nno"), (7, "own line of seven\nno"), (8, "no"), (9, " "), (9, " "), (None, shared), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit("x")).withColumn("h", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("copies", F.lit(3))
    out = line_dedup.cleaned(df)
    assert out.columns == df.columns and {(r.gone, r.h, r.c0, r.copies) for r in out.collect()} == {("x", 1, 2, 3)}
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("1", shared), ("5", alone), ("7", "own line of seven\nno"), ("9", " "), ("9", " "), ("None", shared), ("None", shared)])
    got = sorted((str(r.doc_id), r.n_lines, r.n_kept, r.n_exact) for r in line_dedup.summary(df).collect())
    assert got == sorted([("1", 1, 1, 0), ("5", 1, 0, 1), ("5", 1, 1, 0), ("5", 1, 0, 1), ("7", 2, 2, 0), ("7", 2, 0, 2), ("8", 1, 0, 1), ("9", 0, 0, 0), ("9", 0, 0, 0), ("None", 0, 0, 0), ("None", 0, 0, 0)])


def test_links_of_long_lists_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linking, "LONG", 4)
    rng = random.Random(9)
    bases = [prose(i, 6) for i in range(2)]
    lines = sorted({touched(bases[i % 2], rng) for i in range(60)})
    want = {i: sum(x != y and edit_distance(x, y) <= line_dedup.edits(min(len(x), len(y))) for y in lines) for i, x in enumerate(lines)}
    got = {r.doc_id: r.n_links for r in line_dedup.summary(docs(spark, lines)).collect()}
    assert got == want and max(want.values()) > 4


def test_no_lines(spark):
    assert line_dedup.summary(docs(spark, [])).count() == 0
    assert [r.n_lines for r in line_dedup.summary(docs(spark, [None])).collect()] == [0]
