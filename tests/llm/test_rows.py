"""Operators that judge, encode, mix or pack each row."""

import collections
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glint.llm import binary_output, language_id, licences, mixing, neighbours, packing, quality_rules, scratch, toxicity
from glint.llm.words import shingle_set, word_hashes
from tests.llm.helpers import ODD, WORD, docs, prose, shingles

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def test_word_hashes(monkeypatch):
    from glint.llm import words

    text = "The the THE é É x y " + prose(1, 500)
    whole = word_hashes(text)
    assert len(whole) == len(WORD.findall(text)) and whole[0] == whole[1] == whole[2] and whole[3] != whole[4]
    monkeypatch.setattr(words, "_BLOCK", 64)
    assert (word_hashes(text) == whole).all()
    for t in ODD:
        assert len(shingle_set(t, 2)) == len(shingles(t, 2))


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    n = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [l for l in text.split("\n") if WORD.search(l)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(spark):
    texts = [*ODD, prose(1), "a b c a b c d", "a a a a", "x\nx\n\n\ny\nx", prose(2, 40) * 2, "## $$ " + prose(3), "a b c " * 30]
    got = {r.doc_id: r for r in quality_rules.judged(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], measured(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    ledger = quality_rules.ledger(docs(spark, texts))
    failed = [r.failed for r in ledger.collect()]
    for r in quality_rules.ablations(ledger).collect():
        mask, bit = quality_rules.mask(quality_rules.POLICIES[r.policy]), quality_rules.mask([r.rule])
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(f & bit > 0 for f in failed), sum(f & mask == bit for f in failed), sum(f & mask & ~bit == 0 for f in failed))
    assert quality_rules.judged(docs(spark, [])).count() == 0


def test_mixing_meets_targets(spark):
    texts = [*ODD, *(prose(i, 20 + i) for i in range(60))]
    sources = [None, "a", "b", "c"] * 20
    df = docs(spark, texts, sources)
    rows = mixing.plan(df, [5, 2, 1]).collect()
    by_text = lambda found: sorted(map(str, map(tuple, found)))
    assert by_text(rows) == by_text(mixing.plan(df.repartition(7), [5, 2, 1]).collect())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert sum(r[0].target for r in by.values()) == pytest.approx(sum(r.size for r in rows))
    for r in by.values():
        assert abs(sum(x.taken for x in r) - r[0].target) < 1 and r[0].target <= 3 * r[0].source_size + 1e-9
        assert all(x.taken <= 3 * x.size for x in r)
    df = df.selectExpr("*", "'a' as taken", "1 as nth", "'x' as c0", "2 as words", "3 as own", "4 as tie")
    mixed = mixing.mixed(df, [5, 2, 1])
    assert mixed.columns == df.columns and {(r.taken, r.nth, r.c0, r.words, r.own, r.tie) for r in mixed.collect()} == {("a", 1, "x", 2, 3, 4)}
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert dict(words) == {s: sum(x.taken for x in r) for s, r in by.items()}
    assert mixing.plan(docs(spark, []), [5, 2, 1]).count() == 0
    assert [r.taken for r in mixing.plan(docs(spark, ["", None]), [5, 2, 1]).collect()] == [0, 0]


def test_targets_are_filled_up_to_their_caps(spark):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 500), ("c", 90), (None, 0)], "source string, source_size long"), [5, 2, 1]).collect()}
    assert got["a"] == 30 and got[None] == 0 and sum(got.values()) == pytest.approx(600) and got["b"] == pytest.approx(380) and got["c"] == pytest.approx(190)


def test_ids_round_trip_and_keyed_access(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, "don't THEY'RE a1b2 ﬁ İ 中文 <|endoftext|> q̈ Straße,", *(prose(i) for i in range(40))]
    df = docs(spark, texts).unionByName(docs(spark, ["again"]))
    path = scratch.new_path(spark, "test-ids")
    binary_output.write(df, path, TOKENS, shard_ids=400)
    tokenizer = Tokenizer.from_file(TOKENS)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    got = sorted(binary_output.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [0, 0, *range(1, len(texts))]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    for r in got[2:]:
        assert np.frombuffer(r.ids, "<u2").tolist() == ids[r.doc_id] and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes())
    assert binary_output.fetch(spark, path, 12) == [ids[12]] and len(binary_output.fetch(spark, path, 0)) == 2 and binary_output.fetch(spark, path, 10**6) == []
    empty = scratch.new_path(spark, "test-ids")
    binary_output.write(docs(spark, []), empty, TOKENS)
    assert binary_output.read(spark, empty).count() == 0


def test_words_of_any_kind_are_encoded_as_the_library_does(monkeypatch):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(binary_output, "CACHE_WORDS", 500)
    rng, tokenizer, encode = random.Random(4), Tokenizer.from_file(TOKENS), binary_output.encoder(TOKENS, 2)
    atoms = [*"aAéÉßÿ÷×.,;:!?'\"#$%&()*+-/<=>@[]\\^_`{|}~09 ", "\t", "\n", "\u00a0", "\u0301", "İ", "ı", "ﬁ", "中", "<|endoftext|>", "<|startoftext|>", "'s", "'RE", "’", "\x1c", "\x85", "ſ", "\u212a", "\u2126", "The", "don't", "\u200b", "😀", "x" * 300]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for at in range(0, 3000, 500):
        got = encode(pa.array([None, *texts[at : at + 500]]).slice(1))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in tokenizer.encode_batch(texts[at : at + 500], add_special_tokens=False)]
    assert encode(pa.array([None, "", " \n"], pa.string())) == [b"", b"", b""]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1000])
def test_perfect_hash(n):
    h = binary_output.key_hash(np.arange(n), np.zeros(n, np.uint32), np.zeros(n, bool))
    seeds, slots = binary_output.build_index(h)
    assert sorted(slots) == list(range(n))
    prints = np.empty(n, np.uint32)
    prints[slots] = binary_output.fingerprint(h)
    assert (binary_output.find(h, seeds, prints) == slots).all()
    other = binary_output.key_hash(np.arange(n, n + 500), np.zeros(500, np.uint32), np.zeros(500, bool))
    assert (binary_output.find(other, seeds, prints) < 0).all()


def test_packing_obeys_its_constraints(spark):
    texts = [*ODD, *(prose(i, 10 + i) for i in range(50)), *[prose(1, 30)] * 40, prose(2, 950)]
    sources = (["a", "a", "b", None] * 40)[: len(texts)]
    rows = packing.pack(docs(spark, texts, sources), capacity=100, per_source=2).collect()
    size, bins = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r.doc_id] += r["size"]
        bins[r.shard, r.bin].append(r)
    assert size == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    for b in bins.values():
        ends = 0
        for r in sorted(b, key=lambda r: (r.start, r["size"])):
            assert r.start == ends or r["size"] == 0
            ends += r["size"]
        assert ends <= 100
        assert max(collections.Counter(" ".join(WORD.findall(texts[r.doc_id] or str(r.doc_id))).lower() for r in b if texts[r.doc_id] is not None).values(), default=0) <= 1
        assert max(collections.Counter(r.source for r in b if r.source).values(), default=0) <= 2
    assert packing.pack(docs(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    b = packing.Bins(10, 1)
    assert b.put(6, 1, 0) == (0, 0) and b.put(5, 2, 0) == (1, 0)
    assert b.put(4, 1, 0) == (1, 5)  # bin 0 is tighter, but has the cluster
    assert b.put(4, 4, 0) == (0, 6)
    b = packing.Bins(10, 1)
    assert b.put(3, 0, 1) == (0, 0) and b.put(3, 0, 1) == (1, 0) and b.put(3, 0, 2) == (0, 3)


def test_packing_equals_a_search_of_all_bins(spark):
    # best fit by its definition: of all bins that hold the piece and are in no conflict, the fullest, and of these the one that got so first
    rng = np.random.default_rng(6)
    texts = [prose(int(rng.integers(30)), int(rng.integers(1, 90))) for _ in range(300)]
    texts = [texts[int(rng.integers(60))] if rng.random() < 0.3 else t for t in texts]
    sources = [[None, "a", "b", "c", "d"][int(rng.integers(5))] for _ in texts]
    got = {r.doc_id: (r.bin, r.start) for r in packing.pack(docs(spark, texts, sources), capacity=100, per_source=2).collect()}
    again = {r.doc_id: (r.bin, r.start) for r in packing.pack(docs(spark, texts, sources).repartition(9).orderBy(F.rand(3)), capacity=100, per_source=2).collect()}
    assert got == again
    plain = [" ".join(WORD.findall(t)).lower() for t in texts]
    hashed = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "i long, t string").select("i", F.xxhash64("t")).collect()
    shared = {h for h, n in collections.Counter(h for _, h in hashed).items() if n > 1}
    rank = {h: k for k, h in enumerate(sorted(shared))}
    order = sorted(hashed, key=lambda x: (-len(WORD.findall(texts[x[0]])), rank.get(x[1], -1), ["", "a", "b", "c", "d"].index(sources[x[0]] or ""), x[0]))
    bins, since, want = [], [], {}
    for step, (i, h) in enumerate(order):
        n = len(WORD.findall(texts[i]))
        used = [sum(x[0] for x in b) for b in bins]
        fits = [k for k, b in enumerate(bins) if used[k] + n <= 100 and used[k] < 100 and h not in {x[1] for x in b} and (sources[i] is None or [x[2] for x in b].count(sources[i]) < 2)]
        k = min(fits, key=lambda k: (100 - used[k], since[k])) if fits else len(bins)
        if k == len(bins):
            bins.append([])
            since.append(0)
        want[i] = (k, sum(x[0] for x in bins[k]))
        bins[k].append((n, h, sources[i]))
        since[k] = step
    assert got == want


def test_language_id(spark):
    letters = {"aa": "abcde", "bb": "vwxyz"}
    rng = np.random.default_rng(0)
    make = lambda l: " ".join("".join(rng.choice(list(letters[l]), 5)) for _ in range(40))
    langs = ["aa", "bb", None] * 40
    texts = [make(l or "aa") for l in langs]
    df = docs(spark, [*ODD, *texts], langs=[None] * len(ODD) + langs).selectExpr("*", "1 as of", "2 as share", "3 as h", "4 as count")
    model = language_id.fit(df, ~language_id.held_out(), per_language=20)
    got = {r.doc_id: r for r in language_id.predict(df, model, "doc_id").collect()}
    assert all(got[i + len(ODD)].lang_pred == (l or "aa") for i, l in enumerate(langs))
    assert all(0 <= r.score <= 1 for r in got.values())
    for i, t in enumerate(ODD):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    nothing = language_id.fit(docs(spark, []), ~language_id.held_out())
    assert {r.lang_pred for r in language_id.predict(df, nothing, "doc_id").collect()} == {"und"}
    assert language_id.counts("ab" * 10).sum() == language_id.counts("AB" * 10).sum()


def test_toxicity_learns_words_and_grades(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{i}" for i in "abcdefghijklmnopqrstuvwxyz"]
    texts, labels = list(ODD), []
    for i in range(300):
        bad = i % 4 == 0
        words = [str(w) for w in rng.choice(plain, 40)]
        for _ in range((1, 3, 9)[i % 3] if bad else 0):
            words[rng.integers(40)] = str(rng.choice(["vile", "Nasty,"]))
        texts.append(" ".join(words))
        labels.append((len(ODD) + i, int(bad)))
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, texts), table)
    got = {r.doc_id: r for r in toxicity.score(docs(spark, texts), model).collect()}
    assert all(got[i].toxic == bool(t) for i, t in labels) and not any(got[i].toxic for i in range(len(ODD)))
    mean = lambda k: np.mean([got[i].expected_severity for i, t in labels if t and (i - len(ODD)) % 3 == k])
    assert mean(0) < mean(2) and (np.diff(model.theta) > 0).all()
    none = toxicity.fit(docs(spark, texts), table.where("false"))
    assert {r.toxic for r in toxicity.score(docs(spark, texts), none).collect()} == {False}


def test_licences(spark):
    notices = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "apache": "Licensed under the Apache License, Version 2.0."}
    texts = [*ODD, *(prose(i) for i in range(60)), *(f"{prose(i)}\n{notices[f]}" for i, f in enumerate(list(notices) * 3)), prose(7, 400) + " " + notices["gpl"] + " " + prose(8, 300)]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in licences.scan(df, licences.fit(df)).collect()}
    n = len(ODD) + 60
    assert len(got) == len(texts) and all(got[i].licence == "unknown" for i in range(n))
    assert [got[n + i].licence for i in range(9)] == list(notices) * 3 and all(got[n + i].confirmed for i in range(9))


def test_wrapped_licences(spark):
    whole = {f: licences.TEMPLATES[f][1] for f in ("gpl", "mit")}
    wrapped = [(f, mark.join(["", *textwrap.wrap(w, 72)]).strip("\n")) for f, w in whole.items() for mark in ("\n", "\n# ")]
    texts = [*(prose(i) for i in range(60)), *(f"{prose(i, 20)}\n \n{w}\n\n{prose(i + 9, 20)}" for i, (_, w) in enumerate(wrapped))]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in licences.scan(df, licences.fit(df)).collect()}
    assert [got[60 + i].licence for i in range(4)] == [f for f, _ in wrapped] and all(got[i].licence == "unknown" for i in range(60))
    assert all(got[60 + i].n_paragraphs == 1 for i in range(4))


def test_neighbours_have_good_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    v[50] = v[51]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("vector", F.lit("x"))
    out = neighbours.search(df, F.col("id") % 20 == 0).collect()
    by = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append(r)
    hits = 0
    assert sorted(by) == list(range(0, 600, 20))
    for q, found in by.items():
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(600), -s))[:20]) & {r.vec_id for r in found})
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in found)
        assert found == sorted(found, key=lambda r: (-r.score, r.vec_id))
    assert hits >= 0.9 * 20 * len(by)
    assert neighbours.search(df.where("false"), F.col("id") % 20 == 0).count() == 0
