"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glint.llm import spelling
from tests.llm.helpers import FOLD, ODD, docs, edit_distance


def plain(rows):
    n = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w, c in n.items():
        near = [v for v in n if abs(len(v) - len(w)) < 2 and edit_distance(v, w) == 1]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 2 * c else None, c, len(near))
    found = set()
    for w, (form, c, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        found.add((w, form, root, c, near, n[form] if form else None))
    return found


def texts():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeéÉÿ") for _ in range(rng.randrange(4, 9))) for _ in range(30)]

    def edited(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abcéÀ") + w[i + 1 :], w[:i] + rng.choice("abc") + w[i:]])

    return [" ".join(edited(rng.choice(stems)).upper() if rng.random() < 0.1 else edited(rng.choice(stems)) for _ in range(rng.randrange(60))) + "." for _ in range(150)]


@pytest.mark.parametrize("bound", [1 << 28, 1 << 11])
def test_variants_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(spelling, "BOUND", bound)
    long = "q" * 3000
    some = [*ODD, *texts(), " ".join([long, long[1:], long[2:] + "r"] * 3), "aaaaab-aaaab_aaaaab×aaaaab÷ ÀÀÀÀÀ ààààà " * 3, "colour color colours " * 4]
    df = docs(spark, some)
    df = df.union(df.where("doc_id = 20")).union(df.where("doc_id = 21").withColumn("doc_id", df["doc_id"] * None)).selectExpr("*", "1 as word", "2 as len", "3 as root", "4 as a")
    found = [tuple(r) for r in spelling.variants(df).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain([(r["doc_id"], r["text"]) for r in df.collect()])


def test_hash_of_an_edit_is_that_of_the_word():
    word = "aébcÿd"
    ids = lambda w: spelling.mix(spelling._sums(spelling._codes([w]))[:, -1])[0]
    everything = {n: np.full(1, 2**64 - 1, np.uint64) for n in (5, 6)}  # filters that know every word
    hits = {(int(y), gone) for _, edits, _, d in spelling._hits([word], everything, 0, 1) for y, gone in zip(edits, d, strict=True)}
    deleted = {(int(ids(word[:i] + word[i + 1 :])), True) for i in range(6)}
    replaced = {(int(ids(word[:i] + chr(c) + word[i + 1 :])), False) for i in range(6) for c in spelling.ALPHABET.tolist() if c > ord(word[i])}
    assert hits == deleted | replaced


def test_no_words(spark):
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [None, "", "abcde abcde", "abcd " * 9])).count() == 0
