"""The Merkle manifest against a plain version, and its layout against a recursive one."""

import hashlib
import zlib

import numpy as np
import pytest

from glint.llm import merkle
from tests.llm.helpers import ODD, docs


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H(*[frame(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def grow(level, i):
    """Root of a level, and the siblings of its node i up to it with i's place in each run."""
    path = []
    while len(level) > 1:
        run = level[i - i % 3 : i - i % 3 + 3]
        path.append((run[: i % 3], run[i % 3 + 1 :]))
        level, i = [H(*level[k : k + 3]) for k in range(0, len(level), 3)], i // 3
    return level[0], path


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))
    levels = {s: [leaf(r, r["text"]) for r in sorted(trees[s], key=key)] for s in sources}
    subroots = [grow(levels[s], 0)[0] for s in sources]
    out = []
    for at, s in enumerate(sources):
        for i, r in enumerate(sorted(trees[s], key=key)):
            subroot, path = grow(levels[s], i)
            root, top = grow(subroots, at)
            proof = H(*[x for a, b in path + top for x in a + b])
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            v = leaf(r, text)
            for a, b in path + top:
                v = H(*a, v, *b)
            out.append((r["doc_id"], levels[s][i], subroot, root, proof, v, v == root))
    return out


def test_addresses_follow_the_recursive_layout():
    def laid_out(height):
        """(depth, index) in van Emde Boas order."""
        if height == 0:
            return [(0, 0)]
        upper = (height + 1) // 2
        out = laid_out(upper - 1)
        for tree in range(3**upper):
            out += [(d + upper, tree * 3**d + i) for d, i in laid_out(height - upper)]
        return out

    for height in range(6):
        order = laid_out(height)
        assert len(order) == merkle.size(height)
        assert [int(merkle.address(height, d, np.array(i))) for d, i in order] == list(range(len(order)))


@pytest.mark.parametrize("height", [1, 2, 7])
def test_verify_equals_a_plain_tree(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "LEAVES", 3**height)
    texts = [*ODD, *[f"line {i}\nof {i}" if i % 3 else f"no break {i}" for i in range(90)], "y\n" * 100_000]
    sources = [None if i % 9 == 0 else "a" if i % 3 else "lone" if i == 5 else f"é{i % 4}" for i in range(len(texts))]
    df = docs(spark, texts, sources)
    one = df.where("doc_id in (12, 13)")
    df = df.union(one).union(one.withColumn("doc_id", one["doc_id"] * None)).selectExpr("*", "'t' as tree", "1 as digest", "2 as block", "3 as seen")
    rows = [r.asDict() for r in df.collect()]
    found = [tuple(r) for r in merkle.verify(df, merkle.without_newlines()).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted(found, key=order) == sorted(plain(rows), key=order)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_nothing_and_of_one_leaf(spark):
    assert merkle.verify(docs(spark, []), merkle.without_newlines()).count() == 0
    only = merkle.verify(docs(spark, ["a\nb"])).first()
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"] and only["proof_sha256"] == H() and only["verified"]
