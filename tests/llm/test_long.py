"""Texts of several MB through every operator, and the permutation index over several shards and blocks."""

import collections

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glint.llm import binary_output, language_id, licences, line_dedup, merkle, mixing, near_dups, neighbours, packing, quality_rules, scratch, spelling, toxicity
from tests.llm.helpers import docs, prose


@pytest.fixture(scope="module")
def long(spark):
    words = prose(1, 400_000)  # about 3 MB
    lines = "\n".join(prose(i, 12, ("north", "south", "east", "west", "river", "stone", "cloud", "grass")) for i in range(20_000))
    texts = [words, words + " end", lines, "x" * 3_000_000, *[prose(i, 60) for i in range(50, 60)]]
    assert min(map(len, texts[:4])) > 1_500_000
    return docs(spark, texts, ["a", "b"] * 7, ["en"] * 14).cache()


def test_long_texts_are_read_whole(spark, long):
    n = 14
    near = {r["doc_id"]: r for r in near_dups.find(long, 2).collect()}
    assert len(near) == n and near[1]["component_id"] == 0 and near[2]["component_id"] == 2 and near[3]["n_shingles"] == 1
    rules = {r["doc_id"]: r for r in quality_rules.judged(long).collect()}
    assert rules[0]["n_words"] == 400_000 and rules[3]["word_chars"] == 3_000_000
    lines = {r["doc_id"]: r for r in line_dedup.summary(long).collect()}
    assert lines[2]["n_lines"] == 20_000 and lines[0]["n_lines"] == 1
    plan = {r["doc_id"]: r for r in mixing.plan(long, [5, 2, 1]).collect()}
    assert plan[0]["size"] == 400_000 and plan[3]["size"] == 1
    assert {r["doc_id"] for r in packing.pack(long).collect()} == set(range(n))
    model = language_id.fit(long, F.lit(True))
    assert language_id.predict(long, model, "doc_id").count() == n
    path = scratch.new_path(spark, "ids")
    binary_output.write(long, path, public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["n_tokens"] > 100_000 for r in binary_output.read(spark, path).collect()}[0]
    assert licences.scan(long, licences.fit(long)).count() == n
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")
    assert toxicity.score(long, toxicity.fit(long, labels)).count() == n
    proofs = merkle.verify(long, merkle.without_newlines()).collect()
    assert len(proofs) == n and all(r["verified"] for r in proofs if r["doc_id"] != 2)
    assert {r["word"] for r in spelling.variants(long).collect()} >= {"alpha", "omega"}


def test_several_shards_and_blocks_keep_their_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 300)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    ids, v = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    found = collections.defaultdict(set)
    for r in neighbours.search(df, F.col("id") % 20 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
        assert r["score"] == pytest.approx(float(v[ids == r["vec_id"]][0] @ v[ids == r["query_id"]][0]), abs=1e-9)
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & found[q])
    recall = hits / (20 * len(found))
    print("recall over", -(-len(ids) // 300), "shards:", recall)
    assert len(found) == (ids % 20 == 0).sum() and {len(f) for f in found.values()} == {20} and recall >= 0.9
