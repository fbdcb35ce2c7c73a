"""Trained operators against plain versions of what they compute."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.llm import language_id, licences, quality_rules, toxicity
from tests.llm.helpers import docs, prose


def likelihood(p, x, grade, k=3, l2=0.02):
    """Mean log likelihood of the grades, with the penalty, from weights, first threshold and log steps."""
    w, theta = p[:-k], p[-k] + np.concatenate(([0.0], np.cumsum(np.exp(p[-k + 1 :]))))
    total = 0.0
    for row, g in zip(x, grade):
        over = [1.0, *(1 / (1 + np.exp(-(row @ w - t))) for t in theta), 0.0]
        total += math.log(max(over[g] - over[g + 1], 1e-12))
    return total / len(x) - l2 / len(x) / 2 * (w @ w)


def test_ordinal_fit_is_at_the_top_of_the_likelihood():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    grade = np.digitize(x @ [1.5, -0.5] + rng.logistic(size=300), [0.0, 1.0, 2.5])
    w, theta = toxicity.fit_ordinal(x, grade, rounds=1500)
    assert (np.diff(theta) > 0).all()
    p = np.concatenate((w, theta[:1], np.log(np.diff(theta))))
    best = likelihood(p, x, grade)
    for i in range(len(p)):
        for step in (-0.05, 0.05):
            moved = p.copy()
            moved[i] += step
            assert likelihood(moved, x, grade) < best + 1e-6
    np.testing.assert_allclose(w, [1.5, -0.5], atol=0.4)


def test_severity_is_the_sum_over_thresholds():
    model = toxicity.Severity(np.sort(toxicity._features("foul")[0]), np.array([2.0]), np.array([1.0, 2.0, 3.0]), 0.5)
    severity, grade, toxic = model.score("foul " * 4 + "fair " * 6)
    x = math.log1p(100 * 4 / (10 + toxicity.PRIOR))
    over = [1 / (1 + math.exp(t - 2 * x)) for t in (1, 2, 3)]
    assert severity == pytest.approx(sum(over))
    assert grade == int(np.argmax([1 - over[0], over[0] - over[1], over[1] - over[2], over[2]]))
    assert toxic == (over[0] >= 0.5)


def test_grades_follow_how_much_of_a_text_is_foul(spark):
    bad = ["vile", "foul", "rotten", "nasty"]
    texts, toxic = [], []
    for i in range(160):
        words = prose(i, 60).split()
        if i % 2:
            for j in range((i % 3) * 12 + 4):
                words[(j * 7 + i) % len(words)] = bad[j % 4]
        texts.append(" ".join(words))
        toxic.append(i % 2)
    table = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    df = docs(spark, texts)
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, table)).collect()}
    mean = lambda k: np.mean([got[i].expected_severity for i in range(160) if i % 2 and i % 3 == k])
    clean = np.mean([got[i].expected_severity for i in range(0, 160, 2)])
    assert clean < mean(0) < mean(1) < mean(2)
    assert sum(got[i].toxic == bool(toxic[i]) for i in range(160)) >= 156
    twice = toxicity.score(df.where("doc_id < 3").unionByName(df.where("doc_id < 3")), toxicity.fit(df, table)).collect()
    assert len(twice) == 6 and len({tuple(r) for r in twice}) == 3
    assert toxicity.score(df.where("false"), toxicity.fit(df.where("false"), table)).count() == 0




def test_nearest_centroid_equals_numpy(spark):
    texts = [prose(i, 40, ("der", "und", "nicht", "haus", "schule")) if i % 2 else prose(i, 40, ("the", "and", "house", "school", "think")) for i in range(60)]
    df = docs(spark, texts, langs=["de" if i % 2 else "en" for i in range(60)])
    model = language_id.fit(df, ~language_id.held_out(), per_language=20)
    got = {r.doc_id: r for r in language_id.predict(df, model, "doc_id").collect()}
    for i, t in enumerate(texts):
        v = np.log1p(language_id.counts(t)) * model.idf
        cosine = [v @ c / np.linalg.norm(v) / np.linalg.norm(c) for c in model.centres]
        assert got[i].score == pytest.approx(max(cosine), abs=1e-4)
        assert got[i].lang_pred == model.languages[model.language[int(np.argmax(cosine))]] == ("de" if i % 2 else "en")
        assert not got[i].rejected
    odd = language_id.predict(docs(spark, ["жизнь прекрасна и удивительна " * 5, "1 2 3", None]), model, "doc_id").orderBy("doc_id").collect()
    assert all(r.rejected for r in odd) and [r.lang_pred for r in odd][1:] == ["und", "und"]


def test_language_ties_and_repeated_rows(spark):
    df = docs(spark, ["same words here", "same words here"] * 20, langs=["b", "a"] * 20)
    model = language_id.fit(df, F.lit(True))
    got = language_id.predict(df.unionByName(df), model, "doc_id").collect()
    assert len(got) == 80 and {r.lang_pred for r in got} == {"a"}


def test_every_paragraph_is_scored_as_without_the_bound(spark):
    texts = [prose(i, 30) for i in range(40)]
    for k, ts in enumerate(licences.TEMPLATES.values()):
        texts[k] += "\n\n" + ts[0] + "\n" + prose(k + 100, 5)
    texts += [None, "", "Licensed", "license text under work " * 40]
    df = docs(spark, texts)
    model = licences.fit(df)
    got = {r.doc_id: r for r in licences.scan(df, model).collect()}
    best = {}
    for r in licences.paragraphs(df).withColumn("x", licences.features("w")).collect():
        odds = [(b + sum(w[i] for i in r.x), -k) for k, (w, b) in enumerate(zip(model.weights, model.biases))]
        top, first = max(odds)
        if top >= model.threshold:
            best.setdefault(r.doc_id, []).append((r.p, top, model.families[-first]))
    for i in range(len(texts)):
        found = best.get(i, [])
        assert got[i].n_paragraphs == len({p for p, _, _ in found})
        assert got[i].predicted in ({f for _, _, f in found} or {"unknown"})
    for k, family in enumerate(licences.TEMPLATES):
        assert got[k].licence == family
    doubled = licences.scan(df.unionByName(df), model).where("doc_id = 0").collect()
    assert [r.n_paragraphs for r in doubled] == [got[0].n_paragraphs] * 2
    assert licences.scan(df.where("false"), model).count() == 0


def test_policy_verdicts_are_bit_arithmetic(spark):
    texts = [prose(1, 80) + ".", prose(2, 10), "# $ % & * < > | " * 20, "ABCDE FGHIJ " * 60, None]
    rows = quality_rules.verdicts(quality_rules.judged(docs(spark, texts))).collect()
    for r in rows:
        fails = {name for i, name in enumerate(quality_rules.RULES) if r.failed >> i & 1}
        under = fails & set(quality_rules.POLICIES["v2"])
        assert r.only_rule == (next(iter(under)) if len(under) == 1 else None)
        assert r.passes == sum(1 << i for i, p in enumerate(quality_rules.POLICIES.values()) if not fails & set(p))
        assert re.fullmatch(r"\d+", str(r.passes))
