import random
from collections import Counter

import corpus_pipeline
import duckdb
from glint.llm import language_id, line_dedup, oracles, packing
from tests.llm.helpers import ODD, SCHEMA, WORD, components, edit_distance, prose, shingles


def test_stages_keep_columns_and_pass_rows_on(spark, tmp_path):
    shared = "a sentence that many documents of this corpus have in common with others"
    texts = [*ODD, *(f"{prose(i, 80)}\n{shared}" for i in range(40)), *[prose(3, 80) + " end"] * 5]
    rows = [(i, t, "en", ["a", "b"][i % 2], len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        df = spark.read.parquet(path)
        left.append({r.doc_id for r in df.select("doc_id").collect()})
    assert set(range(len(ODD), len(ODD) + 40)) <= left[0] and not {0, 1, 2} & left[0]
    kept = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "line_dedup")).collect()}
    assert sum(shared in (t or "") for t in kept.values()) == 1
    assert left[2] <= left[1] and left[3] <= left[2] and left[4] == left[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_columns_with_names_that_stages_use_themselves(spark, tmp_path):
    names = ["score", "rejected", "lang_pred", "id", "key", "rank", "size", "taken", "h", "bin", "c0"]
    texts = [*(prose(i, 60) for i in range(30)), prose(3, 60) + " end"]
    rows = [(i, t, "en", ["a", "b"][i % 2], len(t), *names) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, {', '.join(n + ' string' for n in names)}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert out.count() > 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns and out.select(*names).distinct().collect() == [tuple(names)]
            df = out


def lines_left(texts):
    """What is left of each text (by id) when every line but the first of its class goes; None if no word is left of a text that had one."""
    lines = [(i, p, l) for i, t in sorted(texts.items()) for p, l in enumerate(t.split("\n")) if WORD.search(l)]
    different = sorted({l for *_, l in lines})
    close = lambda a, b: edit_distance(a, b) <= line_dedup.edits(min(len(a), len(b)))
    links = [(a, b) for b in range(len(different)) for a in range(b) if abs(len(different[a]) - len(different[b])) <= 2 and close(different[a], different[b])]
    of = components(range(len(different)), links)
    seen, gone = set(), set()
    for i, p, l in lines:
        c = of[different.index(l)]
        if c in seen:
            gone.add((i, p))
        seen.add(c)
    left = {i: "\n".join(l for p, l in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in texts.items()}
    return {i: t for i, t in left.items() if WORD.search(t) or not WORD.search(texts[i])}


def test_each_stage_equals_a_brute_force_version(spark, tmp_path):
    rng = random.Random(12)
    line = lambda i: prose(i, rng.randrange(3, 6))
    texts = ["1234 5678", "%%%", *["\n".join(line(100 * i + k) for k in range(6)) for i in range(24)]]
    for i in range(2, 12):
        words = texts[i].split(" ")
        texts += [" ".join(words[:-1]) + " other", texts[i].replace("a", "o", 1), "\n".join([*texts[i].split("\n")[:2], line(9000 + i), line(9100 + i)])]
    base = [prose(i, 120) for i in (501, 502)]  # of one line each, so that near copies reach their stage
    texts += [b + " " + " ".join(f"own{i}x{k}" for k in range(n)) for i, (b, n) in enumerate((b, n) for b in base for n in (0, 9, 12, 60))]
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    df, outs = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        outs.append(df := spark.read.parquet(str(tmp_path / name)))
    by_id = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    known, lined, apart = by_id(outs[0]), by_id(outs[1]), by_id(outs[2])

    first = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit(first, ~language_id.held_out())
    assert known == {i: t for i, t in enumerate(texts) if not model.predict(t)[2]} and 0 not in known

    assert lined == lines_left(known) and len(lined) < len(known)

    sets = {i: shingles(t, 5) for i, t in lined.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(list(sets), links)
    assert links and apart == {i: lined[i] for i in lined if root[i] == i}

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/near_dedup/*.parquet'")
    taken = {i: n for i, n in con.execute(f"SELECT doc_id, taken FROM ({oracles.MIX})").fetchall() if n}
    mixed = Counter()
    for r in outs[3].collect():
        mixed[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert apart[r["doc_id"]].startswith(r["text"])
    assert mixed == taken

    packed, bins = Counter(), Counter()
    for r in outs[4].collect():
        packed[r["doc_id"]] += r["size"]
        bins[r["shard"], r["bin"]] += r["size"]
    assert packed == taken and max(bins.values()) <= packing.CAPACITY
