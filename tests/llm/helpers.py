"""Small tables and brute-force versions."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def docs(spark, texts, sources=None, langs=None, extra=True):
    rows = [(i, t, (langs or [None] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t) if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    # names that operators use themselves must not clash
    return df.selectExpr("*", "doc_id as id", "text as line", "'x' as key", "1 as size", "n_chars as n") if extra else df


def prose(seed, n=60, words=("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "zeta", "iota", "rho")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))


def shingles(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


ODD = [None, "", "   ", "one", "One", "a b", "A B", "\n\n", "x" * 20000, "é ñ ß   \x1c"]
