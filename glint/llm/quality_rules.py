"""Quality rules as a bitmask ledger, in DataFrame operations only.

``ledger`` evaluates every rule once for each whole text and keeps the measurements and one long with a bit for each
rule that the text fails. Policies are named, versioned sets of rules, so applying one, or comparing many, is bit
arithmetic on the ledger: no text is read again. ``ablations`` counts, from the ledger, what each rule alone removes.

Words are runs of characters other than 0x20 and 0x09-0x0D. Repeats are found inside the row: hashes of the 3-word
windows are sorted with their places, equal neighbours mark repeated windows, and the words that those cover are
counted once.

Defined cases: a null text is measured as an empty one (no words: base_failed); a text of fewer than three words has
no windows; repeated rows are judged alike; an empty table gives an empty ledger; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A rule's bit, and the condition on the measurements under which a text fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "capitals": "100 * n_capitals > 60 * word_chars",
    "no_stops": "n_words >= 50 and n_stops = 0",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies over the base: the rules of each.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": (*BASE, "symbols"),
    "v2": (*BASE, "short_words", "long_words", "symbols", "repeated_lines", "capitals"),
    "v3": tuple(RULES),
}


def mask(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    words = base.withColumn("w", F.filter(F.split("t", SPLIT), lambda w: w != "")).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(HAS_WORD)))
    hashed = words.withColumn("n", F.size("w")).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    windows = hashed.withColumn("g", F.expr("if(n < 3, array(), transform(slice(h, 1, n - 2), (x, i) -> xxhash64(x, h[i + 1], h[i + 2])))"))
    # only texts that have a repeated window are sorted
    placed = windows.withColumn("s", F.expr("if(size(array_distinct(g)) = size(g), null, sort_array(transform(g, (x, i) -> struct(x as x, i as i))))"))
    repeats = placed.withColumn("p", F.expr("sort_array(filter(transform(s, (e, j) -> if((j > 0 and s[j - 1].x = e.x) or (j < size(s) - 1 and s[j + 1].x = e.x), e.i, -1)), i -> i >= 0))"))
    covered = F.expr("coalesce(aggregate(transform(p, (x, j) -> if(j = size(p) - 1, 3, least(3, p[j + 1] - x))), 0L, (a, x) -> a + x), 0L)")
    return repeats.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        (F.length("t") - _without(F.col("t"), WHITE)).cast("long").alias("word_chars"),
        _without(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _without(F.col("t"), UPPER).cast("long").alias("n_capitals"),
        _without(F.col("t"), ".,;:!?").cast("long").alias("n_stops"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with ``failed``: bit i is set if the text fails rule i."""
    bits = None
    for i, condition in enumerate(RULES.values()):
        bit = F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(docs).withColumn("failed", bits)


def kept(policy: str) -> Column:
    """Whether the ledger's row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def judged(docs: DataFrame, policy: str = "v2") -> DataFrame:
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return ledger(docs).withColumn("base_failed", base).withColumn("kept", ~base & kept(policy))


def verdicts(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """With ``passes`` (bit i is set if the i-th policy keeps the text) and ``only_rule`` (the one rule without which ``policy`` would keep it, else NULL)."""
    passes = sum((F.when(kept(p), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(POLICIES)), F.lit(0))
    under = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    only = F.coalesce(*[F.when(under == mask([r]), F.lit(r)) for r in POLICIES[policy]])
    return entries.withColumn("passes", passes.cast("long")).withColumn("only_rule", only)


def ablations(entries: DataFrame) -> DataFrame:
    """For each policy and rule: how many texts fail it, how many only it removes, and how many the policy keeps without it.

    Texts with the same bits are counted together first, so what is compared is at most 2 ** len(RULES) rows.
    """
    counted = entries.groupBy("failed").agg(F.count("*").alias("n"))
    cases = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rs)).cast("long").alias("mask"), F.lit(mask([r])).cast("long").alias("bit")) for p, rs in POLICIES.items() for r in rs])
    each = counted.select("failed", "n", F.explode(cases).alias("c")).select("failed", "n", "c.*")
    under = F.col("failed").bitwiseAND(F.col("mask"))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("policy", "rule").agg(n(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), n(under == F.col("bit")).alias("n_only"), n(under.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"))
