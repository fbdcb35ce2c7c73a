"""The numbered operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.llm import binary_output, labelled_pages, language_id, licences, line_dedup, main_text, merkle, mixing, near_dups, neighbours, oracles, packing, quality_rules, scratch, spelling, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(quality_rules.judged(_table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "passes", "only_rule"
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, alone and with others, from the ledger of failure bits."""
    return quality_rules.ablations(quality_rules.ledger(_table(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"), [5, 2, 1]).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~language_id.held_out())
    keyed = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), language_id.held_out().alias("held_out"))
    return language_id.predict(keyed, model, "doc_id", "held_out")


def op6_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch.new_path(spark, "ids")
    binary_output.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return binary_output.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.find(_table(spark, sf_dir, "documents"), size=2, percent=80)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_table(spark, sf_dir, "documents"), merkle.without_newlines())


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"), main_text.fit(labelled_pages.sample(spark, 1200)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "quality_ablations": quality_ablations,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mix_sources": op4_mix_sources,
    "op5_language_id": op5_language_id,
    "op6_binary_output": op6_binary_output,
    "op7_licence_scan": op7_licence_scan,
    "op8_near_dups": op8_near_dups,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_html_extraction": op12_html_extraction,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {"op2_quality_rules": oracles.quality_rules(), "quality_ablations": oracles.ablations(), "op4_mix_sources": oracles.MIX, "op8_near_dups": oracles.NEAR, "op11_merkle_manifest": oracles.merkle(), "op13_spelling_variants": oracles.SPELLING}
