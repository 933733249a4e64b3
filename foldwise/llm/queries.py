"""The registered queries of this subpackage: thin, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldwise.llm import oracles
from foldwise.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op5_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op12_source_mix": oracles.SOURCE_MIX,
    "op13_filter_audit": oracles.FILTER_AUDIT,
}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the divergence verdict of every document."""
    from foldwise.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned where crc32(doc_id) mod 4 is not 2."""
    from pyspark.sql import functions as F

    from foldwise.llm.frames import fold_of
    from foldwise.llm.langid import fitted, identify

    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    models = fitted(docs.where(~held_out))
    return identify(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_char",
                                         "rejected")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file (installed with the tokenizer files)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, ids digest and decoded digest of every document."""
    from foldwise.llm.bpe import encode_digest

    return encode_digest(table(spark, sf_dir, "documents"), vocabulary())


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned where crc32(doc_id) mod 3 is not 1."""
    from pyspark.sql import functions as F

    from foldwise.llm.frames import fold_of
    from foldwise.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    net = fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted", "flagged")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item, with the edit distance."""
    from foldwise.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and automaton score of every document; learned where
    crc32(doc_id) mod 10 is not 0."""
    from pyspark.sql import functions as F

    from foldwise.llm.frames import fold_of
    from foldwise.llm.lmscore import lm_scores

    held_out = fold_of(F.col("doc_id"), 10) == 0
    return lm_scores(table(spark, sf_dir, "documents"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeats of 20 words."""
    from foldwise.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    from foldwise.llm.jaccard import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of personal data and all spans of every document."""
    from pyspark.sql import functions as F

    from foldwise.llm.pii import KINDS, find_personal_data

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                      s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind))

    base = F.filter("found", lambda s: s["k"] <= len(KINDS))
    counts = [count(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return find_personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of every document repeat an earlier line."""
    from foldwise.llm.lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two vocabularies in every document."""
    from foldwise.llm.alignment import alignment_digest

    return alignment_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                            vocabulary("piece_bpe_32k.model"))


@query
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    from foldwise.llm.mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filter removes at every step of every order, per source."""
    from foldwise.llm.audit import filter_audit

    return filter_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
