"""The registered queries ``opN_<name>`` of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.llm import byte_bpe, decontaminate, divergence, licences, line_dedup, minhash, resample, secrets, simhash, style_tree, toxicity, unigram, wavelet
from ethospark.llm.common import table, tokenizer_path, written


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids begin, how many they are and their checksum, read back from the shards."""
    shards = written(wavelet.shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2), "shards")
    return wavelet.read_documents(wavelet.with_starts(shards))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of toxicity, expected severity and grade of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "p_toxic", "severity", "grade", "rejected")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(byte_bpe.encode(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, block and line that is a known licence or notice."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, tokens and log probability of every document under the unigram model."""
    return unigram.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "removed_chars")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at 3 or fewer differing bits."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return near.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds, with their edit distance."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and places of the secrets in every document, with the weak parts that others complete."""
    return secrets.digests(secrets.find(table(spark, sf_dir, "documents")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and the terms that tell a source from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark's texts, and the rank of the drawn tenth."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_style_tree": op1_style_tree,
    "op2_wavelet": op2_wavelet,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_licences": op5_licences,
    "op6_unigram": op6_unigram,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash": op8_minhash,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_secrets": op11_secrets,
    "op12_divergence": op12_divergence,
    "op13_resample": op13_resample,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLES: dict[str, str] = {"op5_licences": licences.oracle(), "op12_divergence": divergence.oracle()}
