"""The registered queries of this folder, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, prefixes, shards
from .decontaminate import contamination
from .fingerprints import neighbour_fingerprints
from .grammar import grammar_round_trip
from .jaccard import jaccard_groups
from .mixing import source_mix
from .ngrams import language_scores
from .packing import pack_documents
from .periods import period_report
from .prefixes import conversation_trie
from .registry import ORACLES, QUERIES, query
from .shards import extendible_shards
from .suffixes import repeated_spans
from .toxicity import toxicity_scores
from .wordpiece import token_counts

__all__ = ["ORACLES", "QUERIES", "read", "tokenizer"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    """Where an installed public tokenizer keeps a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_piecewise_fingerprints")
def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(read(spark, sf_dir, "documents"))


@query("op2_jaccard_groups")
def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"))


@query("op3_extendible_shards", shards.ORACLE)
def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(read(spark, sf_dir, "documents"))


@query("op4_best_two_fit")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op5_wordpiece_counts")
def _wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op6_winnowed_contamination", decontaminate.ORACLE)
def _contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op7_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op8_language_scores")
def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read(spark, sf_dir, "documents"))


@query("op9_repeated_spans")
def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents"))


@query("op10_grammar_files")
def _grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_round_trip(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op11_conversation_trie", prefixes.ORACLE)
def _trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"))


@query("op12_periodic_runs")
def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_report(read(spark, sf_dir, "documents"))


@query("op13_source_mix", mixing.ORACLE)
def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(read(spark, sf_dir, "documents"))
