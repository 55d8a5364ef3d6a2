"""The registered queries `opN_<name>` with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kwspread.llm import bpe_automaton, fingerprints, host_rules, lsh_forest, packing, personal_data, prefix_trie, quality, secrets_field, substring_dedup, token_files, turn_repair, url_filter
from kwspread.llm.registry import QUERIES, read, register

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


@register("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that occur elsewhere, too."""
    return substring_dedup.substring_digest(read(spark, sf_dir, "documents", "doc_id", "text"))


#: Rules of the url contract, prefix and verdict.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


@register("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url; the urls that a rule decides are the labelled table."""
    return url_filter.judge_urls(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


@register("op3_lsh_forest")
def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return lsh_forest.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


@register("op4_bpe_automaton")
def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the automaton and decoded again."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe_automaton.codec_digest(docs, public_tokenizers.path(BYTE_BPE))


@register("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those the field adds."""
    return personal_data.personal_data_digest(read(spark, sf_dir, "documents", "doc_id", "text"))


@register("op6_multiset_hash")
def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness."""
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


@register("op7_quality_network")
def op7_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return quality.quality_digest(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


@register("op8_pack_documents")
def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and packed into windows of 4096 tokens."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE), window=4096, end_id=2)


@register("op9_host_rules", host_rules.SQL)
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document with the verdict on its host (source)."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return host_rules.host_rules(docs).select(*host_rules.RESULT)


@register("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as Parquet list columns and read back."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return token_files.token_files_digest(docs, public_tokenizers.path(WORD_BPE), end_id=1)


@register("op11_turn_repair")
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged as stated, its faults and its cheapest repair."""
    return turn_repair.repair_digest(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@register("op12_prefix_trie")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@register("op13_secrets_field")
def op13_secrets_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans and those the field adds."""
    return secrets_field.secrets_digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def llm_queries() -> dict:
    return QUERIES
