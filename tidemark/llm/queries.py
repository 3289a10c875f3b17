"""The corpus operators as registered queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, language, lines, packing, quality, secrets, simhash, tokens, toxicity, trie, whitening, windows, wordtable

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents whose quality is confirmed."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.score(table(spark, sf_dir, "documents"), trusted(spark, sf_dir)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_repeated_windows(table(spark, sf_dir, "documents"), size=200, with_text=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), owner_col="source"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_ids(tokens.write_ids(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents"), n_words=4, radius=4, seed=42))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, end_id=1, length=2048)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordtable.digest(wordtable.encode(table(spark, sf_dir, "documents"), WORD_TOKENIZER, with_text=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_secrets": op4_secrets,
        "op5_language": op5_language,
        "op6_token_ids": op6_token_ids,
        "op7_decontamination": op7_decontamination,
        "op8_simhash": op8_simhash,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_whitening": op12_whitening,
        "op13_word_table": op13_word_table,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": lines.ORACLE_SQL,
        "op7_decontamination": decontaminate.ORACLE_SQL,
        "op11_prefix_trie": trie.ORACLE_SQL,
    }
