"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns
the packed pieces. run() writes every stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, packing, quality, simhash
from tidemark.llm.common import settled, stage
from tidemark.llm.queries import TOKENIZER, table, trusted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones are unchanged.

    Null and empty texts have too few words and go; rows without an id are judged like others, as not trusted.
    Repeated rows stay or go together. An empty table gives an empty one.
    """
    return quality.score(docs, trusted(spark, sf_dir)).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go; a document that loses lines gets the rest as its text, with its length.

    Every document stays, with an empty text if nothing is left; one that loses nothing is unchanged.
    """
    kept = settled(lines.drop_common_lines(docs, min_docs=10, min_chars=1), ["n_dropped", "kept_text"])
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumns({"text": text, "n_chars": length}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, unchanged: that of the smallest id, of equal ids the one of the smallest key.

    Null, empty and blank texts are one group. Rows that agree in id and text are copies: one stays. An empty table
    gives an empty one.
    """
    return simhash.keep_one(docs, n_words=4, radius=4, seed=42)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others are unchanged, repeated rows and null or empty texts, which have no words, among them.

    Null and empty items are in no document. An empty table gives an empty one.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, as pieces of sequences of 2048 ids, with the ids of each piece.

    Null and empty texts are the end id alone. Repeated rows are packed once each; ties on the curve go by id
    and content. An empty table gives no pieces.
    """
    return packing.pack(docs, TOKENIZER, end_id=1, length=2048, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL can't express the stages' hashes and token ids; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
