"""The corpus pipeline: five stages, each applied to all that the one before kept and written as Parquet in between.

Every stage takes documents(doc_id, text, lang, source, n_chars, …) and, but for the last, returns these five columns; other
columns are left out, whatever they are called. An empty table gives an empty table. What null ids, null, empty and very long
texts, ties and repeated rows come to is said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, linededup, neardup, pieces, toxicity
from siftline.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on labels.toxic scores below 0.3; the others go, those of exactly 0.3 too.

    The model is learned from rows with an id, a text and a label; every row is then judged by its whole text alone, so rows
    without an id and repeated rows are judged like any other. Null and empty texts have no features and stay.
    """
    model = toxicity.learn(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(*COLUMNS), model, threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; those of which nothing is left go, n_chars follows the text.

    The first place of a run stays: that of the smallest doc_id, null ids first, and the uppermost in a text. Rows that repeat
    id and text lose the same lines. Null, empty and blank texts have no runs and stay as they are.
    """
    left = linededup.dedup_lines(docs.select(*COLUMNS), run=linededup.RUN)
    left = left.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays, of several texts with that id the one whose hash is smallest, of rows that repeat
    both one. A null id stays only where its whole group has none. Texts without words are linked with nothing and stay, of
    rows that repeat id and text one.
    """
    return neardup.keep_one(docs.select(*COLUMNS), k=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten-word windows of the benchmark, or whole items that are shorter.

    Null and empty texts have no windows and stay; repeated rows share their document's fate; an empty benchmark hits nothing.
    """
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), mode="document", width=10).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip, the proof that the ids decode to the very text, of every document left.

    A null text has null ids, an empty one none; of equal paths the one with the longer last piece is taken, at every place;
    every row is encoded on its own, so repeated rows give equal rows.
    """
    return pieces.encode(docs.select(*COLUMNS), pieces.read_model()).select("doc_id", "ids", "n_tokens", "round_trip")


STAGES = [
    ("toxicity", toxic_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The trained classifier and the Viterbi search have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents in turn, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/siftline/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
