"""A corpus pipeline of five of the training-data operators. Each stage takes documents and returns documents; the last returns encoded pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalens.llm.langid import in_known_language
from fiscalens.llm.linededup import without_recurring_lines
from fiscalens.llm.mixing import mixed_documents
from fiscalens.llm.ngram_join import without_near_copies
from fiscalens.llm.sentencepieces import encode_pieces
from fiscalens.llm.shared import new_folder, small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a known language, values as they are.

    Null, empty and letterless texts are in none and go; a null lang or source is no evidence. Repeated rows are decided alike; of
    languages with equal posteriors the first by name is taken. Columns named like the operator's are kept; an empty table stays empty.
    """
    small_batches(spark)
    return in_known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without recurring lines, n_chars counted anew; documents of which no line is left go.

    A template's lines stay in the first document that has it (smallest doc_id, null first). Rows equal in doc_id and text are one
    document and are treated alike. Null and empty texts and texts without words keep their rows.
    """
    return without_recurring_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (smallest doc_id, null first) of each group of near copies; rows that repeat its doc_id stay with it.

    Null texts and texts without words are like no other and stay.
    """
    return without_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row for each pass over one, cut to the words taken, in its shard's order.

    A null source is a source, last in order. Null and empty texts have no words and are never taken; rows with equal ids are
    documents of their own.
    """
    return mixed_documents(docs, [5.0, 2.0, 1.0])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of pieces for each row of docs, with merges skipped anew in each pass over a document.

    Rows equal in doc_id and text are numbered, in no order that matters, as they are alike. Null and empty texts have no pieces.
    """
    alike = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return encode_pieces(docs.select("doc_id", "text").withColumn("turn", F.row_number().over(alike)), turn="turn")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding", encoding),
]
ORACLE_SQL = None  # language models, hashes and tokenizers have no SQL form; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, "pipeline")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
