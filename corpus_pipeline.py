"""From raw documents to packed training sequences: the stages in order, and a run over a folder of tables.

Every stage takes rows with the columns of documents, ignores others, whatever their names, reads whole texts of any length, and gives
an empty table for an empty one. Its docstring says what it does with nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.llm import decontam, langid, line_dedup, packing, simhash
from scarpline.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL has the compressor or the tokenizer. Tests hold each stage against brute force or its contract, and run() against the stages one by one.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the dictionaries are learned from this stage's labelled input.

    Null and empty texts and texts without a letter have no language and go. Of languages that compress a text equally well none is clear.
    A null lang teaches nothing; of rows of one doc_id one teaches; repeated rows are judged alike. Without a labelled row nothing is clear.
    """
    return langid.accepted(docs.select(*COLUMNS), langid.learn_dictionaries(docs.filter(~langid.held_out())))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came earlier, short ones if they are equal; a document of which nothing is left goes.

    A null text stays null, an empty one stays empty. Rows without a doc_id come behind all others; rows of equal doc_id and text are one
    document, others of one doc_id are told apart and ordered by a hash of the text. n_chars is counted anew where lines went.
    """
    found = line_dedup.dedup_lines(docs.select(*COLUMNS), exact_chars=1).filter("n_removed = 0 OR btrim(text, ' \t\r\n') <> ''")
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Null texts and texts without words are one group. A row without a doc_id stays for its group if no row has one; of equal doc_ids the one
    of the smallest hash stays, and of rows of equal doc_id and text one.
    """
    return simhash.representatives(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Rows are judged by their text alone, so null and repeated doc_ids and repeated rows make no difference; null and empty texts stay. Items
    without a word hold no window, an empty benchmark leaves all documents.
    """
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences.

    A null or empty text is its end mark alone. Repeated rows and rows without a doc_id are packed each. Pieces of equal length are
    exchangeable, so ties only change which of them lies where.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is stored and reread by the next."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
