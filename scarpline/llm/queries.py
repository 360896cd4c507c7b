"""The registered queries of the corpus operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scarpline.llm import collocations, conversations, decontam, html_extract, langid, line_dedup, media, ngram_join, packing, quality, simhash, substring, url_filter
from scarpline.llm.common import table

DOCS = ("doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d, *more: table(s, d, "documents", *DOCS, *more)
    return {
        "op1_html_extraction": lambda s, d: html_extract.extract(table(s, d, "pages", "page_id", "url", "html")),
        "op2_best_fit_packing": lambda s, d: packing.pack_documents(docs(s, d)),
        "op3_simhash_dedup": lambda s, d: simhash.op3_rows(docs(s, d)),
        "op4_line_dedup": lambda s, d: line_dedup.op4_rows(docs(s, d)),
        "op5_media_columns": lambda s, d: media.op5_rows(docs(s, d)),
        "op6_url_filter": lambda s, d: url_filter.op6_rows(table(s, d, "pages", "page_id", "url", "html")),
        "op7_quality_classifier": lambda s, d: quality.score_documents(docs(s, d, "lang", "source", "n_chars"), table(s, d, "labels", "doc_id", "quality", "toxic")),
        "op8_substring_dedup": lambda s, d: substring.op8_rows(docs(s, d)),
        "op9_language_id": lambda s, d: langid.op9_rows(docs(s, d, "lang")),
        "op10_decontamination": lambda s, d: decontam.op10_rows(docs(s, d), table(s, d, "benchmark", "item_id", "text")),
        "op11_ngram_join": lambda s, d: ngram_join.op11_rows(docs(s, d)),
        "op12_phrase_collocations": lambda s, d: collocations.op12_rows(table(s, d, "documents", "text", "lang")),
        "op13_conversation_repair": lambda s, d: conversations.op13_rows(table(s, d, "conversations", "conv_id", "turn", "role", "text")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.OP4_SQL, "op8_substring_dedup": substring.OP8_SQL, "op10_decontamination": decontam.OP10_SQL, "op11_ngram_join": ngram_join.OP11_SQL, "op12_phrase_collocations": collocations.OP12_SQL}
