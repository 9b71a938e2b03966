"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm import chat, compression, decontaminate, jaccard, langid, licences, packing, periodic, prefixes, quality, tokens, urlfilter, warc
from answerloom.llm.common import held_out, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; see ``quality``."""
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    scored = quality.score(spark, documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules; see ``urlfilter``."""
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rules_table(spark)).drop("url")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; see ``decontaminate``."""
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, its exchanges read as calls of a tool and their results; see ``chat``."""
    return chat.format_chat(chat.as_tool_use(table(spark, sf_dir, "conversations")), chat.TOOLS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and assembled from them again; see ``warc``."""
    found = warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.col("refers_to.page_id").alias("refers_to"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and compression bands, learnt from the labels, over every document; see ``compression``."""
    return compression.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by rank-order profiles; see ``langid``."""
    documents = table(spark, sf_dir, "documents")
    judged = langid.identify(spark, documents.select("doc_id", "text"), langid.fit(documents))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 90 % of their three-word shingles; see ``jaccard``."""
    return jaccard.similarity_groups(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=9, den=10)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count; see ``tokens``."""
    return tokens.count(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by its words, in bins of 512 to 4096; see ``packing``."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), packing.n_words(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, some of which are made to repeat; see ``periodic``."""
    return periodic.digests(periodic.find(periodic.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and expressions of every document; see ``licences``."""
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with its family's beginning; see ``prefixes``."""
    return prefixes.trie(*prefixes.rebuilt(prefixes.placed(table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_url_filters, op3_benchmark_decontamination, op4_chat_formatting, op5_warc,
        op6_quality_rules, op7_language_id, op8_ngram_jaccard_join, op9_token_counts, op10_best_fit_packing, op11_periodic_runs,
        op12_license_scans, op13_prefix_trie,
    )
}
ORACLES: dict[str, str] = {
    "op2_url_filters": urlfilter.ORACLE, "op3_benchmark_decontamination": decontaminate.ORACLE, "op4_chat_formatting": chat.ORACLE,
    "op5_warc": warc.ORACLE, "op8_ngram_jaccard_join": jaccard.ORACLE, "op11_periodic_runs": periodic.ORACLE,
    "op13_prefix_trie": prefixes.ORACLE,
}
