"""Registered queries of the text operators and SQL that a second engine can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import (decontaminate, fertility, html_extract, langid, licenses, pieces, sharding, simhash, spelling, suffix_dedup,
                           token_counts, token_links, topk)
from gridspark.llm.common import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_pages(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item found in it."""
    found = decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    leak = F.explode("leaks").alias("leak")
    return found.select("doc_id", leak).select("doc_id", "leak.item_id", "leak.distance", "leak.start", "leak.end")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), shards=40)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frequent word with its more frequent form and the root of its group."""
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how the tokens of two vocabularies align, and how usual its links are."""
    return token_links.token_links(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its base counts, token measures and verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = fertility.judge(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "script", *fertility.MEASURES, F.array_join("outside", ",").alias("outside"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_simhash, op3_html, op4_decontaminate, op5_langid, op6_pieces, op7_token_counts,
                                   op8_histogram_sort, op9_suffix_dedup, op10_licenses, op11_spelling, op12_token_links, op13_fertility)}

ORACLE_SQL = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
