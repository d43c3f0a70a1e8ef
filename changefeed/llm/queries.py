"""Queries on training data, one for each operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.llm import bpe, licences, mixing, neighbours, quality, repeats, resampling, search, sharding, simhash, tokens, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, table: str = "documents") -> Callable:
    def register(fn: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[key] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))
        return fn

    return register


@query("op1_byte_bpe")
def byte_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op2_simhash_near_duplicates")
def near_duplicates(docs: DataFrame) -> DataFrame:
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_token_files")
def token_files(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return tokens.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op6_mix_sources")
def mix_sources(docs: DataFrame) -> DataFrame:
    taken = mixing.taken(mixing.mix_documents(docs))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


@query("op7_quality_rules")
def quality_rules(docs: DataFrame) -> DataFrame:
    return quality.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity"
    )


@query("op9_suffix_repeats")
def suffix_repeats(docs: DataFrame) -> DataFrame:
    return repeats.digests(docs)


@query("op4_nearest_neighbours", "embeddings")
def nearest_neighbours(rows: DataFrame) -> DataFrame:
    return neighbours.search(rows, F.col("vec_id") % 100 == 0, k=10)


@query("op8_arc_to_warc", "pages")
def arc_to_warc(pages: DataFrame) -> DataFrame:
    return warc.converted(pages)


@query("op10_licence_scan")
def licence_scan(docs: DataFrame) -> DataFrame:
    return licences.scan(docs)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.scored(docs, labels)


QUERIES["op3_toxicity"] = toxicity_scores


@query("op11_feistel_shards")
def feistel_shards(docs: DataFrame) -> DataFrame:
    return sharding.digests(docs)


ORACLES["op11_feistel_shards"] = sharding.oracle()


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampling.resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES["op12_importance_resampling"] = importance_resampling
ORACLES["op12_importance_resampling"] = resampling.oracle()


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("documents", "benchmark"))
    return search.search(docs, items)


QUERIES["op13_lexical_search"] = lexical_search
ORACLES["op13_lexical_search"] = search.oracle()
