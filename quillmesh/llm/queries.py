"""The queries over the numbered training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import oracle
from quillmesh.llm.common import read
from quillmesh.llm.decision_list import quality_rules
from quillmesh.llm.decontaminate import find_leaks
from quillmesh.llm.html_density import extract_text
from quillmesh.llm.jaccard_join import jaccard_components
from quillmesh.llm.lang_centroids import identify
from quillmesh.llm.license_index import scan_licenses
from quillmesh.llm.pair_rank import rank_quality
from quillmesh.llm.phrase_sketch import collocations
from quillmesh.llm.piece_codec import encode_documents
from quillmesh.llm.spelling_grams import group_spellings
from quillmesh.llm.toxicity_cnn import score_toxicity
from quillmesh.llm.url_markov import judge_urls
from quillmesh.llm.warc_chunks import archive_round_trip


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


#: (host, path, allow)
URL_RULES = [("com", "/en/", False), ("example.com", "/en/7", True), ("net", "/de/", True), ("example.net", "/de/8", False), ("org", "/es/", False)]


def op3_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES).drop("score")


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages"))


def op7_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_pair_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(read(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_piece_codec": op2_piece_codec,
    "op4_quality_rules": op4_quality_rules,
    "op5_jaccard_join": op5_jaccard_join,
    "op3_url_markov": op3_url_markov,
    "op6_warc_chunks": op6_warc_chunks,
    "op7_license_index": op7_license_index,
    "op8_toxicity_cnn": op8_toxicity_cnn,
    "op9_pair_rank": op9_pair_rank,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_language_id": op13_language_id,
}

SQL = {
    "op3_url_markov": oracle.url_sql(URL_RULES),
    "op5_jaccard_join": oracle.JACCARD,
    "op6_warc_chunks": oracle.WARC,
    "op10_decontaminate": oracle.LEAKS,
    "op11_spelling_variants": oracle.SPELLING,
    "op12_phrase_mining": oracle.COLLOCATIONS,
}
