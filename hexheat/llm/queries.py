"""The queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import run as run_pipeline
from hexheat.llm.bpe import digests
from hexheat.llm.byte_bpe import byte_digests
from hexheat.llm.checks import CHECKS  # noqa: F401
from hexheat.llm.collocations import collocations
from hexheat.llm.common import table
from hexheat.llm.exact_dedup import exact_groups
from hexheat.llm.lattice_join import near_vectors
from hexheat.llm.licences import scan_licences
from hexheat.llm.main_text import extract_pages
from hexheat.llm.mixing import mix_words
from hexheat.llm.ngram_join import near_copies
from hexheat.llm.periodic_runs import run_digests
from hexheat.llm.quality import score_quality
from hexheat.llm.secrets import scan_secrets
from hexheat.llm.suffix_dedup import removal_digests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


@query
def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


@query
def op6_lattice_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(table(spark, sf_dir, "documents"))


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query
def op13_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_digests(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_pipeline(spark, sf_dir)
