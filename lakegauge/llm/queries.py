"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import ORACLE_SQL as COLLOCATION_SQL, collocations
from .compact_windows import near_passages
from .fertility import fertility_report
from .imatch import ORACLE_SQL as IMATCH_SQL, fingerprints
from .kneser_ney import classifier_report
from .lattice import embedding_links
from .packing import pack_documents
from .piece_codec import piece_report
from .product_codes import oracle as product_sql, product_codes
from .rans_files import token_file_report
from .secret_scan import secret_report
from .simhash import simhash_report
from .suffix_dedup import suffix_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def over(name: str, table: str, report: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: report(spark.read.parquet(f"{folder}/{table}.parquet"))


over("op1_secret_scan", "documents", secret_report)
over("op2_lattice_near_dedup", "embeddings", embedding_links)
over("op3_compact_windows", "documents", near_passages)
over("op4_simhash_near_dedup", "documents", simhash_report)
over("op9_best_fit_packing", "documents", pack_documents)
over("op10_rans_token_files", "documents", token_file_report)
over("op5_sentencepiece_codec", "documents", piece_report)
over("op6_tokeniser_fertility", "documents", fertility_report)
over("op7_suffix_array_dedup", "documents", suffix_report)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return classifier_report(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


QUERIES["op8_kneser_ney_classifier"] = op8
over("op13_imatch_fingerprints", "documents", fingerprints)
ORACLES["op13_imatch_fingerprints"] = IMATCH_SQL
over("op12_equal_average_codes", "embeddings", product_codes)
ORACLES["op12_equal_average_codes"] = product_sql()
over("op11_phrase_collocations", "documents", collocations)
ORACLES["op11_phrase_collocations"] = COLLOCATION_SQL
