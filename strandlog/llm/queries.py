"""Queries of the training-text problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import materialise
from ..tables import load
from . import leakage, mixing, splitting
from .sql import ORACLE
from .tokens import token_sizes

__all__ = ["ORACLE", "QUERIES"]


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(load(spark, d, "eval_items"), _leaks(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = load(spark, d, "mix_targets")
    sizes = materialise(token_sizes(load(spark, d, "documents")), "token-sizes")
    return mixing.shares(mixing.mix(sizes, targets), targets, mixing.plan_mix(sizes, targets))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(load(spark, d, "documents")).where("piece_no = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_pieces)}
